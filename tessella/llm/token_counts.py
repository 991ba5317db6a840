"""Exact token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Texts are cut at spaces the pre-tokenizer never looks across, so each distinct chunk is counted once per worker and
remembered. Chunks not seen yet are pre-tokenized; all their distinct pre-tokens lie in one flat symbol array with a
sequence number per symbol. A round finds each sequence's lowest-rank adjacent pair and applies it at once in every
sequence; sequences without a pair are done, and the symbols that survive are the tokens. A pre-token of more than
`LONG` bytes is worked through alone, rank by rank, so that its time grows with its length, not with the square of it.

Null text counts as empty (0 bytes, 0 tokens). Special strings inside texts become one token each, as the library
does by default. Texts of any length are worked through in segments, cut at single spaces. Repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import passing
from tessella.llm.text import chunks, segments
from tessella.runtime import ship, small_batches

# Fixed values of the byte_level pre-tokenizer, from the public format: the pattern and the byte alphabet.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

CACHE_ENTRIES = 400_000
LONG = 1_000
BATCH_CHARS = 1 << 21
_loaded: dict[str, "Counter"] = {}


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from 256."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return [chr(b) if b in set(PRINTABLE) else chr(256 + rest.index(b)) for b in range(256)]


class Merger:
    """Ranks of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[s] for s in byte_symbols()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.none = len(pairs)

    def ranks(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Rank of the pair each symbol forms with its right neighbour; `none` where there is no such merge."""
        out = np.full(len(sym), self.none, np.int64)
        if len(sym) > 1:
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[at] == key) & (seq[:-1] == seq[1:])
            out[:-1][ok] = self.rank[at[ok]]
        return out

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def long_count(self, pretoken: bytes) -> int:
        """Tokens in one long pre-token: its pairs wait by rank, and a round applies the lowest rank at all its places.

        A merge only makes pairs of higher rank, as every symbol is made by one merge, so each rank comes once."""
        n = len(pretoken)
        sym = self.byte_id[np.frombuffer(pretoken, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, self.none, np.int64)
        rank[:-1] = self.of_pairs(sym[:-1], sym[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] < self.none]
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for part in np.split(at, cut) if len(at) else ():
                k = int(rank[part[0]])
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(heap, k)
                waiting[k].append(part)

        wait(np.arange(n))
        left = n
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # Of overlapping pairs (a run of one symbol) every second one merges, from the left.
            head = np.r_[True, after[at[:-1]] != at[1:]]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            gone = after[at]
            then = after[gone]
            sym[at], after[at], rank[gone] = self.made[r], then, self.none
            inside = then < n
            before[then[inside]] = at[inside]
            left -= len(at)
            touched = np.unique(np.r_[at, before[at][before[at] >= 0]])
            has = after[touched] < n
            rank[touched] = self.none
            touched = touched[has]
            rank[touched] = self.of_pairs(sym[touched], sym[after[touched]])
            wait(touched)
        return left

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """Tokens in each pre-token."""
        long = [k for k, p in enumerate(pretokens) if len(p) > LONG]
        if long:
            out = np.zeros(len(pretokens), np.int64)
            out[long] = [self.long_count(pretokens[k]) for k in long]
            short = [k for k, p in enumerate(pretokens) if len(p) <= LONG]
            out[short] = self.counts([pretokens[k] for k in short])
            return out
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        total = sizes.copy()
        sym = self.byte_id[np.frombuffer(b"".join(pretokens), np.uint8)]
        seq = np.repeat(np.arange(len(pretokens)), sizes)
        while len(sym):
            rank = self.ranks(sym, seq)
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, first)
            live = low < self.none
            per = np.diff(np.r_[first, len(seq)])
            keep = np.repeat(live, per)
            if not keep.all():
                sym, seq, rank, low, per = sym[keep], seq[keep], rank[keep], low[live], per[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, per)
            # Of overlapping pairs (a run of one symbol) every second one merges, from the left.
            at = np.flatnonzero(hit)
            head = np.r_[True, (at[1:] - at[:-1] > 1)]
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            sym = sym.copy()
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            total -= np.bincount(seq[at], minlength=len(total))
            sym, seq = sym[stay], seq[stay]
        return total


class Counter:
    def __init__(self, path: str):
        self.merger = Merger(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.merger.special))) if self.merger.special else None
        self.of_chunk: dict[str, int] = {}
        self.of_pretoken: dict[str, int] = {}

    def learn(self, missing: list[str]) -> dict[str, int]:
        """Counts of texts that are pre-tokenized on their own."""
        split = [self.pattern.findall(t) for t in missing]
        if len(self.of_pretoken) > CACHE_ENTRIES:
            self.of_pretoken.clear()
        known = self.of_pretoken
        new = list({p for s in split for p in s if p not in known})
        if new:
            known.update(zip(new, self.merger.counts([p.encode() for p in new]).tolist(), strict=True))
        return {t: sum(known[p] for p in s) for t, s in zip(missing, split, strict=True)}

    def plain(self, texts: Iterable[str]) -> list[int]:
        """Token counts of texts without special strings, a bounded number of characters at a time."""
        out: list[int] = []
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            if len(self.of_chunk) > CACHE_ENTRIES:
                self.of_chunk.clear()
            known = self.of_chunk
            seen: set[str] = set()
            for _, c in held:
                seen.update(c)
            missing = [c for c in seen if c not in known]
            for c, n in self.learn([" " + c for c in missing]).items():
                known[c[1:]] = n
            heads = self.learn(list({c[0] for _, c in held}))
            for k, c in held:
                out[k] += heads[c[0]] + sum(map(known.__getitem__, c)) - known[c[0]]
            held.clear()

        for text in texts:
            out.append(0)
            for piece in segments(text):
                held.append((len(out) - 1, chunks(piece)))
                size += len(piece)
                if size > BATCH_CHARS:
                    settle()
                    size = 0
        settle()
        return out

    def count(self, texts: list[str]) -> list[int]:
        if self.special is None:
            return self.plain(texts)
        parts, owner, extra = [], [], [0] * len(texts)
        for k, t in enumerate(texts):
            if self.special.search(t):
                cut = self.special.split(t)
                extra[k] = len(cut) - 1
                parts += cut
                owner += [k] * len(cut)
            else:
                parts.append(t)
                owner.append(k)
        for k, n in zip(owner, self.plain(parts), strict=True):
            extra[k] += n
        return extra


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """`keep` columns, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row, in one pass without a shuffle."""
    keep = passing(keep, ("n_bytes", "n_tokens", "over_limit"))
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(tokenizer)
        for b in batches:
            texts = b["__text"].tolist()
            out = b[list(keep)].copy()
            out["n_bytes"] = [len(t.encode()) for t in texts]
            out["n_tokens"] = c.count(texts)
            out["over_limit"] = out["n_tokens"] > limit
            yield out

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_bytes long, n_tokens long, over_limit boolean"
    return rows.mapInPandas(run, schema)
