"""Benchmark decontamination by winnowing.

Every k-gram of words is hashed; of each window of w consecutive k-grams the smallest hash is a fingerprint, on both
sides, with k + w - 1 = span, so any shared run of `span` words shares a fingerprint at the same place. Test
fingerprints lie in a sorted table whose size is bounded: items beyond it come in further blocks, each of which is
broadcast in turn and passed over the same documents. Where a document's fingerprint is found, the hit is extended:
every span of words around it is looked up among the items' spans and compared word by word.

An item of fewer words than `span`, but not none, is one span of its own length and is looked up at every position.
Null texts and texts without words have no hits; items with a null id are left out; repeated rows get repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.columns import passing
from tessella.llm.hashing import grams, hashes
from tessella.llm.text import ASCII_WORDS
from tessella.runtime import ship, small_batches

SPAN, GRAM = 10, 5
BLOCK_WORDS = 2_000_000


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the smallest of some window of consecutive hashes (of all, if there are fewer)."""
    if not len(g):
        return np.empty(0, np.int64)
    window = min(window, len(g))
    m = len(g) - window + 1
    low = g[:m].copy()
    for k in range(1, window):
        np.minimum(low, g[k : k + m], out=low)
    most = np.zeros(len(g), np.uint64)
    for k in range(window):
        np.maximum(most[k : k + m], low, out=most[k : k + m])
    return np.flatnonzero(most == g)


@dataclass
class Index:
    """Fingerprints and spans of a block of items. lengths: span length -> (sorted hashes, first place, items' bounds)."""

    span: int
    gram: int
    prints: np.ndarray
    flat: np.ndarray
    ids: list
    spans: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def build(cls, items: list[tuple[object, np.ndarray]], span: int, gram: int) -> "Index":
        flat = np.concatenate([h for _, h in items]) if items else np.empty(0, np.uint64)
        prints, places, base = [], {}, 0
        for k, (_, h) in enumerate(items):
            n = min(span, len(h))
            g = grams(h, n)
            places.setdefault(n, []).append((g, base + np.arange(len(g)), np.full(len(g), k)))
            if n == span:
                f = grams(h, gram)
                prints.append(f[winnow(f, span - gram + 1)])
            base += len(h)
        out = cls(span, gram, np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64), flat, [i for i, _ in items])
        for n, parts in places.items():
            g, at, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((owner, g))
            keys, first = np.unique(g[order], return_index=True)
            out.spans[n] = keys, at[order][first], np.r_[first, len(g)], owner[order]
        return out

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a span, and the ids of the items that have one."""
        hit = np.zeros(len(h) + 1, np.int32)
        found: set = set()
        for n, (keys, place, bounds, owner) in self.spans.items():
            if len(h) < n:
                continue
            if n == self.span:
                f = grams(h, self.gram)
                p = winnow(f, self.span - self.gram + 1)
                p = p[member(self.prints, f[p])]
                if not len(p):
                    continue
                starts = np.unique((p[:, None] - np.arange(self.span - self.gram + 1)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(h) - n)]
            else:
                starts = np.arange(len(h) - n + 1)
            g = grams(h, n)[starts]
            at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            same = keys[at] == g
            starts, at = starts[same], at[same]
            if len(starts):
                k = np.arange(n)
                same = (h[starts[:, None] + k] == self.flat[place[at][:, None] + k]).all(1)
                starts, at = starts[same], at[same]
                np.add.at(hit, starts, 1)
                np.add.at(hit, starts + n, -1)
                for a in np.unique(at):
                    found.update(self.ids[o] for o in np.unique(owner[bounds[a] : bounds[a + 1]]))
        return np.cumsum(hit)[:-1] > 0, found


def member(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Items in blocks of about `limit` words; the driver holds one block at a time."""
    held, size = [], 0
    for row in items.select(item_id, text).where(F.col(item_id).isNotNull()).toLocalIterator():
        h = hashes.of(row[1], ASCII_WORDS)
        if len(h):
            held.append((row[0], h))
            size += len(h)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """keep columns, n_words, spans (hit runs of words, end exclusive) and items (ids, sorted as strings) of each document."""
    keep = passing(keep, ("n_words", "spans", "items"))
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    kept = docs.select(*keep).schema.fields
    found = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])
    schema = T.StructType([*kept, T.StructField("__text", T.StringType()), *found.fields])
    df = docs.select(*keep, F.col(text).alias("__text"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(found["spans"].dataType).alias("spans"), F.lit(None).cast(found["items"].dataType).alias("items"))

    def step(held):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = held.value if held else None
            for b in batches:
                n, spans, ids = [], [], []
                for t, old_spans, old_ids in zip(b["__text"], b["spans"], b["items"], strict=True):
                    h = hashes.of(t if isinstance(t, str) else None, ASCII_WORDS)
                    hit, items_ = index.hits(h) if index else (np.zeros(len(h), bool), set())
                    if old_spans is not None:
                        for s in old_spans:
                            hit[s["start"] : s["end"]] = True
                        items_ |= set(old_ids)
                    n.append(len(h))
                    spans.append([{"start": s, "end": e} for s, e in runs(hit)])
                    ids.append(sorted(map(str, items_)))
                yield b.assign(n_words=np.array(n, np.int64), spans=spans, items=ids)

        return run

    some = False
    for block in blocks(items, item_id, item_text, block_words):
        df, some = df.mapInPandas(step(spark.sparkContext.broadcast(Index.build(block, span, gram))), schema), True
    return (df if some else df.mapInPandas(step(None), schema)).drop("__text")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
