"""Best-fit packing of token pieces into fixed-length sequences, planned on the histogram of lengths.

1. Each text becomes ids of a byte-level BPE file plus an end id; only longer ones are cut, the first piece short.
   Pieces leave the tokenizing task with a rank among the pieces of their length in that task.
2. Counts per (length, task) give each task's first rank per length by a running sum, and the histogram.
3. The plan is best-fit decreasing over counts: all pieces of one length are placed together into the group of open
   sequences with the least room that still fits. It has as many entries as groups were touched, which depends on
   the capacity, not on the number of documents, so its size on the driver and in the broadcast is bounded.
4. Pieces take their slot by looking up (length, rank) in the plan.

Null text counts as empty and gives the end id alone. Rows may repeat; every row is packed on its own. An empty table
gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm.columns import passing
from tessella.llm.text import segments
from tessella.llm.token_counts import PATTERN, byte_symbols
from tessella.runtime import materialize, ship, small_batches

CAPACITY = 2048
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of a byte-level BPE file whose ids follow the order of its merges."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        back = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes(back[c] for c in token): i for token, i in vocab.items()}
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        pattern = PATTERN.replace(r"\P{White_Space}", r"\S").replace(r"\p{White_Space}", r"\s")
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def ids(self, text: str) -> np.ndarray:
        parts = self.split.split(text) if self.split and self.split.search(text) else [text]
        out = [
            np.array([self.special[p]] if k % 2 else self.plain.encode_ordinary(s), "<u4")
            for k, p in enumerate(parts)
            for s in ([p] if k % 2 else segments(p))
        ]
        return np.concatenate(out)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, count, first sequence, offset) for every placement.

    Open sequences are groups (room -> runs of consecutive sequence numbers with equal contents)."""
    rooms: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    out, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                # The next sequences take as many of this length as fit; one last sequence may take fewer.
                each = capacity // length
                room, first, n = capacity, opened, max(1, left // each)
                opened += n
            take = min(n, left)
            out.append((length, rank, take, first, capacity - room))
            left, rank = left - take, rank + take
            put(room - length, first, take)
            if take < n:
                put(room, first + take, n - take)
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, text: str, keep: tuple[str, ...]) -> DataFrame:
    """One row per piece with its task and its rank among the task's pieces of that length."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            row, piece, start, length, crc, local = [], [], [], [], [], []
            for k, t in enumerate(b["__text"].tolist()):
                ids = np.append(enc.ids(t), np.array([end_id], "<u4")).astype("<u4")
                for p, (s, n) in enumerate(cuts(len(ids), capacity)):
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    local.append(seen[n])
                    seen[n] += 1
            out = b[list(keep)].iloc[row].reset_index(drop=True)
            yield out.assign(piece=np.array(piece, np.int32), start=np.array(start, np.int64), length=np.array(length, np.int64), ids_crc32=np.array(crc, np.int64), __task=np.int32(task), __local=np.array(local, np.int64))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return rows.mapInPandas(run, f"{kinds}, piece int, start long, length long, ids_crc32 long, __task int, __local long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row."""
    keep = passing(keep, ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "first"))
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    cut = materialize(pieces(docs, tokenizer, capacity, end_id, text, keep), "pieces")
    counts = cut.groupBy("length", "__task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 5)
    begin = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
    held = spark.sparkContext.broadcast((begin, slots[:, 1].copy(), slots[:, 3].copy(), slots[:, 4].copy()))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin, first, sequence, offset = held.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b["__rank"].to_numpy()
            at = np.empty(len(b), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = begin[n], begin[n + 1]
                at[own] = lo + np.searchsorted(first[lo:hi], rank[own], "right") - 1
            yield b.drop(columns="__rank").assign(sequence_id=sequence[at] + rank - first[at], offset=offset[at])

    ranked = cut.join(firsts.select("length", "__task", "first"), ["length", "__task"]).select(*keep, "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("__local")).alias("__rank"))
    schema = T.StructType([*ranked.drop("__rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInPandas(place, schema)
