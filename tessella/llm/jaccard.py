"""Exact Jaccard self-join of word-shingle sets by grouped prefixes, reported as connected components.

Statistics: every shingle's document frequency is counted over all documents. Tasks send, for each range of the hash
space, their sorted shingles as packed 32-bit remainders; each range keeps a bitmap segment of shingles met more than
once and the shingles met often. The bitmap and the list of frequent shingles are of bounded size; any order of
shingles gives the same result, so the bounds cost time at most, never a link.

Order: shingles met once come first, then rare ones by hash, then frequent ones by rising frequency. A document's
prefix is as long as its size and the threshold ask; only prefix shingles met more than once can give a partner.
Equal sets are one class; classes with equal prefix and size are one group.

Join: groups that share a prefix shingle are candidates if sizes and positions still allow the overlap. A first round
holds each shingle's groups against one of them and each group's classes against one of them, so a large family of
near copies joins along a star. A second round takes every candidate pair between classes that are not connected yet;
those of a shingle's main component are paired only with the others. Every pair is verified on the whole sets. No link
between different sets that would change a component is lost.

Null or word-less texts have no shingles and are linked with nothing. Rows with a null id take part; a component's id
is its least non-null id. Repeated rows are equal sets. Rows that share an id but not a text stay separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import passing
from tessella.llm.components import connected_components
from tessella.llm.hashing import grams, hashes
from tessella.llm.text import SPACE_WORDS
from tessella.runtime import materialize, shuffle_partitions, ship, small_batches

BITMAP_BITS = 27
FREQUENT = 1 << 20
OFTEN = 4
BLOCK = 1_000_000
LEAST_RANGES = 512


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; of the whole sequence where it is shorter."""
    h = hashes.of(text if isinstance(text, str) else None, SPACE_WORDS)
    return np.unique(grams(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def _ceil(a, b):
    return -(-a // b)


class Statistics:
    """What the whole corpus says about a shingle: met once, more than once, or often (with a class of frequency)."""

    def __init__(self, bits: int, bitmap: np.ndarray, often: np.ndarray, level: np.ndarray):
        self.bits, self.bitmap, self.often, self.level = bits, bitmap, often, level

    def classes(self, s: np.ndarray) -> np.ndarray:
        at = s >> np.uint64(64 - BITMAP_BITS)
        out = (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        some = np.flatnonzero(out)
        if len(self.often) and len(some):
            key = s[some] >> np.uint64(64 - self.bits)
            at = np.minimum(np.searchsorted(self.often, key), len(self.often) - 1)
            out[some] += np.where(self.often[at] == key, self.level[at], 0).astype(np.uint8)
        return out


def statistics(docs: DataFrame, n: int, text: str) -> Statistics:
    """Document frequencies of all shingles of all rows."""
    rows = docs.count()
    log_ranges = max(LEAST_RANGES, rows // 4000).bit_length() - 1
    bits = log_ranges + 32

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def block() -> pd.DataFrame:
            s, c = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
            cut = np.searchsorted(s >> np.uint64(32), np.arange((1 << log_ranges) + 1, dtype=np.uint64))
            low, many = s.astype(np.uint32), np.flatnonzero(c > 1)
            part = np.searchsorted(many, cut)
            own = np.flatnonzero(np.diff(cut))
            return pd.DataFrame({
                "range": own.astype(np.int32),
                "low": [low[cut[r] : cut[r + 1]].tobytes() for r in own],
                "at": [(many[part[r] : part[r + 1]] - cut[r]).astype(np.uint32).tobytes() for r in own],
                "n": [c[many[part[r] : part[r + 1]]].astype(np.uint32).tobytes() for r in own],
            })

        for b in batches:
            for t in b["t"]:
                held.append(shingles(t, n))
                size += len(held[-1])
                if size >= BLOCK:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        low = [np.frombuffer(x, np.uint32) for x in b["low"]]
        count = []
        for one, at, many in zip(low, b["at"], b["n"], strict=True):
            c = np.ones(len(one), np.int64)
            c[np.frombuffer(at, np.uint32)] = np.frombuffer(many, np.uint32)
            count.append(c)
        s, back = np.unique(np.concatenate(low), return_inverse=True)
        c = np.bincount(back, np.concatenate(count)).astype(np.int64)
        key = np.uint64(int(b["range"].iloc[0])) << np.uint64(32) | s.astype(np.uint64)
        bit = np.unique(key[c > 1] >> np.uint64(bits - BITMAP_BITS)) if bits > BITMAP_BITS else np.empty(0, np.uint64)
        often = c >= OFTEN
        level = np.floor(2 * np.log2(np.maximum(c[often], 1))).astype(np.uint8)
        sizes = np.bincount(level, minlength=128)
        return pd.DataFrame({"bit": [(bit).astype(np.uint32).tobytes()], "often": [key[often].tobytes()], "level": [level.tobytes()], "sizes": [sizes.tolist()]})

    sent = docs.select(F.col(text).alias("t")).mapInPandas(send, "range int, low binary, at binary, n binary")
    found = materialize(sent.groupBy("range").applyInPandas(gather, "bit binary, often binary, level binary, sizes array<long>"), "frequencies")
    sizes = np.zeros(128, np.int64)
    for r in found.select(F.posexplode("sizes").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect():
        sizes[r["level"]] = r["n"]
    kept = np.flatnonzero(np.cumsum(sizes[::-1])[::-1] <= FREQUENT)
    least = int(kept[0]) if len(kept) else 127

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's bits as (byte, value) and its frequent shingles."""
        for b in batches:
            bit = np.concatenate([np.frombuffer(x, np.uint32) for x in b["bit"]] or [np.empty(0, np.uint32)])
            often = np.concatenate([np.frombuffer(x, np.uint64) for x in b["often"]])
            level = np.concatenate([np.frombuffer(x, np.uint8) for x in b["level"]])
            keep = level >= least
            byte, back = np.unique(bit >> 3, return_inverse=True)
            value = np.zeros(len(byte), np.uint8)
            np.bitwise_or.at(value, back, (1 << (bit & 7)).astype(np.uint8))
            yield pd.DataFrame({"byte": [byte.astype(np.uint32).tobytes()], "value": [value.tobytes()], "often": [often[keep].tobytes()], "level": [level[keep].tobytes()]})

    bitmap, often, level = np.zeros(1 << BITMAP_BITS - 3, np.uint8), [], []
    for r in found.drop("sizes").mapInPandas(narrow, "byte binary, value binary, often binary, level binary").toLocalIterator():
        byte = np.frombuffer(r["byte"], np.uint32)
        bitmap[byte] |= np.frombuffer(r["value"], np.uint8)
        often.append(np.frombuffer(r["often"], np.uint64))
        level.append(np.frombuffer(r["level"], np.uint8))
    often, level = (np.concatenate(x) if x else np.empty(0, k) for x, k in ((often, np.uint64), (level, np.uint8)))
    order = np.argsort(often, kind="stable")
    return Statistics(bits, bitmap, often[order], level[order])


def prefixes(docs: DataFrame, held, n: int, num: int, den: int, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Per row: size, signature of the set, key of prefix and size, prefix shingles that others have, and the set if there are any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stats = held.value
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            out = {k: [] for k in ("n", "s1", "s2", "gkey", "token", "pos", "set")}
            sets = [shingles(t, n) for t in b["__text"]]
            sizes = [len(s) for s in sets]
            kinds = np.split(stats.classes(np.concatenate(sets)), np.cumsum(sizes)[:-1])
            for s, kind, size in zip(sets, kinds, sizes, strict=True):
                p = size - _ceil(num * size, den) + 1 if size else 0
                if kind.any():
                    order = np.argsort(kind, kind="stable")[:p]
                    prefix, shared = s[order], np.flatnonzero(kind[order])
                else:
                    prefix, shared = s[:p], np.empty(0, np.int64)
                raw = s.tobytes()
                sig = xxhash.xxh3_128_intdigest(raw)
                out["n"].append(size)
                out["s1"].append((sig >> 64) - (1 << 63))
                out["s2"].append((sig & ((1 << 64) - 1)) - (1 << 63))
                out["gkey"].append(xxhash.xxh3_64_intdigest(prefix.tobytes(), size) - (1 << 63))
                out["token"].append(prefix[shared].view(np.int64))
                out["pos"].append(shared.astype(np.int32))
                out["set"].append(raw if len(shared) else None)
            rest = b.drop(columns="__text")
            yield rest.assign(uid=uid + np.arange(len(b)), **out)
            uid += len(b)

    rows = docs.select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return rows.mapInPandas(run, f"{kinds}, uid long, n int, s1 long, s2 long, gkey long, token array<long>, pos array<int>, set binary")


def _possible(a: str, b: str, num: int, den: int):
    """Sizes and positions of a shared prefix shingle still allow the overlap; the smaller set's shingle is in its shorter prefix."""
    na, nb, pa, pb = (F.col(x).cast("long") for x in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    small, small_pos = F.when(na <= nb, na).otherwise(nb), F.when(na < nb, pa).when(na > nb, pb).otherwise(F.least(pa, pb))
    return (
        (F.least(na, nb) * den >= F.greatest(na, nb) * num)
        & ((1 + F.least(na - pa - 1, nb - pb - 1)) * (den + num) >= (na + nb) * num)
        & (small_pos * (den + num) <= small * (den - num) + (den + num))
    )


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for x, y in zip(b["sa"], b["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * common >= num * (len(x) + len(y) - common))
            yield b.loc[ok, ["a", "b"]]

    full = pairs.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("uid").alias("b"), F.col("set").alias("sb")), "b")
    return full.mapInPandas(run, "a long, b long")


def jaccard_components(docs: DataFrame, shingle_words: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, extra columns, n_shingles and component_id of every row; links where den * |A & B| >= num * |A | B|."""
    extra = passing(extra, ("n_shingles", "component_id"))
    own, names = (doc_id, *extra), [f"__k{i}" for i in range(len(extra))]
    docs = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__body"), *[F.col(c).alias(n) for c, n in zip(extra, names, strict=True)])
    extra, text, doc_id = tuple(names), "__body", "__id"
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    stats = statistics(docs, shingle_words, text)
    held = spark.sparkContext.broadcast(stats)
    rows = materialize(prefixes(docs, held, shingle_words, num, den, text, (doc_id, *extra)), "prefixes")

    some = rows.where("n > 0")
    classes = some.groupBy("s1", "s2").agg(F.min("uid").alias("uid"), F.min(doc_id).alias("least"), F.min("n").alias("n"), F.min("gkey").alias("gkey"), F.max(F.size("token")).alias("shared"))
    classes = materialize(classes, "classes")
    # Only classes with shared prefix shingles can have partners.
    live = classes.where("shared > 0")
    groups = live.groupBy("gkey", "n").agg(F.min("uid").alias("head"), F.count(F.lit(1)).alias("members"))
    tokens = materialize(
        rows.select("uid", "n", "token", "pos").join(groups.select(F.col("head").alias("uid")), "uid").select("uid", "n", F.inline(F.arrays_zip("token", "pos"))).select("uid", "n", F.col("token"), F.col("pos")),
        "tokens",
    )
    repeated = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = materialize(tokens.join(repeated.select("token"), "token"), "lists")
    members = live.select(F.col("uid"), "n", "gkey").join(groups.where("members > 1").select("gkey", "n", "head"), ["gkey", "n"]).select("uid", "head")
    # Sets of classes only, not of their copies.
    sets = rows.where(F.col("set").isNotNull()).select("uid", "set").join(live.select("uid"), "uid")

    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    pivots = lists.groupBy("token").agg(F.min("uid").alias("uid"), F.min_by(F.struct("n", "pos"), "uid").alias("p")).select("token", "uid", "p.n", "p.pos")
    star = lists.alias("x").join(pivots.alias("y"), "token").where((F.col("x.uid") != F.col("y.uid")) & _possible("x", "y", num, den)).select(*pair("x.uid", "y.uid"))
    within = members.where("uid <> head").select(*pair("uid", "head"))
    first = materialize(_verified(star.union(within).distinct(), sets, num, den), "links")
    known = materialize(connected_components(first), "known")

    # Second round: what is not connected yet.
    label = lambda d: d.join(known.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    all_members = materialize(label(members), "members")
    mixed = all_members.groupBy("head").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(F.col("head").alias("uid"), F.lit(True).alias("mixed"))
    seen = materialize(label(lists).join(mixed, "uid", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False))), "seen")
    by = seen.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"), F.max("mixed").alias("mixed"))
    main = by.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.max("mixed").alias("mixed")).where("parts > 1 or mixed").select("token", "main")
    open_lists = seen.join(main, "token")
    apart = (F.col("x.component") != F.col("y.component")) | F.col("x.mixed") | F.col("y.mixed")
    heads = open_lists.where("component <> main or mixed").alias("x").join(open_lists.alias("y"), "token").where((F.col("x.uid") != F.col("y.uid")) & apart & _possible("x", "y", num, den)).select(*pair("x.uid", "y.uid")).distinct()
    heads = materialize(heads, "heads")
    # Expand groups to their classes; a head that stands alone is its own member.
    full = all_members.select("head", "uid", "component")
    expand = lambda d, c: d.join(full.select(F.col("head").alias(c), F.col("uid").alias(f"{c}m")), c, "left").withColumn(c, F.coalesce(f"{c}m", c)).drop(f"{c}m")
    across = expand(expand(heads, "a"), "b")
    same = full.join(mixed.select(F.col("uid").alias("head")), "head")
    largest = same.groupBy("head", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("head").agg(F.max_by("component", F.struct("k", "component")).alias("main"))
    inside = same.join(largest, "head").where("component <> main").alias("x").join(same.alias("y"), "head").where("x.component <> y.component").select(*pair("x.uid", "y.uid"))
    comp = known.select(F.col("node"), F.col("component"))
    tag = lambda d, c: d.join(comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    rest = tag(tag(across.select(*pair("a", "b")).union(inside).distinct(), "a"), "b").where("ca <> cb").select("a", "b")
    second = materialize(_verified(rest, sets, num, den), "links")
    labels = connected_components(first.union(second)).withColumnRenamed("node", "uid")

    named = classes.select("s1", "s2", "uid", "least").join(labels, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    named = materialize(named, "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = rows.select(doc_id, *extra, F.col("n").cast("long").alias("n_shingles"), "s1", "s2").join(named.join(ids, "component").select("s1", "s2", "component_id"), ["s1", "s2"], "left")
    return out.select(*[F.col(n).alias(c) for c, n in zip(own, (doc_id, *extra), strict=True)], "n_shingles", F.coalesce("component_id", doc_id).alias("component_id"))
