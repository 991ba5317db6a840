"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, the
first rotated by two places, the second by one; a text's vector bundles (adds) the vectors of its trigrams. A
language's prototype is the sum of the unit vectors of its labelled texts; a text goes to the prototype with the
largest cosine. Letters are lower-cased; everything that is no letter is one boundary symbol.

Texts that are null or have no letter are `und` with score 0. Learning takes an expected `max_train` rows a language,
chosen by a hash of the row's key (a documented bound); prediction covers every row. Ties go to the first language in
string order. Without any labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import passing
from tessella.llm.text import segments
from tessella.runtime import ship, small_batches

DIMENSIONS = 512
CLASSES = 128
SEED = 20240229
MAX_TRAIN = 4000
MAX_LANGUAGES = 4096
GROUP_DOCS, GROUP_CHARS = 128, 1 << 20
UNDETERMINED = "und"
_spaces: dict[tuple[int, int], "Space"] = {}


def letter_classes() -> np.ndarray:
    """Class of each code point: 0 no letter, 1-26 for a-z, hashed classes for all other letters."""
    cp = np.arange(0x110000, dtype=np.uint64)
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    other = 27 + ((cp * np.uint64(2654435761)) % np.uint64(1 << 32) >> np.uint64(11)) % np.uint64(CLASSES - 27)
    out = np.where(alpha, other, 0).astype(np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


class Space:
    """Letter vectors, and the trigram vectors met so far."""

    def __init__(self, dimensions: int, seed: int):
        letters = np.random.default_rng(seed).integers(0, 2, (CLASSES, dimensions), np.int8) * 2 - 1
        self.first, self.second, self.third = np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
        self.classes = letter_classes()
        self.row = np.full(CLASSES**3, -1, np.int32)
        self.vectors = np.empty((0, dimensions), np.float32)

    def rows(self, trigrams: np.ndarray) -> np.ndarray:
        """Row of each trigram in `vectors`, binding those not met before."""
        new = np.unique(trigrams[self.row[trigrams] < 0])
        if len(new):
            if len(self.vectors) + len(new) > 60_000:
                self.row[:] = -1
                self.vectors = self.vectors[:0]
                new = np.unique(trigrams)
            bound = self.first[new >> 14] * self.second[new >> 7 & 127] * self.third[new & 127]
            self.row[new] = len(self.vectors) + np.arange(len(new))
            self.vectors = np.concatenate([self.vectors, bound.astype(np.float32)])
        return self.row[trigrams]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """A vector for each text; all zero where there is no letter."""
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.classes[code].astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        stay = np.r_[True, (sym[1:] > 0) | (sym[:-1] > 0)]
        sym, owner = np.r_[0, sym[stay], 0], np.r_[0, owner[stay], 0]
        at = np.flatnonzero(sym)
        if not len(at):
            return np.zeros((len(texts), self.vectors.shape[1]), np.float32)
        row = self.rows(sym[at - 1] << 14 | sym[at] << 7 | sym[at + 1])
        n = len(self.vectors)
        counts = np.bincount(owner[at] * n + row, minlength=len(texts) * n).reshape(len(texts), n)
        return counts.astype(np.float32) @ self.vectors

    def unit(self, texts: list[str | None]) -> Iterator[tuple[slice, np.ndarray]]:
        """Unit vectors (or zero) of the texts, a bounded group at a time."""
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and end - start < GROUP_DOCS and (end == start or size + len(texts[end] or "") <= GROUP_CHARS):
                size += len(texts[end] or "")
                end += 1
            if size > GROUP_CHARS:
                v = sum(self.bundle([s.lower()]) for s in segments(texts[start] or ""))
            else:
                v = self.bundle([(t or "").lower() for t in texts[start:end]])
            norm = np.sqrt((v.astype(np.float64) ** 2).sum(1, keepdims=True))
            yield slice(start, end), v / np.where(norm > 0, norm, 1)
            start = end


def space(dimensions: int, seed: int) -> Space:
    if (dimensions, seed) not in _spaces:
        _spaces[dimensions, seed] = Space(dimensions, seed)
    return _spaces[dimensions, seed]


def learn(rows: DataFrame, label: str = "lang", text: str = "text", key: str = "doc_id", dimensions: int = DIMENSIONS, seed: int = SEED, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Languages in string order and their unit prototypes, from rows with a label and a text."""
    spark = rows.sparkSession
    ship(spark)
    small_batches(spark)
    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} distinct labels")
    if not sizes:
        return [], np.zeros((0, dimensions))
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_train / n))])
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(draw < rate[F.col(label)]).select(F.col(label).alias("label"), F.col(text).alias("text"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, total = space(dimensions, seed), {}
        for b in batches:
            labels = b["label"].to_numpy()
            for part, unit in s.unit(b["text"].tolist()):
                for one in set(labels[part]):
                    total[one] = total.get(one, 0) + unit[labels[part] == one].sum(0, dtype=np.float64)
        for one, v in total.items():
            yield pd.DataFrame({"label": one, "at": np.arange(dimensions, dtype=np.int32), "v": v})

    sums = chosen.mapInPandas(partial, "label string, at int, v double").groupBy("label", "at").agg(F.sum(F.round("v", 9).cast("decimal(30,9)")).cast("double").alias("v"))
    out = {k: np.zeros(dimensions) for k in sorted(sizes)}
    for r in sums.collect():  # languages x dimensions
        out[r["label"]][r["at"]] = r["v"]
    p = np.array(list(out.values()))
    return list(out), p / np.maximum(np.sqrt((p**2).sum(1, keepdims=True)), 1e-12)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",), dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """keep columns, lang_pred and score (cosine, 0 to 1), in one pass."""
    keep = passing(keep, ("lang_pred", "score"))
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    names, prototypes = model
    rows = docs.select(*keep, F.col(text).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = space(dimensions, seed)
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["__text"]]
            best, score = np.full(len(b), UNDETERMINED, object), np.zeros(len(b))
            for part, unit in s.unit(texts):
                some = unit.any(1)
                if names and some.any():
                    cosine = unit.astype(np.float64) @ prototypes.T
                    at = cosine.argmax(1)
                    best[part] = np.where(some, np.array(names, object)[at], UNDETERMINED)
                    score[part] = np.where(some, np.clip(cosine[np.arange(len(at)), at], 0, 1), 0)
            yield b[list(keep)].assign(lang_pred=best, score=score)

    return rows.mapInPandas(run, f"{kinds}, lang_pred string, score double")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def identify(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", label: str = "lang") -> DataFrame:
    """keep, held_out, lang_pred and score of all documents, from prototypes of the rows outside fold 2."""
    held = F.coalesce(fold(F.col(doc_id)) == 2, F.lit(False))
    model = learn(docs.where(~held), label, text, doc_id)
    keep = passing(keep, ("held_out", "lang_pred", "score"))
    rows = docs.select(*keep, F.col(text).alias("__raw"), held.alias("held_out"))
    return predict(rows, model, text="__raw", keep=(*keep, "held_out"))
