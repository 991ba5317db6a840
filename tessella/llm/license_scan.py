"""Licence scan: runs of lines compared with licence templates by the Dice coefficient over word bigrams.

Text and templates are normalised alike: A-Z lower-cased, words are runs of letters, digits and non-ASCII characters.
A run of consecutive lines (a single line, several, or the whole text) with a bigrams is compared with a template of b
bigrams; counts matter, so Dice is 2 * sum(min(counts)) / (a + b). Size bounds: Dice >= t needs
b * t / (2 - t) <= a <= b * (2 - t) / t, so for each first line only last lines in that range are candidates; of those,
only runs with enough bigrams that occur in the template are compared in full. Of overlapping runs the best stays, by
Dice, then the larger template, then fewer lines, then template order, then place.

A statement or a whole text can share its lines with other words, so windows of the words outside those runs are compared
in the same way. A window begins at the start of a line or sentence or at the template's first word and ends at the end of
a line or sentence or at the template's last word; so other words before and after it do not count, but a changed first or
last word does. Of overlapping windows the best stays, by Dice, then more words, then template order, then place; a match
names the lines of its first and last word.

Null, empty and word-less texts have no matches. Repeated rows get repeated results. Line numbers start at 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import passing
from tessella.llm.license_texts import TEMPLATES
from tessella.llm.text import ASCII_WORDS, words
from tessella.runtime import ship, small_batches

THRESHOLD = 0.8
SENTENCE = re.compile(r"[.;:!?](?=\s)|\n")


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.names, self.threshold = list(templates), threshold
        lists = [words(t, ASCII_WORDS) for t in templates.values()]
        self.word = {w: k for k, w in enumerate(sorted({w for ws in lists for w in ws}))}
        self.v = len(self.word)
        self.bigrams = [Counter(self.codes(np.array([self.word[w] for w in ws], np.int64)).tolist()) for ws in lists]
        self.known = np.array(sorted({b for c in self.bigrams for b in c}), np.int64)
        self.has = np.array([[b in c for b in self.known.tolist()] for c in self.bigrams])
        self.sizes = [sum(c.values()) for c in self.bigrams]
        self.ends = [(self.word[ws[0]], self.word[ws[-1]]) for ws in lists]

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Code of each adjacent pair of words; -1 where a word is in no template."""
        a, b = ids[:-1], ids[1:]
        return np.where((a >= 0) & (b >= 0), a * self.v + b, -1)

    def scan(self, text: str | None) -> list[dict]:
        if not text:
            return []
        per_line = [words(line, ASCII_WORDS) for line in text.split("\n")]
        get = self.word.get
        ids = np.fromiter((get(w, -1) for ws in per_line for w in ws), np.int64)
        codes = self.codes(ids)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        real = self.known[at] == codes
        if not real.any():
            return []
        end = np.cumsum([len(ws) for ws in per_line])
        start = np.r_[0, end[:-1]]
        found = []
        for k, name in enumerate(self.names):
            hit = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(real & self.has[k][at], out=hit[1:])
            b, t = self.sizes[k], self.threshold
            if hit[-1] < t * b / 2:
                continue
            low, high = b * t / (2 - t), b * (2 - t) / t
            inside = hit[np.minimum(end, len(codes))] - hit[np.minimum(start, len(codes))]
            for i in np.flatnonzero(inside > 0):
                # Bigrams of the run of lines i..j: words in it less one.
                lo = np.searchsorted(end, start[i] + low + 1 - 1e-9, "left")
                hi = np.searchsorted(end, start[i] + high + 1 + 1e-9, "right")
                j = np.arange(max(lo, i), hi)
                if not len(j):
                    continue
                size = end[j] - start[i] - 1
                enough = 2 * (hit[end[j] - 1] - hit[start[i]]) >= t * (size + b) - 1e-9
                for last, a in zip(j[enough].tolist(), size[enough].tolist(), strict=True):
                    mine = Counter(codes[start[i] : end[last] - 1][real[start[i] : end[last] - 1]].tolist())
                    dice = 2 * sum(min(n, self.bigrams[k][c]) for c, n in mine.items() if c in self.bigrams[k]) / (a + b)
                    if dice >= t:
                        found.append((-dice, -b, last - int(i), k, int(i), name, last))
        taken, out = np.zeros(len(ids), bool), []
        for dice, _, _, _, first, name, last in sorted(found):
            if not taken[start[first] : end[last]].any():
                taken[start[first] : end[last]] = True
                out.append((int(start[first]), {"template": name, "dice": -dice, "first_line": first, "last_line": last}))
        for dice, n, _, i, name in sorted(self.windows(text, ids, codes, at, real, taken)):
            if not taken[i : i - n + 1].any():
                taken[i : i - n + 1] = True
                first, last = np.searchsorted(end, [i, i - n], "right").tolist()
                out.append((i, {"template": name, "dice": -dice, "first_line": first, "last_line": last}))
        return [m for _, m in sorted(out, key=lambda x: x[0])]

    def windows(self, text: str, ids: np.ndarray, codes: np.ndarray, at: np.ndarray, real: np.ndarray, taken: np.ndarray) -> list[tuple]:
        """(-dice, -bigrams, template's place, first word, template) of windows of words not taken."""
        bound = np.zeros(len(ids) + 1, bool)
        bound[np.cumsum([0, *(len(words(part, ASCII_WORDS)) for part in SENTENCE.split(text))])] = True
        free = ~(taken[:-1] | taken[1:])
        stop = np.r_[np.flatnonzero(~free), len(free)]
        found = []
        for k, name in enumerate(self.names):
            hit = np.r_[0, np.cumsum(free & real & self.has[k][at])]
            b, t, mine = self.sizes[k], self.threshold, self.bigrams[k]
            # Dice >= t needs that many bigrams of the template, which is the least size of a window, too.
            low, high = b * t / (2 - t) - 1e-9, int(b * (2 - t) / t + 1e-9)
            if hit[-1] < low:
                continue
            first = np.flatnonzero(bound[:-2] | (ids[:-1] == self.ends[k][0]))
            first = first[hit[np.minimum(first + high, len(codes))] - hit[first] >= low]
            last = bound[2:] | (ids[1:] == self.ends[k][1])
            for i in first.tolist():
                left, same = dict(mine), 0
                upto = min(i + high, int(stop[np.searchsorted(stop, i)]))
                for n, (c, ok) in enumerate(zip(codes[i:upto].tolist(), last[i:upto].tolist(), strict=True), 1):
                    if left.get(c):
                        left[c] -= 1
                        same += 1
                    if ok and 2 * same >= t * (n + b) - 1e-9 and (dice := 2 * same / (n + b)) >= t:
                        found.append((-dice, -n, k, i, name))
        return found


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """keep columns, matches (template, dice, first_line, last_line), and the best match's license and dice (null without)."""
    keep = passing(keep, ("matches", "license", "dice"))
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    chosen = templates or TEMPLATES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(chosen, threshold)
        for b in batches:
            yield b[list(keep)].assign(matches=[scanner.scan(t if isinstance(t, str) else None) for t in b["__text"]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    rows = docs.select(*keep, F.col(text).alias("__text")).mapInPandas(run, f"{kinds}, matches array<struct<template: string, dice: double, first_line: int, last_line: int>>")
    best = F.get(F.sort_array(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["first_line"].alias("l"), m["template"].alias("t")))), F.lit(0))
    return rows.select("*", best["t"].alias("license"), (-best["d"]).alias("dice"))
