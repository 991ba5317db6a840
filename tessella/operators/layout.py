"""Index, box and tile algebra: on Python integers for planning, and as Columns for data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.operators.section import Range


def size(shape: list[int]) -> int:
    out = 1
    for n in shape:
        out *= n
    return out


def strides(shape: list[int]) -> list[int]:
    """Elements between neighbours along each dimension, the last one fastest."""
    out = [1] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        out[k] = out[k + 1] * shape[k + 1]
    return out


def same_shape(a: list[int], b: list[int]) -> bool:
    """Equal shapes; [], [0] and [1] are all scalar."""
    scalar = lambda s: list(s) in ([], [0], [1])
    return list(a) == list(b) or scalar(a) and scalar(b)


def element(shape: list[int], prefix: str = "d") -> Column:
    """Row-major element number of index columns."""
    return sum((F.col(f"{prefix}{k}").cast("long") * s for k, s in enumerate(strides(shape))), F.lit(0).cast("long"))


def unravel(elem: Column | str, shape: list[int]) -> list[Column]:
    """Index columns of an element number."""
    e = F.col(elem) if isinstance(elem, str) else elem
    return [(F.floor(e / s) % n).cast("long").alias(f"d{k}") for k, (s, n) in enumerate(zip(strides(shape), shape, strict=True))]


def tile_of(d: Column | str, chunk: int) -> Column:
    return F.floor((F.col(d) if isinstance(d, str) else d) / chunk).cast("long")


def shape_size(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, n: a * n)


def shape_strides(shape: Column) -> Column:
    """Strides of a shape column, by a running product from the last dimension."""
    rest = F.slice(F.reverse(shape), 1, F.size(shape) - 1)
    return F.reverse(F.aggregate(rest, F.array(F.lit(1).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) * n))))


def box_contains(a_start: Column, a_shape: Column, b_start: Column, b_shape: Column) -> Column:
    """Box a holds all of box b."""
    ends = F.zip_with(F.zip_with(a_start, a_shape, lambda s, n: s + n), F.zip_with(b_start, b_shape, lambda s, n: s + n), lambda x, y: x >= y)
    return F.forall(F.zip_with(a_start, b_start, lambda x, y: x <= y), lambda v: v) & F.forall(ends, lambda v: v)


def box_intersect(a_start: Column, a_shape: Column, b_start: Column, b_shape: Column) -> tuple[Column, Column]:
    """Start and shape of the common box; a length of zero or less means there is none."""
    start = F.zip_with(a_start, b_start, lambda x, y: F.greatest(x, y))
    last = F.zip_with(F.zip_with(a_start, a_shape, lambda s, n: s + n - 1), F.zip_with(b_start, b_shape, lambda s, n: s + n - 1), lambda x, y: F.least(x, y))
    return start, F.zip_with(start, last, lambda s, e: e - s + 1)


def box_intersects(a_start: Column, a_shape: Column, b_start: Column, b_shape: Column) -> Column:
    return F.forall(box_intersect(a_start, a_shape, b_start, b_shape)[1], lambda n: n > 0)


@dataclass(frozen=True)
class Tiling:
    """Storage tiles of a variable. A chunk may carry a trailing element size, which is ignored."""

    shape: tuple[int, ...]
    chunk: tuple[int, ...]

    def tile_shape(self) -> list[int]:
        return [-(-max(n, c) // c) for n, c in zip(self.shape, self.chunk, strict=False)]

    def tile(self, index: list[int]) -> list[int]:
        return [i // c for i, c in zip(index, self.chunk, strict=False)]

    def index(self, tile: list[int]) -> list[int]:
        return [t * c for t, c in zip(tile, self.chunk, strict=False)]

    def order(self, index: list[int]) -> int:
        return sum(t * s for t, s in zip(self.tile(index), strides(self.tile_shape()), strict=True))

    def cover(self, section: list[Range]) -> list[Range]:
        return [Range(r.start // c, r.last // c) for r, c in zip(section, self.chunk, strict=False)]

    def tile_cols(self, prefix: str = "d") -> list[Column]:
        return [tile_of(f"{prefix}{k}", c).alias(f"t{k}") for k, c in enumerate(self.chunk[: len(self.shape)])]

    def order_col(self, prefix: str = "d") -> Column:
        return sum((tile_of(f"{prefix}{k}", c) * s for k, (c, s) in enumerate(zip(self.chunk, strides(self.tile_shape()), strict=False))), F.lit(0).cast("long"))


def transfers(have: list[Range], want: list[Range], merge: str = "all") -> list[tuple[int, int, int]]:
    """(source element, elements, destination element) of the copies from a dense box into another.

    Inner dimensions that the overlap fills in both boxes are moved together: all of them, none, or all but the first."""
    common = [Range(max(a.start, b.start), min(a.last, b.last)) for a, b in zip(have, want, strict=True)]
    if not all(len(r) for r in common):
        return []
    a, b, c = ([len(r) for r in box] for box in (have, want, common))
    inner, k, least = 1, len(c), 1 if merge == "notFirst" else 0
    while k > least:
        k -= 1
        inner *= c[k]
        whole = c[k] == a[k] == b[k]
        if not whole or merge == "none":
            break
    outer = [np.arange(n) for n in c[:k]]
    at = np.stack(np.meshgrid(*outer, indexing="ij"), -1).reshape(-1, k) if k else np.zeros((1, 0), int)

    def places(box: list[Range], shape: list[int]) -> np.ndarray:
        s = strides(shape)
        base = sum((r.start - o.start) * w for r, o, w in zip(common, box, s, strict=True))
        return base + at @ np.array(s[:k], int) if k else np.array([base])

    return [(int(x), inner, int(y)) for x, y in zip(places(have, a), places(want, b), strict=True)]


def max_chunks(section: list[Range], max_elems: int = 100_000) -> Iterator[list[Range]]:
    """Boxes of at most max_elems elements that cover the section in order; the last dimension stays whole."""
    shape = [len(r) for r in section]
    if not size(shape):
        return
    s = strides(shape)
    step = [shape[k] if k == len(shape) - 1 else max(1, min(shape[k], max_elems // s[k])) for k in range(len(shape))]
    # A dimension is cut only if everything inside it is whole.
    for k in range(len(shape) - 1):
        if any(step[j] < shape[j] for j in range(k + 1, len(shape))):
            step[k] = 1
    counts = [-(-n // w) for n, w in zip(shape, step, strict=True)]
    for number in range(size(counts)):
        place = [number // w % n for w, n in zip(strides(counts), counts, strict=True)]
        yield [Range(r.start + p * w, min(r.start + p * w + w - 1, r.last)) for r, p, w in zip(section, place, step, strict=True)]
