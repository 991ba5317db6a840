"""Hyperslab sections: parsing, filling, checking and turning into predicates on index columns d0..dn-1.

A section has one inclusive range per dimension; None stands for the whole dimension. A single index keeps its
dimension with length 1. Strides are honoured unless `compat` is asked for, which reads as if they were 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InvalidRange(ValueError):
    """A section that does not fit its variable."""


@dataclass(frozen=True)
class Range:
    start: int
    last: int
    step: int = 1

    def __len__(self) -> int:
        return (self.last - self.start) // self.step + 1 if self.last >= self.start else 0


def parse(spec: str) -> list[Range | None]:
    """Ranges of a text like "(1:20,:,3,10:20:2)"; parentheses are optional and ends inclusive."""
    out: list[Range | None] = []
    for part in spec.strip().removeprefix("(").removesuffix(")").split(","):
        part = part.strip()
        if part == ":":
            out.append(None)
            continue
        fields = part.split(":")
        try:
            numbers = [int(f) for f in fields]
        except ValueError:
            raise ValueError(f"illegal selector: {part}") from None
        if len(numbers) > 3 or len(numbers) == 3 and numbers[2] <= 0:
            raise ValueError(f"illegal selector: {part}")
        out.append(Range(numbers[0], numbers[1] if len(numbers) > 1 else numbers[0], numbers[2] if len(numbers) == 3 else 1))
    return out


def fill(section: list[Range | None] | str | None, shape: list[int]) -> list[Range]:
    """A full section for the shape; checks rank and bounds."""
    if isinstance(section, str):
        section = parse(section)
    if not shape:
        if section:
            raise InvalidRange(f"rank {len(section)} does not match a scalar")
        return [Range(0, 0)]
    section = section or [None] * len(shape)
    if len(section) != len(shape):
        raise InvalidRange(f"section rank {len(section)} does not match rank {len(shape)}")
    out = []
    for k, (r, n) in enumerate(zip(section, shape, strict=True)):
        r = Range(0, n - 1) if r is None else r
        if n and (r.start < 0 or r.last < r.start or r.last >= n) or not n and len(r):
            raise InvalidRange(f"dimension {k}: range {r.start}:{r.last} is outside 0:{n - 1}")
        out.append(r)
    return out


def shape_of(section: list[Range], compat: bool = False) -> list[int]:
    return [r.last - r.start + 1 if compat and len(r) else len(r) for r in section]


def predicate(section: list[Range], prefix: str = "d", compat: bool = False) -> Column:
    """Which cells the section has. Ranges on plain columns reach a scan as pushed filters."""
    out = F.lit(True)
    for k, r in enumerate(section):
        d = F.col(f"{prefix}{k}")
        out = out & ((d == r.start) if r.start == r.last else d.between(r.start, r.last))
        if r.step > 1 and not compat:
            out = out & ((d - r.start) % r.step == 0)
    return out


def section_cells(cells: DataFrame, section: list[Range | None] | str | None, shape: list[int], rebase: bool = False, compat: bool = False) -> DataFrame:
    """Cells inside a section, with indices of the variable or (rebase) of the section."""
    full = fill(section, shape)
    out = cells.where(predicate(full, compat=compat))
    if rebase:
        for k, r in enumerate(full):
            step = 1 if compat else r.step
            out = out.withColumn(f"d{k}", F.expr(f"(d{k} - {r.start}) div {step}"))
    return out


def middle(shape: list[int], max_bytes: int = 10_000_000, elem_size: int = 8) -> list[Range]:
    """The middle third of every dimension of at least 9, again and again until it is small enough."""
    out = [Range(0, n - 1) for n in shape]
    while True:
        new = [r if len(r) < 9 else Range(r.start + len(r) // 3, r.last - len(r) // 3) for r in out]
        size = elem_size
        for r in new:
            size *= len(r)
        if size <= max_bytes or new == out:
            return new
        out = new
