"""Dense HDF5 storage: records of version 2 B-trees and managed objects of fractal heaps."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

At = Callable[[int, int], bytes]
UNDEFINED = (1 << 64) - 1


def _bytes_for(n: int) -> int:
    """Bytes that hold numbers up to n."""
    return max(1, (n.bit_length() + 7) // 8)


def btree2_records(at: At, address: int) -> Iterator[bytes]:
    """All records in order."""
    magic, _, kind, node, size, depth = struct.unpack("<4sBBIHH", at(address, 14))
    if magic != b"BTHD":
        raise ValueError("no version 2 B-tree")
    root, count = struct.unpack("<QH", at(address + 16, 10))
    if root == UNDEFINED or not count:
        return
    # How many records fit in a leaf, and in the subtrees at each depth, sets the width of the counters.
    leaf = (node - 10) // size
    width, most, total = _bytes_for(leaf), [leaf], [leaf]
    for d in range(1, depth + 1):
        pointer = 8 + width + (_bytes_for(total[d - 1]) if d > 1 else 0)
        most.append((node - 10 - pointer) // (size + pointer))
        total.append(most[d] + (most[d] + 1) * total[d - 1])

    def walk(place: int, n: int, d: int) -> Iterator[bytes]:
        body = at(place + 6, n * size)
        records = [body[k * size : (k + 1) * size] for k in range(n)]
        if d == 0:
            yield from records
            return
        rest = _bytes_for(total[d - 1]) if d > 1 else 0
        pointer = 8 + width + rest
        raw = at(place + 6 + n * size, (n + 1) * pointer)
        for k in range(n + 1):
            p = raw[k * pointer : (k + 1) * pointer]
            yield from walk(struct.unpack("<Q", p[:8])[0], int.from_bytes(p[8 : 8 + width], "little"), d - 1)
            if k < n:
                yield records[k]

    yield from walk(root, count, depth)


class FractalHeap:
    """Managed and tiny objects; filtered heaps and huge objects are not read."""

    def __init__(self, at: At, address: int):
        self.at = at
        d = at(address, 146)
        if d[:4] != b"FRHP":
            raise ValueError("no fractal heap")
        self.id_size, filters = struct.unpack("<HH", d[5:9])
        if filters:
            raise NotImplementedError("filtered fractal heap")
        self.checked = bool(d[9] & 2)
        most = struct.unpack("<I", d[10:14])[0]
        self.width, self.first, self.largest, bits, _ = struct.unpack("<HQQHH", d[110:132])
        self.root, self.rows = struct.unpack("<QH", d[132:142])
        self.offset_bytes = (bits + 7) // 8
        self.length_bytes = _bytes_for(min(self.largest, most))

    def row_size(self, row: int) -> int:
        return self.first << max(row - 1, 0)

    def _block(self, offset: int) -> tuple[int, int]:
        """Address of the direct block that holds a heap offset, and the offset inside it."""
        place, rows, base = self.root, self.rows, 0
        while rows:
            row, start, head = 0, base, 13 + self.offset_bytes
            while offset >= start + self.row_size(row) * self.width:
                start += self.row_size(row) * self.width
                row += 1
            column = (offset - start) // self.row_size(row)
            place = struct.unpack("<Q", self.at(place + head + (row * self.width + column) * 8, 8))[0]
            base = start + column * self.row_size(row)
            if self.row_size(row) <= self.largest:
                break
            # An indirect child: as many rows as its span needs.
            span, rows = 0, 0
            while span < self.row_size(row):
                span += self.row_size(rows) * self.width
                rows += 1
        return place, offset - base

    def object(self, identifier: bytes) -> bytes:
        kind = identifier[0] >> 4 & 3
        if kind == 2:
            return identifier[1 : 2 + (identifier[0] & 15)]
        if kind:
            raise NotImplementedError("huge objects of a fractal heap")
        offset = int.from_bytes(identifier[1 : 1 + self.offset_bytes], "little")
        n = int.from_bytes(identifier[1 + self.offset_bytes : 1 + self.offset_bytes + self.length_bytes], "little")
        place, inside = self._block(offset)
        return self.at(place + inside, n)


def dense_objects(at: At, heap: int, tree: int, skip: int) -> Iterator[bytes]:
    """The heap objects that a B-tree's records name; the identifier starts `skip` bytes into a record."""
    h = FractalHeap(at, heap)
    for record in btree2_records(at, tree):
        yield h.object(record[skip : skip + h.id_size])
