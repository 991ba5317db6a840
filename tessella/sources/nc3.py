"""Classic NetCDF: CDF-1, CDF-2 (64-bit offsets) and CDF-5 (64-bit data)."""

from __future__ import annotations

import os
import struct

import numpy as np

from tessella.model import Attribute, Datatype, Dimension, Group, Variable, valid_name

# Fixed values of the format: type codes.
TYPES = {1: ("byte", 1), 2: ("char", 1), 3: ("short", 2), 4: ("int", 4), 5: ("float", 4), 6: ("double", 8), 7: ("ubyte", 1), 8: ("ushort", 2), 9: ("uint", 4), 10: ("int64", 8), 11: ("uint64", 8)}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12


def datatype(code: int) -> Datatype:
    name, size = TYPES[code]
    return Datatype(name, size, ">")


class _Header:
    def __init__(self, path: str):
        self.size = os.path.getsize(path)
        self.f = open(path, "rb")
        self.version = self.f.read(4)[3]
        self.wide = self.version == 5

    def int(self, wide: bool | None = None) -> int:
        wide = self.wide if wide is None else wide
        return struct.unpack(">q" if wide else ">i", self.f.read(8 if wide else 4))[0]

    def bytes(self, n: int) -> bytes:
        out = self.f.read(n)
        self.f.read(-n % 4)
        return out

    def name(self) -> str:
        return valid_name(self.bytes(self.int()).decode())

    def list(self, tag: int) -> range:
        found, n = self.int(False), self.int()
        if found not in (0, tag) or found == 0 and n:
            raise ValueError(f"header tag {found} where {tag} belongs")
        return range(n)

    def attributes(self) -> list[Attribute]:
        out = []
        for _ in self.list(ATTRIBUTES):
            name, t, n = self.name(), datatype(self.int(False)), self.int()
            raw = self.bytes(n * t.size)
            if t.name == "char":
                out.append(Attribute(name, Datatype("string"), (raw.split(b"\0")[0].decode(errors="replace"),) if n else ()))
            else:
                out.append(Attribute(name, t, tuple(np.frombuffer(raw, t.numpy()).tolist())))
        return out


def read_header(path: str) -> Group:
    h = _Header(path)
    with h.f:
        records = h.int()
        root = Group("")
        dims = []
        for _ in h.list(DIMENSIONS):
            name, n = h.name(), h.int()
            dims.append((name, n))
        root.attributes = h.attributes()
        found = []
        for _ in h.list(VARIABLES):
            name = h.name()
            ids = [h.int() for _ in range(h.int())]
            atts = h.attributes()
            t = datatype(h.int(False))
            h.int()  # the stored size is no use: it overflows for large variables
            found.append((name, ids, atts, t, h.int(h.version != 1)))
    is_record = lambda ids: bool(ids) and dims[ids[0]][1] == 0

    def inner(ids: list[int]) -> int:
        out = 1
        for i in ids:
            out *= dims[i][1]
        return out

    in_record = [(ids, t) for _, ids, _, t, _ in found if is_record(ids)]
    sizes = [inner(ids[1:]) * t.size for ids, t in in_record]
    # A single record variable of a short type is not padded.
    recsize = sizes[0] if len(sizes) == 1 and in_record[0][1].size < 4 else sum(s + -s % 4 for s in sizes)
    if records < 0:
        begin = min((b for _, ids, _, _, b in found if is_record(ids)), default=h.size)
        records = (h.size - begin) // recsize if recsize else 0
    for name, n in dims:
        root.add_dimension(Dimension(name, n or records))
    for name, ids, atts, t, begin in found:
        shape = tuple(root.dims[i] for i in ids)
        storage = {"kind": "records", "pos": begin, "recsize": recsize, "inner": inner(ids[1:])} if is_record(ids) else {"kind": "contiguous", "pos": begin}
        root.add_variable(Variable(name, t, shape, tuple(atts), storage))
    return root


def file_type(version: int) -> str:
    return {1: "netcdf3", 2: "netcdf3.2", 5: "netcdf3.5"}[version]
