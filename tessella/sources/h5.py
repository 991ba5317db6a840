"""HDF5 and NetCDF-4 metadata: superblocks 0-3, object headers 1 and 2, old and new groups, layouts 1-3, dimension scales.

Written from the public file format specification. Data layout version 4 and filters other than deflate, shuffle and
fletcher32 raise NotImplementedError when they are met.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from tessella.functions.convert import HIDDEN_ATTRIBUTES, NON_COORD, NOT_A_VARIABLE
from tessella.model import ENUMS, Attribute, Datatype, Dimension, Group, Member, Variable, replace, valid_name
from tessella.sources.h5_dense import dense_objects

UNDEFINED = (1 << 64) - 1
SIGNED = {1: "byte", 2: "short", 4: "int", 8: "int64"}
UNSIGNED = {1: "ubyte", 2: "ushort", 4: "uint", 8: "uint64"}
PROMOTE_CHARS = 4000


@dataclass
class Object:
    address: int
    type: Datatype | None = None
    dims: list[int] | None = None
    null_space: bool = False
    layout: dict | None = None
    fill: bytes | None = None
    filters: list[dict] = field(default_factory=list)
    attributes: list[tuple[str, Datatype, list[int], bytes]] = field(default_factory=list)
    links: list[tuple[str, int]] = field(default_factory=list)
    is_group: bool = False


class File:
    def __init__(self, path: str, base: int = 0):
        self.f, self.base = open(path, "rb"), base
        self.objects: dict[int, Object] = {}
        self.heaps: dict[int, dict[int, bytes]] = {}
        self.root = self._superblock()

    def at(self, pos: int, n: int) -> bytes:
        self.f.seek(self.base + pos)
        return self.f.read(n)

    def _superblock(self) -> int:
        head = self.at(8, 4)
        version = head[0]
        if version in (0, 1):
            if (head := self.at(8, 16))[5:7] != b"\x08\x08":
                raise NotImplementedError("offsets and lengths of 8 bytes only")
            return struct.unpack("<Q", self.at((56 if version == 0 else 60) + 8, 8))[0]
        if version in (2, 3):
            if head[1:3] != b"\x08\x08":
                raise NotImplementedError("offsets and lengths of 8 bytes only")
            return struct.unpack("<Q", self.at(36, 8))[0]
        raise NotImplementedError(f"superblock version {version}")

    # object headers

    def object(self, address: int) -> Object:
        if address not in self.objects:
            self.objects[address] = o = Object(address)
            for kind, flags, data in self._messages(address):
                self._message(o, kind, flags, data)
        return self.objects[address]

    def _messages(self, address: int):
        if self.at(address, 4) == b"OHDR":
            yield from self._messages2(address)
            return
        _, _, count, _, size = struct.unpack("<BBHII", self.at(address, 12))
        todo = [(address + 16, size)]
        while todo:
            pos, left = todo.pop(0)
            while left >= 8 and count:
                kind, n, flags = struct.unpack("<HHB", self.at(pos, 5))
                data = self.at(pos + 8, n)
                pos, left, count = pos + 8 + n, left - 8 - n, count - 1
                if kind == 0x10:
                    todo.append(struct.unpack("<QQ", data[:16]))
                else:
                    yield kind, flags, data

    def _messages2(self, address: int):
        flags = self.at(address, 6)[5]
        pos = address + 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
        width = 1 << (flags & 3)
        size = int.from_bytes(self.at(pos, width), "little")
        todo, extra = [(pos + width, size)], 2 if flags & 4 else 0
        while todo:
            pos, left = todo.pop(0)
            while left >= 4 + extra:
                kind, n, own = struct.unpack("<BHB", self.at(pos, 4))
                data = self.at(pos + 4 + extra, n)
                pos, left = pos + 4 + extra + n, left - 4 - extra - n
                if kind == 0x10:
                    a, n = struct.unpack("<QQ", data[:16])
                    todo.append((a + 4, n - 8))
                else:
                    yield kind, own, data

    def _message(self, o: Object, kind: int, flags: int, d: bytes) -> None:
        if flags & 2 and kind in (1, 3, 5, 0xB):
            where = struct.unpack("<Q", d[8:16] if d[0] == 1 else d[2:10])[0]
            source = self.object(where)
            if kind == 3:
                o.type = source.type
            return
        if kind == 1:
            o.dims, o.null_space = dataspace(d)
        elif kind == 3:
            o.type = datatype(d)[0]
        elif kind == 4 and o.fill is None:
            o.fill = d[4 : 4 + struct.unpack("<I", d[:4])[0]] or None
        elif kind == 5:
            o.fill = fill_value(d) or o.fill
        elif kind == 8:
            o.layout = layout(d)
        elif kind == 0xB:
            o.filters = filters(d)
        elif kind == 0xC:
            o.attributes.append(self._attribute(d))
        elif kind == 6:
            o.is_group = True
            if link := hard_link(d):
                o.links.append(link)
        elif kind == 0x11:
            o.is_group = True
            tree, heap = struct.unpack("<QQ", d[:16])
            o.links += self._symbols(tree, heap)
        elif kind == 2:
            o.is_group = True
            at = 2 + (8 if d[1] & 1 else 0)
            heap, names = struct.unpack("<QQ", d[at : at + 16])
            if heap != UNDEFINED:
                o.links += [link for m in dense_objects(self.at, heap, names, 4) if (link := hard_link(m))]
        elif kind == 0x15:
            at = 2 + (2 if d[1] & 1 else 0)
            heap, names = struct.unpack("<QQ", d[at : at + 16])
            if heap != UNDEFINED:
                o.attributes += [self._attribute(m) for m in dense_objects(self.at, heap, names, 0)]

    def _symbols(self, tree: int, heap: int) -> list[tuple[str, int]]:
        text = struct.unpack("<Q", self.at(heap + 24, 8))[0]
        level, n = struct.unpack("<BH", self.at(tree + 5, 3))
        out = []
        for k in range(n):
            child = struct.unpack("<Q", self.at(tree + 24 + 8 + k * 16, 8))[0]
            if level:
                out += self._symbols(child, heap)
                continue
            for e in range(struct.unpack("<H", self.at(child + 6, 2))[0]):
                name, address, cached = struct.unpack("<QQI", self.at(child + 8 + e * 40, 20))
                if cached != 2:  # soft links are left out
                    out.append((self.at(text + name, 512).split(b"\0")[0].decode(), address))
        return out

    def _attribute(self, d: bytes) -> tuple[str, Datatype, list[int], bytes]:
        version, flags, name, kind, space = struct.unpack("<BBHHH", d[:8])
        at, pad = 9 if version == 3 else 8, (lambda n: n + -n % 8) if version == 1 else (lambda n: n)
        title = d[at : at + name].split(b"\0")[0].decode()
        at += pad(name)
        if version > 1 and flags & 1:
            where = struct.unpack("<Q", d[at + 8 : at + 16] if d[at] == 1 else d[at + 2 : at + 10])[0]
            t = self.object(where).type
        else:
            t = datatype(d[at : at + kind])[0]
        at += pad(kind)
        dims, null = dataspace(d[at : at + space])
        return title, t, [0] if null else dims, d[at + pad(space) :]

    # global heap

    def heap(self, address: int, index: int) -> bytes:
        if address not in self.heaps:
            size = struct.unpack("<Q", self.at(address + 8, 8))[0]
            raw, pos, held = self.at(address, size), 16, {}
            while pos + 16 <= size:
                k, _, _, n = struct.unpack("<HHIQ", raw[pos : pos + 16])
                if k == 0:
                    break
                held[k] = raw[pos + 16 : pos + 16 + n]
                pos += 16 + n + -n % 8
            self.heaps[address] = held
        return self.heaps[address].get(index, b"")

    def vlen(self, t: Datatype, raw: bytes):
        """A string, or a list of the base type's values, behind a heap identifier of 16 bytes; null strings are empty."""
        n, address, index = struct.unpack("<IQI", raw[:16])
        data = self.heap(address, index) if n and address else b""
        if t.name == "string":
            return data[:n].split(b"\0")[0].decode(errors="replace")
        if t.base.name in ("string", "opaque", "compound", "vlen"):
            raise NotImplementedError(f"variable-length arrays of {t.base.name}")
        return np.frombuffer(data, t.base.numpy(), n).tolist() if n else []

    def values(self, t: Datatype, dims: list[int], raw: bytes) -> list:
        """Elements of an array in memory as Python values."""
        n = int(np.prod(dims)) if dims else 1
        if t.dims:
            n *= int(np.prod(t.dims))
        return [self.value(t, raw[k * t.size : (k + 1) * t.size]) for k in range(n)]

    def value(self, t: Datatype, raw: bytes):
        if t.name == "vlen" or t.name == "string" and t.base is not None:
            return self.vlen(t, raw)
        if t.name == "string":
            return raw.split(b"\0")[0].decode(errors="replace")
        if t.name == "opaque":
            return raw
        if t.name == "compound":
            return {m.name: self.member(m, raw) for m in t.members}
        return np.frombuffer(raw, t.numpy(), 1)[0].item()

    def member(self, m: Member, raw: bytes):
        n = int(np.prod(m.dims)) if m.dims else 1
        part = raw[m.offset : m.offset + n * m.type.size]
        if m.type.name == "char":
            return part.split(b"\0")[0].decode(errors="replace")
        values = [self.value(m.type, part[k * m.type.size : (k + 1) * m.type.size]) for k in range(n)]
        return values if m.dims else values[0]

    # chunk index

    def chunks(self, tree: int, rank: int) -> dict[tuple[int, ...], tuple[int, int, int]]:
        """Chunk start -> (position, bytes, filter mask)."""
        if tree == UNDEFINED:
            return {}
        level, n = struct.unpack("<BH", self.at(tree + 5, 3))
        width, out = 8 + 8 * (rank + 1), {}
        for k in range(n):
            pos = tree + 24 + k * (width + 8)
            size, mask = struct.unpack("<II", self.at(pos, 8))
            start = struct.unpack(f"<{rank}Q", self.at(pos + 8, 8 * rank))
            child = struct.unpack("<Q", self.at(pos + width, 8))[0]
            if level:
                out |= self.chunks(child, rank)
            elif child != UNDEFINED:
                out[start] = (self.base + child, size, mask)
        return out


def dataspace(d: bytes) -> tuple[list[int], bool]:
    version, rank = d[0], d[1]
    at = 8 if version == 1 else 4
    null = version == 2 and d[3] == 2
    return list(struct.unpack(f"<{rank}Q", d[at : at + 8 * rank])), null


def datatype(d: bytes) -> tuple[Datatype, int]:
    """The type of a message and its length in bytes."""
    kind, version = d[0] & 15, d[0] >> 4
    bits, size = int.from_bytes(d[1:4], "little"), struct.unpack("<I", d[4:8])[0]
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return Datatype((SIGNED if bits & 8 else UNSIGNED)[size], size, order), 12
    if kind == 1:
        return Datatype({4: "float", 8: "double"}[size], size, order), 20
    if kind == 2:
        return Datatype("int64" if size == 8 else "int", size, order), 10
    if kind == 3:
        return Datatype("char" if size == 1 else "string", size), 8
    if kind == 4:
        return Datatype(UNSIGNED[size], size, order), 12
    if kind == 5:
        n = bits & 255
        return Datatype("opaque", size, typedef=d[8 : 8 + n].split(b"\0")[0].decode()), 8 + n
    if kind == 6:
        at, members = 8, []
        for _ in range(bits & 0xFFFF):
            end = d.index(b"\0", at)
            name = d[at:end].decode()
            at = end + 1 if version == 3 else at + (end - at + 8) // 8 * 8
            dims: tuple[int, ...] = ()
            if version == 3:
                width = max(1, (size.bit_length() + 7) // 8)
                offset, at = int.from_bytes(d[at : at + width], "little"), at + width
            else:
                offset, at = struct.unpack("<I", d[at : at + 4])[0], at + 4
                if version == 1:
                    dims = struct.unpack("<4I", d[at + 12 : at + 28])[: d[at]]
                    at += 28
            t, n = datatype(d[at:])
            at += n
            members.append(Member(valid_name(name), replace(t, dims=()), offset, dims or t.dims))
        return Datatype("compound", size, members=tuple(members)), at
    if kind == 7:
        return Datatype("reference", size), 8
    if kind == 8:
        base, n = datatype(d[8:])
        at, names = 8 + n, []
        for _ in range(bits & 0xFFFF):
            end = d.index(b"\0", at)
            names.append(d[at:end].decode())
            at = end + 1 if version == 3 else at + (end - at + 8) // 8 * 8
        codes = np.frombuffer(d[at : at + len(names) * size], base.numpy()).tolist()
        if size not in ENUMS:
            raise NotImplementedError(f"enum of {size} bytes")
        return Datatype(ENUMS[size], size, base.order, base=base, values=dict(zip(codes, names, strict=True))), at + len(names) * size
    if kind == 9:
        base, n = datatype(d[8:])
        return (Datatype("string", size, base=base) if bits & 15 == 1 else Datatype("vlen", size, base=base)), 8 + n
    if kind == 10:
        rank = d[8]
        at = 9 if version == 3 else 12
        dims = struct.unpack(f"<{rank}I", d[at : at + 4 * rank])
        at += 4 * rank * (1 if version == 3 else 2)
        base, n = datatype(d[at:])
        return replace(base, dims=dims), at + n
    raise NotImplementedError(f"datatype class {kind}")


def fill_value(d: bytes) -> bytes | None:
    if d[0] == 3:
        defined, at = d[1] & 32, 2
    else:
        defined, at = d[3] or d[0] == 1, 4
    if not defined or len(d) < at + 4:
        return None
    n = struct.unpack("<i", d[at : at + 4])[0]
    return d[at + 4 : at + 4 + n] if n > 0 else None


def layout(d: bytes) -> dict:
    if d[0] == 3:
        if d[1] == 0:
            n = struct.unpack("<H", d[2:4])[0]
            return {"kind": "bytes", "data": d[4 : 4 + n]}
        if d[1] == 1:
            return {"kind": "contiguous", "pos": struct.unpack("<Q", d[2:10])[0]}
        rank = d[2] - 1
        return {"kind": "chunked", "tree": struct.unpack("<Q", d[3:11])[0], "chunk": list(struct.unpack(f"<{rank}I", d[11 : 11 + 4 * rank]))}
    if d[0] in (1, 2):
        rank, kind, at = d[1], d[2], 8
        if kind:
            pos, at = struct.unpack("<Q", d[8:16])[0], 16
        dims = list(struct.unpack(f"<{rank}I", d[at : at + 4 * rank]))
        at += 4 * rank
        if kind == 0:
            n = struct.unpack("<I", d[at : at + 4])[0]
            return {"kind": "bytes", "data": d[at + 4 : at + 4 + n]}
        return {"kind": "contiguous", "pos": pos} if kind == 1 else {"kind": "chunked", "tree": pos, "chunk": dims[:-1]}
    raise NotImplementedError(f"data layout version {d[0]}")


def filters(d: bytes) -> list[dict]:
    version, n = d[0], d[1]
    at, out = 8 if version == 1 else 2, []
    for _ in range(n):
        kind, at = struct.unpack("<H", d[at : at + 2])[0], at + 2
        name = 0
        if version == 1 or kind >= 256:
            name, at = struct.unpack("<H", d[at : at + 2])[0], at + 2
        _, count = struct.unpack("<HH", d[at : at + 4])
        at += 4
        title = d[at : at + name].split(b"\0")[0].decode()
        at += name + (-name % 8 if version == 1 else 0)
        out.append({"id": kind, "name": title, "values": list(struct.unpack(f"<{count}I", d[at : at + 4 * count]))})
        at += 4 * count + (4 if version == 1 and count % 2 else 0)
    return out


def hard_link(d: bytes) -> tuple[str, int] | None:
    flags, at, kind = d[1], 2, 0
    if flags & 8:
        kind, at = d[2], 3
    at += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
    width = 1 << (flags & 3)
    n = int.from_bytes(d[at : at + width], "little")
    name = d[at + width : at + width + n].decode()
    return (name, struct.unpack("<Q", d[at + width + n : at + width + n + 8])[0]) if kind == 0 else None


class Tree:
    """Groups and variables of a file, with dimension scales turned into shared dimensions."""

    def __init__(self, path: str, strict: bool = False, base: int = 0):
        self.h, self.strict = File(path, base), strict
        self.scales: dict[int, tuple[Group, Dimension]] = {}
        self.paths: dict[int, str] = {}
        self.types: dict[int, Datatype] = {}
        self.is_netcdf4 = False
        self.root = Group("")
        with self.h.f:
            self.placed: list[tuple[Group, str, Object]] = []
            self._collect(self.root, self.h.object(self.h.root), {self.h.root})
            for g, name, o in self.placed:
                self._scale(g, name, o)
            for g, name, o in self.placed:
                self._place(g, name, o)
            self._attributes(self.root, self.h.object(self.h.root))

    def _collect(self, g: Group, o: Object, above: set[int]) -> None:
        for name, address in o.links:
            child = self.h.object(address)
            self.paths.setdefault(address, f"{g.full_name()}/{valid_name(name)}")
            if child.is_group:
                if address not in above:  # a hard link back to an ancestor would be a loop
                    sub = g.add_group(name)
                    self._collect(sub, child, above | {address})
                    self._attributes(sub, child)
            elif child.type is not None:
                self.placed.append((g, valid_name(name), child))

    def _plain(self, o: Object) -> dict[str, tuple]:
        return {n: (t, d, raw) for n, t, d, raw in o.attributes}

    def _text(self, o: Object, name: str) -> str | None:
        found = self._plain(o).get(name)
        return str(self.h.values(*found[:1], *found[1:])[0]) if found and found[0].name in ("string", "char") else None

    def _scale(self, g: Group, name: str, o: Object) -> None:
        if o.layout is not None and self._text(o, "CLASS") == "DIMENSION_SCALE" and o.dims:
            d = Dimension(name.removeprefix(NON_COORD), o.dims[0])
            if all(x.name != d.name for x in g.dims):
                g.add_dimension(d)
            self.scales[o.address] = (g, d)

    def _dims(self, o: Object) -> tuple[Dimension, ...]:
        shape = o.dims or []
        found = self._plain(o).get("DIMENSION_LIST")
        if o.address in self.scales:
            own = self.scales[o.address][1]
            rest = []
            for n in shape[1:]:
                same = [d for _, d in self.scales.values() if d.length == n and d.name != own.name]
                rest.append(same[0] if len(same) == 1 else Dimension("", n, False))
            return (replace(own, length=shape[0]), *rest)
        if not found:
            return tuple(Dimension("", n, False) for n in shape)
        refs = self.h.values(Datatype("vlen", 16, base=Datatype("reference", 8)), found[1], found[2])
        out = []
        for n, r in zip(shape, refs, strict=True):
            hit = self.scales.get(r[0]) if r else None
            if hit and n > hit[1].length:
                longer = replace(hit[1], length=n)
                hit[0].dims[:] = [longer if d == hit[1] else d for d in hit[0].dims]
                self.scales[r[0]] = hit = (hit[0], longer)
            out.append(replace(hit[1]) if hit else Dimension("", n, False))
        return tuple(out)

    def _attribute(self, name: str, t: Datatype, dims: list[int], raw: bytes) -> Attribute | None:
        values = self.h.values(t, dims, raw)
        if t.name == "reference":
            known = [self.paths[v] for v in values if v in self.paths]
            return Attribute(name, Datatype("string"), tuple(known)) if known else None
        if t.name == "char":
            return Attribute(name, Datatype("string"), ("".join(map(chr, values)).split("\0")[0],))
        return Attribute(name, t, tuple(values))

    def _attributes(self, g: Group, o: Object) -> None:
        for name, t, dims, raw in o.attributes:
            if name in HIDDEN_ATTRIBUTES:
                self.is_netcdf4 |= name.startswith("_N") or name.startswith("_nc3")
                continue
            a = self._attribute(valid_name(name), t, dims, raw)
            if a is None:
                continue
            if not self.strict and a.is_string and len(a.values) == 1 and len(a.values[0]) > PROMOTE_CHARS:
                data = a.values[0].encode()
                g.add_variable(Variable(a.name, Datatype("string", len(data)), (), (), {"kind": "bytes", "data": data}))
            else:
                g.attributes.append(a)

    def _place(self, g: Group, name: str, o: Object) -> None:
        self.is_netcdf4 |= any(n in ("_Netcdf4Dimid", "_Netcdf4Coordinates") for n, *_ in o.attributes)
        if o.layout is None:
            g.typedefs.append(replace(o.type, typedef=name))
            return
        title = self._text(o, "NAME") or ""
        if o.address in self.scales and title.startswith(NOT_A_VARIABLE):
            self.is_netcdf4 = True
            return
        storage = dict(o.layout)
        fill = o.fill
        if storage["kind"] == "contiguous":
            if storage["pos"] == UNDEFINED:
                storage = {"kind": "fill"}
            else:
                storage["pos"] += self.h.base
        elif storage["kind"] == "chunked":
            tree = storage.pop("tree")
            storage |= {"index": self.h.chunks(tree, len(storage["chunk"])), "filters": o.filters}
            if not storage["index"]:
                storage = {"kind": "fill"}
        if fill is not None:
            storage["fill"] = fill
        storage["base"] = self.h.base
        dims = self._dims(o) + tuple(Dimension("", n, False) for n in o.type.dims)
        t = replace(o.type, dims=())
        if o.null_space:
            storage, dims, t = {"kind": "bytes", "data": b""}, (Dimension("", 0, False),), Datatype("string", 1)
        atts = [a for n, k, d, raw in o.attributes if n not in HIDDEN_ATTRIBUTES and (a := self._attribute(valid_name(n), k, d, raw))]
        g.add_variable(Variable(name.removeprefix(NON_COORD), t, dims, tuple(atts), storage))
