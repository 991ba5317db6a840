"""HDF4: tag directory, scientific data sets, vdata, vgroups, rasters; contiguous, linked, deflated and chunked storage."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from tessella.functions.convert import EOS_METADATA, FILL_SD
from tessella.model import Attribute, Datatype, Dimension, Group, Member, Variable, valid_name
from tessella.sources import odl

# Fixed values of the format: tags and number types.
LINKED, COMPRESSED, NT, FILE_TEXT = 20, 40, 106, 101
IMAGE_DIM, RASTER, RASTER_GROUP = 300, 302, 306
SDD, SD, NDG, FV, VH, VS, VG = 701, 702, 720, 732, 1962, 1963, 1965
NUMBERS = {3: ("char", 1), 4: ("char", 1), 5: ("float", 4), 6: ("double", 8), 20: ("byte", 1), 21: ("ubyte", 1), 22: ("short", 2), 23: ("ushort", 2), 24: ("int", 4), 25: ("uint", 4), 26: ("int64", 8), 27: ("uint64", 8)}
PROMOTE_CHARS = 4000
INNER_CLASSES = ("Var0.0", "Dim0.0", "UDim0.0", "CDF0.0", "RIG0.0", "RI0.0")


def number_type(code: int) -> Datatype:
    name, size = NUMBERS[code & 0x3F]
    return Datatype(name, size, "<" if code & 0x4000 else ">")


def record(t: Datatype, raw: bytes) -> dict:
    """A vdata record as a dictionary."""
    out = {}
    for m in t.members:
        n = int(np.prod(m.dims)) if m.dims else 1
        part = raw[m.offset : m.offset + n * m.type.size]
        if m.type.name == "char":
            out[m.name] = part.split(b"\0")[0].decode(errors="replace")
        else:
            values = np.frombuffer(part, m.type.numpy()).tolist()
            out[m.name] = values if m.dims else values[0]
    return out


@dataclass
class Table:
    name: str
    kind: str
    type: Datatype
    records: int
    fields: list[tuple[str, Datatype, int]]


class File:
    def __init__(self, path: str):
        self.f = open(path, "rb")
        self.tags: dict[tuple[int, int], tuple[int, int, bool]] = {}
        pos = 4
        while pos:
            n, nxt = struct.unpack(">HI", self.at(pos, 6))
            for k in range(n):
                tag, ref, off, length = struct.unpack(">HHII", self.at(pos + 6 + 12 * k, 12))
                if tag != 1:
                    self.tags[tag & 0xBFFF, ref] = (off, length, bool(tag & 0x4000))
            pos = nxt

    def at(self, pos: int, n: int) -> bytes:
        self.f.seek(pos)
        return self.f.read(n)

    def of(self, tag: int) -> list[int]:
        return sorted(r for t, r in self.tags if t == tag)

    def raw(self, tag: int, ref: int) -> bytes:
        off, n, _ = self.tags[tag, ref]
        return self.at(off, n)

    def storage(self, tag: int, ref: int) -> dict:
        """How an element's bytes are stored."""
        if (tag, ref) not in self.tags:
            return {"kind": "fill"}
        off, n, special = self.tags[tag, ref]
        if not special:
            return {"kind": "contiguous", "pos": off}
        head = self.at(off, n)
        code = struct.unpack(">H", head[:2])[0]
        if code == 1:
            return {"kind": "linked", "blocks": self.blocks(head)}
        if code == 3:
            data, _, coder = struct.unpack(">HHH", head[8:14])
            inner = self.storage(COMPRESSED, data)
            if coder not in (0, 4):
                raise NotImplementedError(f"compression {coder}")
            blocks = inner["blocks"] if inner["kind"] == "linked" else [self.tags[COMPRESSED, data][:2]]
            return {"kind": "linked", "blocks": blocks, "deflate": coder == 4}
        if code == 5:
            table, rank = struct.unpack(">HH", head[23:27]), struct.unpack(">I", head[31:35])[0]
            sizes = [struct.unpack(">III", head[35 + 12 * k : 47 + 12 * k]) for k in range(rank)]
            index = {}
            for r in self.records(table[1]):
                start = tuple(o * s[2] for o, s in zip(np.atleast_1d(r["origin"]).tolist(), sizes, strict=True))
                index[start] = self.tile(r["chk_tag"], r["chk_ref"])
            return {"kind": "chunked", "chunk": [s[2] for s in sizes], "index": index, "filters": [{"id": 1, "name": "deflate", "values": []}]}
        raise NotImplementedError(f"special element {code}")

    def tile(self, tag: int, ref: int) -> tuple[int, int, int]:
        """(position, bytes, mask): mask 1 leaves out the deflate filter."""
        off, n, special = self.tags[tag & 0xBFFF, ref]
        if not special:
            return off, n, 1
        st = self.storage(tag & 0xBFFF, ref)
        if len(st["blocks"]) != 1:
            raise NotImplementedError("a chunk in linked blocks")
        return (*st["blocks"][0], 0 if st["deflate"] else 1)

    def blocks(self, head: bytes) -> list[tuple[int, int]]:
        _, left, first, size, per = struct.unpack(">HIIII", head[:18])
        ref, out = struct.unpack(">H", head[18:20])[0], []
        while ref and left > 0:
            link = self.raw(LINKED, ref)
            ref = struct.unpack(">H", link[:2])[0]
            for b in struct.unpack(f">{per}H", link[2 : 2 + 2 * per]):
                if b and left > 0:
                    n = min(left, first if not out else size)
                    out.append((self.tags[LINKED, b][0], n))
                    left -= n
        return out

    def element(self, tag: int, ref: int) -> bytes:
        st = self.storage(tag, ref)
        if st["kind"] == "contiguous":
            return self.raw(tag, ref)
        if st["kind"] == "linked":
            data = b"".join(self.at(p, n) for p, n in st["blocks"])
            return zlib.decompress(data) if st.get("deflate") else data
        return b""

    def vgroup(self, ref: int) -> tuple[list[tuple[int, int]], str, str]:
        d = self.raw(VG, ref)
        n = struct.unpack(">H", d[:2])[0]
        tags, refs = struct.unpack(f">{n}H", d[2 : 2 + 2 * n]), struct.unpack(f">{n}H", d[2 + 2 * n : 2 + 4 * n])
        name, at = counted(d, 2 + 4 * n)
        kind, _ = counted(d, at)
        return list(zip(tags, refs, strict=True)), name, kind

    def table(self, ref: int) -> Table:
        d = self.raw(VH, ref)
        _, records, size, n = struct.unpack(">HIHH", d[:10])
        columns = [struct.unpack(f">{n}H", d[10 + 2 * n * k : 10 + 2 * n * (k + 1)]) for k in range(4)]
        at, fields = 10 + 8 * n, []
        for kind, _, offset, order in zip(*columns, strict=True):
            name, at = counted(d, at)
            fields.append((valid_name(name), number_type(kind), offset, order))
        name, at = counted(d, at)
        kind, _ = counted(d, at)
        members = tuple(Member(f, t, o, (k,) if k > 1 else ()) for f, t, o, k in fields)
        return Table(name, kind, Datatype("compound", size, members=members), records, fields)

    def records(self, ref: int) -> list[dict]:
        t, data = self.table(ref), self.element(VS, ref)
        return [record(t.type, data[k * t.type.size : (k + 1) * t.type.size]) for k in range(t.records)]


def counted(d: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack(">H", d[at : at + 2])[0]
    return d[at + 2 : at + 2 + n].split(b"\0")[0].decode(errors="replace"), at + 2 + n


class Tree:
    def __init__(self, path: str, strict: bool = False):
        self.h = File(path)
        self.root = Group("")
        with self.h.f:
            self.used: set[tuple[int, int]] = set()
            groups = {r: self.h.vgroup(r) for r in self.h.of(VG)}
            inner = {r for items, _, kind in groups.values() if kind != "CDF0.0" for t, r in items if t == VG}
            for ref, (_, _, kind) in groups.items():
                if ref not in inner and kind not in INNER_CLASSES[1:]:
                    self.place(self.root, ref, groups)
                elif kind == "CDF0.0":
                    self.place(self.root, ref, groups, flat=True)
            for ref in self.h.of(NDG):
                if (NDG, ref) not in self.used:
                    self.data_set(self.root, f"SDS-{ref}", self.pairs(NDG, ref), [], [])
            for ref in self.h.of(VH):
                if (VH, ref) not in self.used:
                    self.vdata(self.root, ref)
            for ref in self.h.of(RASTER_GROUP):
                self.raster(ref)
            for k, ref in enumerate(reversed(self.h.of(FILE_TEXT))):
                self.root.attributes.append(Attribute(f"FileAnnotation.{k + 1}", Datatype("string"), (self.h.raw(FILE_TEXT, ref).split(b"\0")[0].decode(errors="replace"),)))
            if not strict:
                self.promote()
        self.root.remove_empty()

    def promote(self) -> None:
        """EOS metadata texts become variables of a group of their own; other long texts become variables."""
        home, stay = Group("EosMetadata", self.root), []
        for a in self.root.attributes:
            text = a.values[0] if a.is_string and len(a.values) == 1 else None
            eos = a.name.lower().startswith(EOS_METADATA)
            if text is not None and (eos or len(text) > PROMOTE_CHARS):
                data = text.encode()
                (home if eos else self.root).add_variable(Variable(a.name, Datatype("string", len(data)), (), (), {"kind": "bytes", "data": data, "heap": False}))
            else:
                stay.append(a)
        self.root.attributes = stay
        if home.variables:
            self.root.groups.append(home)

    def pairs(self, tag: int, ref: int) -> list[tuple[int, int]]:
        d = self.h.raw(tag, ref)
        return [struct.unpack(">HH", d[k : k + 4]) for k in range(0, len(d), 4)]

    def place(self, g: Group, ref: int, groups: dict, flat: bool = False) -> None:
        if (VG, ref) in self.used:
            return
        self.used.add((VG, ref))
        items, name, kind = groups[ref]
        if kind == "Var0.0":
            self.variable(g, name, items, groups)
            return
        home = g if flat or kind == "CDF0.0" else g.add_group(name)
        for tag, r in items:
            if tag == VG and r in groups and groups[r][2] not in ("Dim0.0", "UDim0.0"):
                self.place(home, r, groups)
            elif tag == NDG:
                self.data_set(home, f"SDS-{r}", self.pairs(NDG, r), [], [])
                self.used.add((NDG, r))
            elif tag == VH:
                self.vdata(home, r)

    def variable(self, g: Group, name: str, items: list, groups: dict) -> None:
        """A data set with its named dimensions and attributes."""
        dims = [groups[r][1] for t, r in items if t == VG and r in groups and groups[r][2] in ("Dim0.0", "UDim0.0")]
        atts = []
        for t, r in items:
            if t == VH:
                self.used.add((VH, r))
                if self.h.table(r).kind.startswith("Attr0."):
                    atts.append(self.attribute(r))
            self.used.update({(VG, r)} if t == VG else set())
        for t, r in items:
            if t == NDG and (t, r) in self.h.tags:
                self.used.add((NDG, r))
                self.data_set(g, name, self.pairs(NDG, r), dims, atts)

    def attribute(self, ref: int) -> Attribute:
        t = self.h.table(ref)
        values: list = []
        for r in self.h.records(ref):
            for v in r.values():
                values += v if isinstance(v, list) else [v]
        kind = t.fields[0][1]
        if kind.name == "char":
            return Attribute(valid_name(t.name), Datatype("string"), tuple(values) if t.fields[0][3] > 1 else ("".join(values),))
        return Attribute(valid_name(t.name), kind, tuple(values))

    def data_set(self, g: Group, name: str, tags: list, dims: list[str], atts: list[Attribute]) -> None:
        found = dict(tags)
        if SDD not in found:
            return
        d = self.h.raw(SDD, found[SDD])
        rank = struct.unpack(">H", d[:2])[0]
        shape = struct.unpack(f">{rank}i", d[2 : 2 + 4 * rank])
        kind = self.h.raw(NT, struct.unpack(">HH", d[2 + 4 * rank : 6 + 4 * rank])[1])[1]
        t = number_type(kind)
        storage = self.h.storage(SD, found[SD]) if SD in found else {"kind": "fill"}
        own = next((a for a in atts if a.name == "_FillValue" and a.values), None)
        if own and t.name != "char":
            storage["fill"] = np.array(own.values[0], t.numpy()).tobytes()
        elif FV in found and (FV, found[FV]) in self.h.tags:
            storage["fill"] = self.h.raw(FV, found[FV])[: t.size]
        elif t.name in FILL_SD:
            storage["fill"] = np.array(FILL_SD[t.name], t.numpy()).tobytes()
        out = []
        for k, n in enumerate(shape):
            label = valid_name(dims[k]) if k < len(dims) else ""
            if not label or label.startswith("fakeDim"):
                out.append(Dimension("", n, False))
            else:
                if not any(x.name == label for x in g.dims):
                    g.add_dimension(Dimension(label, n))
                out.append(Dimension(label, n))
        g.add_variable(Variable(valid_name(name), t, tuple(out), tuple(atts), storage))

    def vdata(self, g: Group, ref: int) -> None:
        self.used.add((VH, ref))
        t = self.h.table(ref)
        if t.kind.startswith("Attr0."):
            g.attributes.append(self.attribute(ref))
            return
        if t.kind.startswith(("DimVal", "_HDF_CHK_TBL")) or not t.records or not t.fields:
            return
        name = valid_name(t.kind if t.name == "Ancillary_Data" and t.kind else t.name)
        storage = self.h.storage(VS, ref) | {"heap": False}
        if len(t.fields) == 1:
            _, kind, _, order = t.fields[0]
            dims = (Dimension("", t.records, False), *((Dimension("", order, False),) if order > 1 else ()))
            g.add_variable(Variable(name, kind, dims, (), storage))
        else:
            g.add_variable(Variable(name, t.type, (Dimension("", t.records, False),), (), storage))

    def raster(self, ref: int) -> None:
        found = dict(self.pairs(RASTER_GROUP, ref))
        if IMAGE_DIM not in found or RASTER not in found:
            return
        d = self.h.raw(IMAGE_DIM, found[IMAGE_DIM])
        x, y, _, nt, planes = struct.unpack(">iiHHH", d[:14])
        t = number_type(self.h.raw(NT, nt)[1]) if (NT, nt) in self.h.tags else Datatype("ubyte", 1)
        dims = (Dimension("ydim", y, False), Dimension("xdim", x, False), *((Dimension("", planes, False),) if planes > 1 else ()))
        self.root.add_variable(Variable(f"Raster_Image_{ref}", t, dims, (), self.h.storage(RASTER, found[RASTER])))
        if 301 in found:
            n = self.h.tags[301, found[301]][1]
            self.root.add_variable(Variable(f"Raster_Image_{ref}_lookup", Datatype("ubyte", 1), (Dimension("", n // 3, False), Dimension("", 3, False)), (), self.h.storage(301, found[301])))


def read_tree(path: str, strict: bool = False) -> Group:
    return Tree(path, strict).root


def apply_struct_metadata(root: Group) -> bool:
    """Dimensions from StructMetadata attributes (or promoted variables), wherever they are; True if there were any."""
    texts: dict[str, str] = {}

    def look(g: Group) -> None:
        for a in g.attributes:
            if a.name.lower().startswith("structmetadata") and a.values:
                texts[a.name] = str(a.values[0])
        for v in g.variables:
            if v.name.lower().startswith("structmetadata") and v.storage.get("kind") == "bytes":
                texts[v.name] = v.storage["data"].decode(errors="replace")
        for s in g.groups:
            look(s)

    look(root)
    return bool(texts) and odl.apply(root, "".join(texts[k] for k in sorted(texts)))
