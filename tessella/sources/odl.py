"""StructMetadata text of the EOS profiles: parsing, transforming and applying it to a tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessella.model import Dimension, Group, replace

NAMES = ("SwathName", "GridName", "PointName")
FIELDS = {"GeoField": "Geolocation Fields", "DataField": "Data Fields"}


@dataclass
class Block:
    name: str
    values: dict[str, object] = field(default_factory=dict)
    children: list["Block"] = field(default_factory=list)

    def child(self, name: str) -> "Block | None":
        return next((c for c in self.children if c.name == name), None)


def _value(text: str) -> object:
    text = text.strip()
    if text.startswith("("):
        return [p.strip().strip('"') for p in text.strip("()").split(",") if p.strip()]
    return text.strip('"')


def parse(text: str) -> Block:
    """Nested GROUP and OBJECT blocks. Values in parentheses may run over lines; a name that closes nothing is an error."""
    root = Block("")
    stack, held = [root], ""
    for raw in text.split("\0")[0].splitlines():
        line = held + raw.strip()
        if line.count("(") > line.count(")"):
            held = line
            continue
        held = ""
        key, _, value = (p.strip() for p in line.partition("="))
        if key in ("GROUP", "OBJECT"):
            stack.append(Block(value.strip('"')))
            stack[-2].children.append(stack[-1])
        elif key in ("END_GROUP", "END_OBJECT"):
            if len(stack) < 2 or value and stack[-1].name != value.strip('"'):
                raise ValueError(f"{line} closes nothing")
            stack.pop()
        elif key == "END":
            break
        elif value:
            stack[-1].values[key] = _value(value)
    return root


@dataclass
class Structure:
    name: str
    dims: dict[str, int]
    fields: dict[str, dict[str, list[str]]]


def transform(root: Block) -> list[Structure]:
    """Swaths, grids and points with their dimensions and each field's dimension names; dimensions that fields need but
    nobody declares are left to the variables."""
    out = []
    for kind in root.children:
        for block in kind.children:
            name = next((str(block.values[n]) for n in NAMES if n in block.values), None)
            if name is None:
                continue
            dims = {str(o.values["DimensionName"]): int(str(o.values["Size"])) for o in (block.child("Dimension") or Block("")).children if "DimensionName" in o.values and int(str(o.values.get("Size", 0))) > 0}
            for axis in ("XDim", "YDim"):
                if str(block.values.get(axis, "")).isdigit():
                    dims.setdefault(axis, int(str(block.values[axis])))
            fields: dict[str, dict[str, list[str]]] = {}
            for short, long_ in FIELDS.items():
                for o in (block.child(short) or Block("")).children:
                    if f"{short}Name" in o.values and isinstance(o.values.get("DimList"), list):
                        fields.setdefault(long_, {})[str(o.values[f"{short}Name"])] = list(o.values["DimList"])
            out.append(Structure(name, dims, fields))
    return out


def missing_dims(s: Structure) -> list[str]:
    need = {d for f in s.fields.values() for dims in f.values() for d in dims}
    return sorted(need - set(s.dims))


def apply(root: Group, text: str) -> bool:
    """Name the dimensions of the structures' variables. Text that is no valid metadata changes nothing."""
    try:
        structures = transform(parse(text))
    except ValueError:
        return False
    done = False
    for s in structures:
        home = root.find_nested_group(re.sub(r"[/ ,]", "_", s.name))
        if home is None:
            continue
        for fields, wanted in s.fields.items():
            place = home.find_nested_group(fields.replace(" ", "_")) or home
            for k, v in enumerate(place.variables):
                names = wanted.get(v.name)
                if not names or len(names) != len(v.dims):
                    continue
                dims = []
                for name, d in zip(names, v.dims, strict=True):
                    if s.dims.get(name, d.length) != d.length:
                        dims.append(d)
                        continue
                    if not any(x.name == name for x in home.dims):
                        home.add_dimension(Dimension(name, d.length))
                    dims.append(Dimension(name, d.length))
                place.variables[k] = replace(v, dims=tuple(dims))
                done = True
    return done
