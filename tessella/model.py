"""The common data model: groups, dimensions, typed variables, attributes and user-defined types."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import types as T

INTEGRAL = ("byte", "short", "int", "int64", "ubyte", "ushort", "uint", "uint64")
FLOATING = ("float", "double")
ENUMS = {1: "ubyte enum", 2: "ushort enum", 4: "uint enum"}
SPARK = {
    "byte": T.ByteType(), "char": T.ShortType(), "short": T.ShortType(), "int": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "ubyte": T.ShortType(), "ushort": T.IntegerType(), "uint": T.LongType(), "uint64": T.DecimalType(20, 0), "ubyte enum": T.ShortType(), "ushort enum": T.IntegerType(),
    "uint enum": T.LongType(), "string": T.StringType(), "opaque": T.BinaryType(), "reference": T.LongType(),
}


def valid_name(name: str) -> str:
    """Trimmed of characters up to space; slashes, spaces and commas become underscores, control characters go."""
    name = re.sub(r"^[\x00-\x20]+|[\x00-\x20]+$", "", name)
    return re.sub(r"[\x00-\x1f]", "", re.sub(r"[/ ,]", "_", name))


@dataclass(frozen=True)
class Member:
    name: str
    type: "Datatype"
    offset: int
    dims: tuple[int, ...] = ()


@dataclass(frozen=True)
class Datatype:
    """A type by name; equality of enums does not look at their values, as files with equal codes are alike."""

    name: str
    size: int = 0
    order: str = "<"
    base: "Datatype | None" = field(default=None, compare=False)
    members: tuple[Member, ...] = field(default=(), compare=False)
    values: dict[int, str] | None = field(default=None, compare=False, hash=False)
    typedef: str = field(default="", compare=False)
    dims: tuple[int, ...] = field(default=(), compare=False)

    @property
    def is_unsigned(self) -> bool:
        return self.name.startswith("u")

    @property
    def is_enum(self) -> bool:
        return self.name.endswith("enum")

    @property
    def is_integral(self) -> bool:
        return self.name in INTEGRAL

    @property
    def is_floating(self) -> bool:
        return self.name in FLOATING

    @property
    def is_numeric(self) -> bool:
        return self.is_integral or self.is_floating

    def numpy(self) -> np.dtype:
        """The stored form."""
        plain = {"byte": "i1", "char": "u1", "short": "i2", "int": "i4", "int64": "i8", "float": "f4", "double": "f8", "ubyte": "u1", "ushort": "u2", "uint": "u4", "uint64": "u8", "ubyte enum": "u1", "ushort enum": "u2", "uint enum": "u4", "reference": "u8"}
        if self.name in plain:
            return np.dtype(self.order + plain[self.name])
        if self.name == "compound":
            return np.dtype({"names": [m.name for m in self.members], "formats": [(m.type.numpy(), m.dims) if m.dims else m.type.numpy() for m in self.members], "offsets": [m.offset for m in self.members], "itemsize": self.size})
        return np.dtype(f"V{self.size}")

    def spark(self) -> T.DataType:
        if self.name == "compound":
            return T.StructType([T.StructField(m.name, T.ArrayType(m.type.spark()) if m.dims and m.type.name != "char" else T.StringType() if m.type.name == "char" else m.type.spark()) for m in self.members])
        if self.name == "vlen":
            return T.ArrayType(self.base.spark())
        return SPARK[self.name]


@dataclass(frozen=True)
class Dimension:
    name: str
    length: int
    shared: bool = True


@dataclass(frozen=True)
class Attribute:
    name: str
    type: Datatype
    values: tuple

    @property
    def is_string(self) -> bool:
        return self.type.name in ("char", "string")


@dataclass(frozen=True)
class Variable:
    name: str
    type: Datatype
    dims: tuple[Dimension, ...]
    attributes: tuple[Attribute, ...] = ()
    storage: dict = field(default_factory=dict, compare=False)

    @property
    def shape(self) -> list[int]:
        return [d.length for d in self.dims]

    def attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    def name_and_shape(self) -> str:
        return f"{self.type.name} {self.name}[{','.join(map(str, self.shape))}]"


@dataclass
class Group:
    name: str
    parent: "Group | None" = field(default=None, repr=False)
    dims: list[Dimension] = field(default_factory=list)
    attributes: list[Attribute] = field(default_factory=list)
    typedefs: list[Datatype] = field(default_factory=list)
    variables: list[Variable] = field(default_factory=list)
    groups: list["Group"] = field(default_factory=list)

    # building

    def add_group(self, name: str) -> "Group":
        g = Group(valid_name(name), self)
        self.groups.append(g)
        return g

    def add_dimension(self, d: Dimension) -> None:
        if any(x.name == d.name for x in self.dims):
            raise ValueError(f"duplicate dimension '{d.name}' in group '{self.full_name()}'")
        self.dims.append(d)

    def add_variable(self, v: Variable) -> None:
        """A second variable of a name is left out."""
        if all(x.name != v.name for x in self.variables):
            self.variables.append(v)

    def remove_empty(self) -> None:
        for g in self.groups:
            g.remove_empty()
        self.groups = [g for g in self.groups if g.groups or g.variables or g.attributes or g.dims or g.typedefs]

    # lookup

    def full_name(self) -> str:
        return "" if self.parent is None else f"{self.parent.full_name()}/{self.name}"

    def find_attribute(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    def find_dimension(self, name: str) -> Dimension | None:
        """In the group or the nearest ancestor."""
        own = next((d for d in self.dims if d.name == name), None)
        return own or (self.parent.find_dimension(name) if self.parent else None)

    def find_typedef(self, name: str) -> Datatype | None:
        own = next((t for t in self.typedefs if t.typedef == name), None)
        return own or (self.parent.find_typedef(name) if self.parent else None)

    def dimension_of(self, name: str, variable: str) -> Dimension:
        """A variable's dimension: a shared one, or an anonymous one if the name is a number."""
        d = self.find_dimension(name)
        if d:
            return d
        if name.isdigit():
            return Dimension("", int(name), False)
        raise ValueError(f"unknown dimension '{name}' in Variable '{variable}'")

    def find_nested_group(self, name: str) -> "Group | None":
        """By short name, this level first."""
        for g in self.groups:
            if g.name == name:
                return g
        return next((f for g in self.groups if (f := g.find_nested_group(name))), None)

    def walk(self) -> Iterator[tuple["Group", Variable]]:
        for v in self.variables:
            yield self, v
        for g in self.groups:
            yield from g.walk()

    def all_variables(self) -> list[Variable]:
        return [v for _, v in self.walk()]

    def find_variable_by_attribute(self, name: str, value: object) -> Variable | None:
        return next((v for v in self.all_variables() if (a := v.attribute(name)) and a.values and a.values[0] == value), None)

    def find_group(self, path: str) -> "Group | None":
        g: Group | None = self
        for part in filter(None, path.split("/")):
            g = next((x for x in g.groups if x.name == part), None) if g else None
        return g

    def _in_group(self, path: str) -> tuple["Group | None", str]:
        head, _, last = path.rpartition("/")
        return self.find_group(head), last

    def find_variable(self, path: str) -> Variable | None:
        g, name = self._in_group(path)
        return next((v for v in g.variables if v.name == name), None) if g else None

    def find_dimension_at(self, path: str) -> Dimension | None:
        g, name = self._in_group(path)
        return next((d for d in g.dims if d.name == name), None) if g else None

    def find_attribute_at(self, path: str) -> Attribute | None:
        """`/g1/g2/var@att`, `/g1@att` or `@att`; a name that is both a group and a variable is ambiguous."""
        owner, _, att = path.rpartition("@")
        if not owner.strip("/"):
            return self.find_attribute(att)
        g, v = self.find_group(owner), self.find_variable(owner)
        if g and v:
            raise ValueError(f"ambiguous name {owner}")
        return g.find_attribute(att) if g else v.attribute(att) if v else None


def common_parent(a: Group, b: Group) -> Group:
    above = []
    g: Group | None = a
    while g:
        above.append(g)
        g = g.parent
    g = b
    while not any(g is x for x in above):
        g = g.parent
    return g


__all__ = ["Attribute", "Datatype", "Dimension", "Group", "Member", "Variable", "common_parent", "replace", "valid_name"]
