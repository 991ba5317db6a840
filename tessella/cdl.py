"""Text form of a tree of groups, everything sorted by name."""

from __future__ import annotations

from tessella.model import Attribute, Datatype, Group, Variable

SUFFIX = {"float": "f", "short": "s", "byte": "b"}
ESCAPES = (("\b", "\\b"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\\", "\\\\"), ("'", "\\'"), ('"', '\\"'))


def escape(text: str) -> str:
    out = text
    for c, to in ESCAPES:
        if c in text:
            out = out.replace(c, to)
    return out


def dims_text(dims: tuple[int, ...]) -> str:
    return f"({', '.join(map(str, dims))})" if dims else ""


def type_name(t: Datatype) -> str:
    return t.typedef or (f"{t.base.name}(*)" if t.name == "vlen" else t.name)


def typedef_text(t: Datatype, pad: str) -> str:
    if t.is_enum:
        return f"{pad}{t.name} {t.typedef} {{{', '.join(f"'{n}' = {v}" for v, n in t.values.items())}}};"
    if t.name == "compound":
        inner = "".join(f"{pad}  {type_name(m.type)} {m.name}{dims_text(m.dims)} ;\n" for m in t.members)
        return f"{pad}compound {t.typedef} {{\n{inner}{pad}}}; // {t.typedef}"
    if t.name == "opaque":
        return f"{pad}opaque({t.size}) {t.typedef} ;"
    return f"{pad}{t.base.name}(*) {t.typedef} ;"


def attribute_text(a: Attribute, owner: str, pad: str) -> str:
    def one(v: object) -> str:
        if v is None or a.is_string and v == "":
            return "NIL" if v is None else '""'
        if a.type.is_enum:
            return f'"{a.type.values.get(int(v), f"Unknown enum number={v}")}"'
        if isinstance(v, bytes):
            return "0X" + v.hex().upper()
        return f'"{escape(v)}"' if isinstance(v, str) else f"{v}{SUFFIX.get(a.type.name, '')}"

    return f"{pad}{owner}:{a.name} = {', '.join(map(one, a.values)) or 'NIL'} ;"


def variable_text(v: Variable, pad: str) -> str:
    dims = f"({', '.join(d.name if d.shared else str(d.length) for d in v.dims)})" if v.dims else ""
    rows = [f"{pad}{type_name(v.type)} {v.name}{dims} ;"]
    rows += [attribute_text(a, "", pad + "  ") for a in sorted(v.attributes, key=lambda a: a.name)]
    return "\n".join(rows)


def group_text(g: Group, pad: str = "") -> str:
    p, q, rows = pad + "  ", pad + "    ", []
    if g.typedefs:
        rows += [f"{p}types:", *(typedef_text(t, q) for t in sorted(g.typedefs, key=lambda t: t.typedef))]
    if g.dims:
        rows += [f"{p}dimensions:", *(f"{q}{d.name} = {d.length} ;" for d in sorted(g.dims, key=lambda d: d.name))]
    if g.variables:
        rows += [f"{p}variables:", *(variable_text(v, q) for v in sorted(g.variables, key=lambda v: v.name))]
    for s in sorted(g.groups, key=lambda s: s.name):
        rows += ["", f"{p}group: {s.name} {{", group_text(s, p), f"{p}}}"]
    if g.attributes:
        rows += ["", f"{p}// {'global' if g.parent is None else 'group'} attributes:", *(attribute_text(a, "", p) for a in sorted(g.attributes, key=lambda a: a.name))]
    return "\n".join(rows)


def cdl(root: Group, file_type: str, name: str) -> str:
    return f"{file_type} {name} {{\n{group_text(root)}\n}}\n"
