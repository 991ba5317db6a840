import pytest

from tessella.cdl import attribute_text, escape, group_text, typedef_text
from tessella.functions.convert import FILL, FILL_SD, with_signedness
from tessella.model import Attribute, Datatype, Dimension, Group, Member, Variable, common_parent, valid_name

INT, STR = Datatype("int", 4), Datatype("string")


def tree():
    root = Group("")
    gramps = root.add_group("gramps")
    parent, uncle = gramps.add_group("parent"), gramps.add_group("uncle")
    root.add_dimension(Dimension("d", 4))
    parent.add_dimension(Dimension("d", 2))
    parent.add_variable(Variable("vleaf", INT, (Dimension("d", 2),), (Attribute("units", STR, ("m",)),)))
    uncle.add_variable(Variable("voff", INT, ()))
    root.add_variable(Variable("vroot", INT, ()))
    gramps.attributes.append(Attribute("note", STR, ("x",)))
    return root


def test_lookup():
    root = tree()
    assert root.find_variable("/gramps/parent/vleaf").name_and_shape() == "int vleaf[2]"
    assert root.find_variable("/gramps/vleaf") is None
    assert root.find_attribute_at("/gramps/parent/vleaf@units").values == ("m",)
    assert root.find_attribute_at("/gramps@note").values == ("x",)
    assert root.find_attribute_at("@nope") is None
    assert [v.name for v in root.all_variables()] == ["vroot", "vleaf", "voff"]
    assert root.find_variable_by_attribute("units", "m").name == "vleaf"
    assert root.find_nested_group("uncle").full_name() == "/gramps/uncle"
    parent, uncle = root.find_group("/gramps/parent"), root.find_group("gramps/uncle")
    assert parent.find_dimension("d").length == 2 and uncle.find_dimension("d").length == 4
    assert common_parent(parent, uncle).name == "gramps"
    assert uncle.dimension_of("17", "v") == Dimension("", 17, False)
    with pytest.raises(ValueError, match="unknown dimension 'q' in Variable 'v'"):
        uncle.dimension_of("q", "v")


def test_duplicates_and_empty_groups():
    root = tree()
    with pytest.raises(ValueError, match="duplicate dimension"):
        root.add_dimension(Dimension("d", 9))
    root.add_variable(Variable("vroot", STR, ()))
    assert root.find_variable("vroot").type == INT
    root.add_group("empty").add_group("inner")
    root.remove_empty()
    assert [g.name for g in root.groups] == ["gramps"]


def test_names_and_types():
    assert valid_name(" a/b c,d\x01 ") == "a_b_c_d"
    assert with_signedness("int", False) == "uint" and with_signedness("uint64", True) == "int64" and with_signedness("double", False) == "double"
    assert Datatype("ubyte enum", 1, values={1: "a"}) == Datatype("ubyte enum", 1, values={2: "b"})
    assert Datatype("uint").is_unsigned and Datatype("float").is_numeric and not Datatype("char").is_integral
    assert FILL["ubyte"] == 255 and FILL_SD["ubyte"] == 129 and FILL["uint64"] == 18446744073709551614


def test_text():
    assert typedef_text(Datatype("opaque", 42, typedef="viva"), "") == "opaque(42) viva ;"
    assert typedef_text(Datatype("vlen", 16, base=Datatype("uint"), typedef="viva"), "") == "uint(*) viva ;"
    c = Datatype("compound", 12, members=(Member("a", INT, 0, (1, 2, 3)), Member("b", STR, 24)), typedef="fracture")
    assert typedef_text(c, "") == "compound fracture {\n  int a(1, 2, 3) ;\n  string b ;\n}; // fracture"
    e = Datatype("ubyte enum", 1, values={0: "Mike", 3: "Marsha"})
    assert attribute_text(Attribute("x", e, (0, 3, 9)), "", "") == ':x = "Mike", "Marsha", "Unknown enum number=9" ;'
    assert attribute_text(Attribute("x", STR, ()), "", "") == ":x = NIL ;"
    assert attribute_text(Attribute("x", Datatype("float", 4), (1.5,)), "", "") == ":x = 1.5f ;"
    assert escape('a"b\nc') == 'a\\"b\\nc' and escape("a\\\n") == "a\\\\\\\\n"
    text = group_text(tree())
    assert text.index("group: parent") < text.index("group: uncle") and "int vleaf(d) ;" in text
