import struct

import numpy as np
import pytest

from tessella.sources import fixtures as W
from tessella.sources import odl
from tessella.sources.dataset import open_dataset, plan, read_cells, read_files
from tessella.sources.read import read_section
from tessella.sources.sniff import sniff
from tessella.operators.section import Range, fill


def write(tmp_path, name, content):
    p = tmp_path / name
    p.write_bytes(content)
    return str(p)


def values(path, name, section=None):
    v = open_dataset(path).root.find_variable(name)
    return read_section(path, v, fill(section, v.shape))


@pytest.mark.parametrize("version", [1, 2, 5])
def test_netcdf3(tmp_path, version):
    data = [
        ("t", "double", ["lat", "lon"], np.arange(12.0).reshape(3, 4), {"units": "K", "range": ("float", [0.5, 1.5])}),
        ("s", "short", ["lat"], np.array([-1, 0, 32767]), {"empty": ("int", [])}),
        ("b", "byte", [], np.array(-5), {}),
        ("a", "int", ["time", "lon"], np.arange(20).reshape(5, 4), {}),
        ("f", "float", ["time"], np.arange(5) / 2, {}),
    ]
    if version == 5:
        data += [("u", "ubyte", ["lat"], np.array([0, 128, 255]), {}), ("big", "uint64", ["lat"], np.array([0, 2**63, 2**64 - 1], np.uint64), {"u": ("uint", [4294967295])})]
    path = write(tmp_path, "a.nc", W.netcdf3({"lat": 3, "lon": 4, "time": 0}, data, {"title": "x"}, version, 5))
    ds = open_dataset(path)
    assert ds.type == {1: "netcdf3", 2: "netcdf3.2", 5: "netcdf3.5"}[version]
    assert [(d.name, d.length) for d in ds.root.dims] == [("lat", 3), ("lon", 4), ("time", 5)]
    assert ds.root.find_attribute("title").values == ("x",)
    assert ds.root.find_variable("s").attribute("empty").values == ()
    for name, _, _, want, _ in data:
        assert values(path, name).tolist() == np.asarray(want).tolist(), name
    assert values(path, "t", "1:2, 1:2").tolist() == [[5.0, 6.0], [9.0, 10.0]]
    assert values(path, "a", "1:3, 2").tolist() == [[6], [10], [14]]
    if version == 5:
        assert ds.root.find_variable("big").attribute("u").values == (4294967295,)
    assert "double t(lat, lon) ;" in ds.cdl()


def test_single_short_record_variable_is_not_padded(tmp_path):
    data = np.arange(15, dtype=np.int8).reshape(5, 3)
    path = write(tmp_path, "b.nc", W.netcdf3({"time": 0, "x": 3}, [("v", "byte", ["time", "x"], data, {})], {}, 1, 5))
    assert values(path, "v").tolist() == data.tolist()


def test_hdf5_layouts(tmp_path):
    w = W.H5Writer()
    data = np.arange(90, dtype="<i4").reshape(10, 9)
    chunks = w.dataset(W.h5_fixed(4), data, [10, 9], chunk=[4, 4], deflate=True, shuffle=True, fletcher=True, fill=struct.pack("<i", -1), missing={(4, 4)})
    big = w.dataset(W.h5_float(8, ">"), np.arange(6.0).astype(">f8"), [2, 3], attributes=[w.text("units", "m")])
    small = w.dataset(W.h5_fixed(2, False), np.array([1, 65535], "<u2"), [2], compact=True)
    inner = w.group({"big": big}, [w.text("note", "hello")])
    loop = w.group({"inner": inner, "chunks": chunks, "small": small})
    path = write(tmp_path, "a.h5", w.finish(loop))
    ds = open_dataset(path)
    assert ds.type == "hdf5" and ds.root.find_group("inner").find_attribute("note").values == ("hello",)
    want = data.copy()
    want[4:8, 4:8] = -1
    assert values(path, "chunks").tolist() == want.tolist()
    assert values(path, "chunks", "3:8, 2:5").tolist() == want[3:9, 2:6].tolist()
    assert values(path, "/inner/big", "0:1, 1").tolist() == [[1.0], [4.0]]
    assert values(path, "small").tolist() == [1, 65535]
    v = ds.root.find_variable("chunks")
    assert len(plan(v, [Range(0, 3), Range(0, 8)], 1000)) == 3


def test_hdf5_types(tmp_path, spark):
    w = W.H5Writer()
    colours = {0: "RED", 1: "GREEN"}
    enum = W.h5_enum(W.h5_fixed(1, False), 1, colours)
    comp = W.h5_compound(12, [("id", 0, W.h5_fixed(4)), ("colour", 4, enum), ("pair", 8, W.h5_array(W.h5_fixed(2), 2, [2]))])
    rows = b"".join(struct.pack("<iB3xhh", k, k % 2, k, -k) for k in range(3))
    lists = [[1], [1, 2, 3], []]
    vlen = w.vlens([np.array(x, "<i4").tobytes() for x in lists], [len(x) for x in lists])
    text = w.vlens([b"one", b"three", b""], [3, 5, 0])
    children = {
        "rec": w.dataset(comp, rows, [3]),
        "lists": w.dataset(W.h5_vlen(W.h5_fixed(4)), vlen, [3]),
        "words": w.dataset(W.h5_vlen(W.h5_string(1), True), text, [3]),
        "blob": w.dataset(W.h5_opaque(4, "tag"), bytes(range(8)), [2]),
        "e": w.dataset(enum, bytes([0, 1, 1]), [3]),
    }
    path = write(tmp_path, "t.h5", w.finish(w.group(children)))
    got = {n: [r["value"] for r in read_cells(spark, path, n).orderBy("elem").collect()] for n in children}
    assert [tuple(r) for r in got["rec"]] == [(0, 0, [0, 0]), (1, 1, [1, -1]), (2, 0, [2, -2])]
    assert got["lists"] == lists and got["words"] == ["one", "three", ""]
    assert got["blob"] == [bytes(range(4)), bytes(range(4, 8))] and got["e"] == [0, 1, 1]
    assert open_dataset(path).root.find_variable("e").type.values == colours


def test_hdf5_dimension_scales(tmp_path):
    w = W.H5Writer()
    scale = lambda n, data: w.dataset(W.h5_float(8), data, [len(data)], attributes=[w.text("CLASS", "DIMENSION_SCALE"), w.text("NAME", n)])
    lat, lon = scale("lat", np.arange(3.0)), scale("This is a netCDF dimension but not a netCDF variable         4", np.arange(4.0))
    refs = w.vlens([struct.pack("<Q", lat), struct.pack("<Q", lon)], [1, 1])
    t = w.dataset(W.h5_fixed(4), np.arange(12, dtype="<i4"), [3, 4], attributes=[w.attribute("DIMENSION_LIST", W.h5_vlen(W.h5_reference()), [2], refs)])
    hidden = w.dataset(W.h5_fixed(4), np.arange(2, dtype="<i4"), [2])
    path = write(tmp_path, "d.nc4", w.finish(w.group({"lat": lat, "lon": lon, "t": t, "_nc4_non_coord_z": hidden})))
    ds = open_dataset(path)
    assert ds.type == "netcdf4"
    assert [(d.name, d.length) for d in ds.root.find_variable("t").dims] == [("lat", 3), ("lon", 4)]
    assert ds.root.find_variable("lon") is None and ds.root.find_variable("z") is not None and ds.root.find_variable("lat") is not None


def dense(w, objects, kind, record, heads):
    """A fractal heap and a version 2 B-tree (leaf, or two leaves under an inner node) over objects; their addresses."""
    first, width = 512, 4
    blocks, held, ids = [], b"\0" * 20, []
    for o in objects:
        if len(held) + len(o) > first:
            blocks.append(held.ljust(first, b"\0"))
            held = b"\0" * 20
        ids.append((len(blocks) * first + len(held), len(o)))
        held += o
    blocks.append(held.ljust(first, b"\0"))
    places = [w.add(b"FHDB" + b[4:]) for b in blocks]
    rows = 0
    root = places[0]
    if len(places) > 1:
        rows = -(-len(places) // width)
        root = w.add(b"FHIB" + bytes(1) + bytes(8) + bytes(4) + b"".join(struct.pack("<Q", p) for p in places + [2**64 - 1] * (rows * width - len(places))) + bytes(4))
    heap = struct.pack("<4sBHHBI", b"FRHP", 0, 7, 0, 0, 4096) + bytes(96) + struct.pack("<HQQHHQH", width, first, 65536, 32, 1, root, rows) + bytes(8)
    made = [head + struct.pack("<BIH", 0, at, n) for head, (at, n) in zip(heads, ids, strict=True)] if kind == 5 else [struct.pack("<BIHB", 0, at, n, 0) + head for head, (at, n) in zip(heads, ids, strict=True)]
    assert all(len(r) == record for r in made)
    leaf = lambda r: w.add(b"BTLF" + bytes([0, kind]) + b"".join(r) + bytes(4))
    depth, k = 0, len(made) // 2
    if k > 2:
        a, b = leaf(made[:k]), leaf(made[k + 1 :])
        top, n, depth = w.add(b"BTIN" + bytes([0, kind]) + made[k] + struct.pack("<QBQB", a, k, b, len(made) - k - 1) + bytes(4)), 1, 1
    else:
        top, n = leaf(made), len(made)
    tree = w.add(struct.pack("<4sBBIHHBBQHQ", b"BTHD", 0, kind, 512, record, depth, 100, 40, top, n, len(made)) + bytes(4))
    return w.add(heap), tree


@pytest.mark.parametrize("count", [3, 40])
def test_hdf5_dense_groups_and_attributes(tmp_path, count):
    w = W.H5Writer()
    links = []
    for k in range(count):
        child = w.dataset(W.h5_fixed(4), np.array([k], "<i4"), [1])
        name = f"variable_{k:02d}".encode()
        links.append(struct.pack("<BBB", 1, 0, len(name)) + name + struct.pack("<Q", child))
    heap, tree = dense(w, links, 5, 11, [struct.pack("<I", k) for k in range(count)])
    atts = [w.text(f"att{k}", f"value {k}")[1] for k in range(4)]
    aheap, atree = dense(w, atts, 8, 17, [struct.pack("<BII", 0, k, k) for k in range(4)])
    root = w.header([(2, struct.pack("<BBQQ", 0, 0, heap, tree)), (0x15, struct.pack("<BBQQ", 0, 0, aheap, atree))])
    path = write(tmp_path, "dense.h5", w.finish(root))
    ds = open_dataset(path)
    assert [v.name for v in ds.root.variables] == [f"variable_{k:02d}" for k in range(count)]
    assert [int(values(path, f"variable_{k:02d}")[0]) for k in range(count)] == list(range(count))
    assert {a.name: a.values for a in ds.root.attributes} == {f"att{k}": (f"value {k}",) for k in range(4)}


def test_hdf4(tmp_path):
    w = W.H4Writer()
    a = np.arange(12, dtype=">i2")
    sd = w.data_set([3, 4], 22, w.deflated(702, a.tobytes()))
    raw = w.data_set([12], 22, w.linked(702, a.tobytes(), 8, 6))
    never = w.data_set([2], 23, 999)
    att = w.vdata("_FillValue", "Attr0.0", [("VALUES", 22, 2, 1)], 1, struct.pack(">h", -9))
    va = w.vgroup([(720, sd), (1965, w.vgroup([], "y", "Dim0.0")), (1965, w.vgroup([], "fakeDim1", "Dim0.0")), (1962, att)], "grid", "Var0.0")
    vb, vc = w.vgroup([(720, raw)], "line", "Var0.0"), w.vgroup([(720, never)], "never", "Var0.0")
    w.vgroup([(1965, v) for v in (va, vb, vc)], "f", "CDF0.0")
    w.vdata("one", "", [("x", 5, 4, 1)], 2, struct.pack(">ff", 1.5, 2.5))
    w.vdata("many", "", [("id", 24, 4, 1), ("tag", 4, 4, 4)], 2, struct.pack(">i4si4s", 7, b"ab\0\0", 8, b"cdef"))
    w.vdata("DimVal0", "DimVal0.1", [("v", 24, 4, 1)], 1, struct.pack(">i", 3))
    w.add(101, b"first\0")
    path = write(tmp_path, "a.hdf", w.finish())
    ds = open_dataset(path)
    grid = ds.root.find_variable("grid")
    assert [(d.name, d.length) for d in grid.dims] == [("y", 3), ("", 4)] and grid.attribute("_FillValue").values == (-9,)
    assert values(path, "grid", "1:2, 0:1").tolist() == [[4, 5], [8, 9]]
    assert values(path, "line", "2:9").tolist() == list(range(2, 10))
    assert values(path, "never").tolist() == [32769, 32769]
    assert values(path, "one").tolist() == [1.5, 2.5]
    assert {v.name for v in ds.root.all_variables()} == {"grid", "line", "never", "one", "many"}
    assert ds.root.find_attribute("FileAnnotation.1").values == ("first",)


def test_filters_reach_the_reader(tmp_path, spark):
    w = W.H5Writer()
    data = np.arange(400, dtype="<i4").reshape(20, 20)
    path = write(tmp_path, "p.h5", w.finish(w.group({"v": w.dataset(W.h5_fixed(4), data, [20, 20], chunk=[5, 5])})))
    part = read_cells(spark, path, "v").where("d0 >= 6 and d0 < 8 and d1 = 3")
    assert sorted(r["value"] for r in part.collect()) == [123, 143]
    chunks = read_cells(spark, path, "v", "0:9, 0:4", layout="chunks").orderBy("start").collect()
    assert [(r["start"], r["shape"], sum(r["data"])) for r in chunks] == [([0, 0], [5, 5], int(data[:5, :5].sum())), ([5, 0], [5, 5], int(data[5:10, :5].sum()))]
    strided = read_cells(spark, path, "v", "0:19:10, 0:19:5")
    assert sorted(r["value"] for r in strided.collect()) == data[::10, ::5].ravel().tolist()


def test_sniff(tmp_path):
    assert sniff(write(tmp_path, "x", b"nothing at all")) is None and open_dataset(write(tmp_path, "e", b"")) is None
    assert sniff(write(tmp_path, "y", b"\0" * 512 + b"\x89HDF\r\n\x1a\n")) == ("hdf5", 512)


ODL = """GROUP=GridStructure
 GROUP=GRID_1
  GridName="My Grid"
  XDim=4
  GROUP=Dimension
   OBJECT=Dimension_1
    DimensionName="Band"
    Size=3
   END_OBJECT=Dimension_1
  END_GROUP=Dimension
  GROUP=DataField
   OBJECT=DataField_1
    DataFieldName="temp"
    DimList=("Band",
     "XDim","Other")
   END_OBJECT=DataField_1
  END_GROUP=DataField
 END_GROUP=GRID_1
END_GROUP=GridStructure
END
"""


def test_odl():
    s = odl.transform(odl.parse(ODL))
    assert [(x.name, x.dims, x.fields) for x in s] == [("My Grid", {"Band": 3, "XDim": 4}, {"Data Fields": {"temp": ["Band", "XDim", "Other"]}})]
    assert odl.missing_dims(s[0]) == ["Other"]
    with pytest.raises(ValueError, match="closes nothing"):
        odl.parse("GROUP=A\nEND_GROUP=B")
    from tessella.model import Group

    assert odl.apply(Group(""), "END_GROUP=x") is False


def test_format_numbers():
    from tessella.sources import sniff as S

    assert S.format_name(3) == "NC_FORMAT_NETCDF4" and S.extended_name(10) == "NC_FORMATX_NCZARR"
    assert S.is_classic("NC_FORMAT_64BIT_DATA") and S.is_netcdf4("NC_FORMAT_NETCDF4_CLASSIC") and not S.is_extended_model("NC_FORMAT_CLASSIC")
    for f in (S.format_name, S.extended_name):
        with pytest.raises(ValueError, match="unknown"):
            f(77)


def test_eos_metadata_of_hdf4(tmp_path):
    w = W.H4Writer()
    text = ODL.replace("END\n", "")
    att = w.vdata("StructMetadata.0", "Attr0.0", [("VALUES", 4, len(text), len(text))], 1, text.encode())
    big = w.vdata("history", "Attr0.0", [("VALUES", 4, 5000, 5000)], 1, b"h" * 5000)
    a = np.arange(24, dtype=">i2")
    sd = w.data_set([3, 4, 2], 22, w.add(702, a.tobytes()))
    field_ = w.vgroup([(720, sd)], "temp", "Var0.0")
    fields = w.vgroup([(1965, field_)], "Data Fields", "GRID Vgroup")
    w.vgroup([(1965, fields)], "My Grid", "GRID")
    w.vgroup([(1962, att), (1962, big)], "file", "CDF0.0")
    path = write(tmp_path, "eos.hdf", w.finish())
    ds = open_dataset(path)
    assert ds.type == "hdf-eos2"
    assert ds.root.find_variable("/EosMetadata/StructMetadata.0") is not None and ds.root.find_variable("history") is not None
    v = ds.root.find_variable("/My_Grid/Data_Fields/temp")
    assert [(d.name, d.length) for d in v.dims] == [("Band", 3), ("XDim", 4), ("Other", 2)]
    assert open_dataset(path, strict=True).root.find_attribute("history").values == ("h" * 5000,)


def test_records():
    from tessella.sources.structs import Record

    r = Record(">").field("n", "H").array("tags", "H", "n").skip(1).text("name", lambda v: v["n"] + 1)
    assert r.read(b"\0\2\0\5\0\6-abc") == ({"n": 2, "tags": [5, 6], "name": "abc"}, 10)


def test_many_files(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    want = {}
    for k in range(7):
        n = 2 + k % 3
        data = np.arange(n * 4).reshape(n, 4) + 100 * k
        path = write(folder, f"{k}.nc", W.netcdf3({"x": n, "y": 4}, [("v", "int", ["x", "y"], data, {})], {}, 1, 0))
        want |= {(path, i, j): int(data[i, j]) for i in range(n) for j in range(4)}
    write(folder, "other.nc", W.netcdf3({"x": 1}, [("w", "int", ["x"], np.zeros(1, int), {})], {}, 1, 0))
    write(folder, "text.nc", b"not a data file")
    got = read_files(spark, str(folder), "v")
    assert got.columns == ["file", "d0", "d1", "elem", "value"]
    assert {(r.file, r.d0, r.d1): r.value for r in got.collect()} == want
    some = read_files(spark, f"{folder}/[0-6].nc", "v", "1, 1:2").collect()
    assert {(r.file, r.d0, r.d1): r.value for r in some} == {k: x for k, x in want.items() if k[1] == 1 and k[2] in (1, 2)}
    chunks = read_files(spark, f"{folder}/[0-6].nc", "v", layout="chunks").collect()
    assert sorted(x for r in chunks for x in r.data) == sorted(want.values())
    write(folder, "9.nc", W.netcdf3({"x": 3}, [("v", "int", ["x"], np.zeros(3, int), {})], {}, 1, 0))
    with pytest.raises(Exception, match="another rank"):
        read_files(spark, str(folder), "v").collect()


def test_each_chunk_alone(spark):
    import pyarrow as pa

    from tessella.streaming.chunks import map_chunks

    chunks = spark.range(20, numPartitions=2)
    rows = map_chunks(chunks, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]), "n long", each=True).collect()
    assert [r.n for r in rows] == [1] * 20


def test_breadth_first(spark):
    from tessella.operators.tree import breadth_first

    links = [(k, k + 1) for k in range(12)] + [(12, 0), (3, 3), (0, 5), (20, 21), (None, 1), (4, None)]
    got = breadth_first(spark.createDataFrame(links, "parent long, node long"), spark.createDataFrame([(0,), (None,)], "node long"))
    assert {r.node: r.depth for r in got.collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4} | {k: k - 4 for k in range(5, 13)}
    none = breadth_first(spark.createDataFrame([], "parent long, node long"), spark.createDataFrame([], "node long"))
    assert none.count() == 0
