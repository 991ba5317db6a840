"""Queries over binary files. The files are written by rule, so SQL can state their content."""

from __future__ import annotations

import os
import struct
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tessella.plans.registry import query
from tessella.runtime import ship
from tessella.sources import fixtures as W



def _file(name: str, content: bytes) -> str:
    """A local file; readers on other machines need a folder that they share with the driver (TESSELLA_FIXTURES)."""
    folder = os.environ.get("TESSELLA_FIXTURES") or os.path.join(tempfile.gettempdir(), f"tessella-{os.getuid()}")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    draft = f"{path}.{os.getpid()}"
    with open(draft, "wb") as f:
        f.write(content)
    os.replace(draft, path)
    return path


def temperature(lat: int = 25, lon: int = 40) -> np.ndarray:
    return np.arange(lat * lon, dtype=np.float64).reshape(lat, lon) * 0.5 - 3


def nc3_file() -> str:
    rec = np.arange(12 * 6, dtype=np.int32).reshape(12, 6) * 7
    variables = [
        ("t", "double", ["lat", "lon"], temperature(), {"units": "K"}),
        ("a", "int", ["time", "x"], rec, {}),
        ("b", "float", ["time"], np.arange(12, dtype=np.float32) / 4, {}),
    ]
    return _file("records.nc", W.netcdf3({"lat": 25, "lon": 40, "time": 0, "x": 6}, variables, {"title": "by rule"}, 2, 12))


def h5_file() -> str:
    w = W.H5Writer()
    data = np.arange(90, dtype="<i4").reshape(10, 9)
    chunked = w.dataset(W.h5_fixed(4), data, [10, 9], chunk=[4, 4], deflate=True, shuffle=True, fill=struct.pack("<i", -1), missing={(4, 4)})
    plain = w.dataset(W.h5_float(8, ">"), temperature().astype(">f8"), [25, 40])
    enum = w.dataset(W.h5_enum(W.h5_fixed(1, False), 1, {0: "RED", 1: "GREEN", 2: "BLUE"}), (np.arange(12) % 4).astype("u1"), [12])
    inner = w.group({"t": plain})
    return _file("tiles.h5", w.finish(w.group({"data": chunked, "colour": enum, "inner": inner})))


def h4_file() -> str:
    w = W.H4Writer()
    ints = np.arange(60, dtype=">i4")
    a = w.data_set([6, 10], 24, w.deflated(702, (ints * 3).astype(">i4").tobytes()))
    b = w.data_set([60], 24, w.linked(702, (ints + 1000).astype(">i4").tobytes(), 64, 96))
    dims = [w.vgroup([], "rows", "Dim0.0"), w.vgroup([], "cols", "Dim0.0")]
    va = w.vgroup([(720, a), *((1965, d) for d in dims)], "grid", "Var0.0")
    vb = w.vgroup([(720, b)], "line", "Var0.0")
    w.vgroup([(1965, va), (1965, vb)], "file", "CDF0.0")
    recs = b"".join(struct.pack(">ih", k, k * k) for k in range(20))
    w.vdata("table", "", [("id", 24, 4, 1), ("square", 22, 2, 1)], 20, recs)
    return _file("sets.hdf", w.finish())


def cells(spark, path, variable, section=None):
    from tessella.sources.dataset import read_cells

    ship(spark)
    return read_cells(spark, path, variable, section)


@query("SELECT * FROM (VALUES ('records.nc', 'netcdf3.2', 3), ('tiles.h5', 'hdf5', 3), ('sets.hdf', 'hdf4', 3)) t(file, type, variables)")
def src_open(spark, d):
    from tessella.sources.dataset import open_dataset

    found = [open_dataset(p) for p in (nc3_file(), h5_file(), h4_file())]
    return spark.createDataFrame([(os.path.basename(x.path), x.type, len(x.root.all_variables())) for x in found], "file string, type string, variables int")


@query("SELECT CAST(a AS BIGINT) AS d0, CAST(b AS BIGINT) AS d1, CAST(a * 40 + b AS BIGINT) AS elem, (a * 40 + b) * 0.5 - 3 AS value FROM range(5, 20) x(a), range(10, 30) y(b)")
def src_nc3(spark, d):
    return cells(spark, nc3_file(), "t", "5:19, 10:29").withColumn("value", F.col("value").cast("double"))


@query("SELECT CAST(a AS BIGINT) AS d0, CAST(b AS BIGINT) AS d1, (a * 6 + b) * 7 AS value FROM range(0, 12) x(a), range(0, 6) y(b) WHERE a >= 3 AND b = 2")
def src_nc3_records(spark, d):
    """A filter on index columns reaches the reader as a smaller section."""
    return cells(spark, nc3_file(), "a").where("d0 >= 3 and d1 = 2").select("d0", "d1", "value")


@query("SELECT CAST(a AS BIGINT) AS d0, CAST(b AS BIGINT) AS d1, CASE WHEN a // 4 = 1 AND b // 4 = 1 THEN -1 ELSE a * 9 + b END AS value FROM range(0, 10) x(a), range(0, 9) y(b)")
def src_h5(spark, d):
    return cells(spark, h5_file(), "data").select("d0", "d1", "value")


@query("SELECT CAST(k AS BIGINT) AS d0, CASE k % 4 WHEN 0 THEN 'RED' WHEN 1 THEN 'GREEN' WHEN 2 THEN 'BLUE' ELSE 'Unknown enum number=3' END AS value FROM range(0, 12) t(k)")
def src_h5_enum(spark, d):
    from tessella.functions.convert import convert_enums

    return cells(spark, h5_file(), "colour").select("d0", convert_enums(F.col("value").cast("int"), {0: "RED", 1: "GREEN", 2: "BLUE"}).alias("value"))


@query("SELECT CAST(a AS BIGINT) AS d0, CAST(b AS BIGINT) AS d1, (a * 10 + b) * 3 AS value FROM range(0, 6) x(a), range(0, 10) y(b)")
def src_h4(spark, d):
    return cells(spark, h4_file(), "grid").select("d0", "d1", "value")


@query("SELECT CAST(k AS BIGINT) AS d0, k + 1000 AS value FROM range(7, 53) t(k)")
def src_h4_linked(spark, d):
    return cells(spark, h4_file(), "line", "7:52").select("d0", "value")


@query("SELECT CAST(k AS BIGINT) AS d0, k AS id, k * k AS square FROM range(0, 20) t(k)")
def src_h4_vdata(spark, d):
    return cells(spark, h4_file(), "table").select("d0", "value.id", "value.square")
