"""Opening files by content, and reading their variables as cells or chunks through the `cdm` data source."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tessella.cdl import cdl
from tessella.model import Datatype, Group, Variable
from tessella.operators.layout import Tiling, max_chunks, size, strides
from tessella.operators.section import Range, fill
from tessella.runtime import ship
from tessella.sources import h4, h5, nc3
from tessella.sources.read import read_section
from tessella.sources.sniff import sniff

MAX_ELEMENTS = 100_000


@dataclass
class Dataset:
    path: str
    type: str
    root: Group
    size: int

    def cdl(self) -> str:
        return cdl(self.root, self.type.strip(), os.path.basename(self.path))

    def cells(self, spark: SparkSession, variable: str, section: str | None = None) -> DataFrame:
        return read_cells(spark, self.path, variable, section)

    def chunks(self, spark: SparkSession, variable: str, section: str | None = None, max_elements: int = MAX_ELEMENTS) -> DataFrame:
        return read_cells(spark, self.path, variable, section, "chunks", max_elements)


def open_dataset(path: str, strict: bool = False) -> Dataset | None:
    """The file's tree; None if its format is unknown."""
    path = path.strip()
    found = sniff(path)
    if found is None:
        return None
    kind, base = found
    n = os.path.getsize(path)
    if kind.startswith("netcdf3"):
        return Dataset(path, kind, nc3.read_header(path), n)
    if kind == "hdf5":
        tree = h5.Tree(path, strict, base)
        eos = h4.apply_struct_metadata(tree.root)
        return Dataset(path, "hdf-eos5" if eos else "netcdf4" if tree.is_netcdf4 else "hdf5", tree.root, n)
    root = h4.read_tree(path, strict)
    return Dataset(path, "hdf-eos2" if h4.apply_struct_metadata(root) else "hdf4", root, n)


def read_cells(spark: SparkSession, path: str, variable: str, section: str | None = None, layout: str = "cells", max_elements: int = MAX_ELEMENTS) -> DataFrame:
    spark.dataSource.register(CdmSource)
    # A reader that takes filters is refused without this setting, which is read when the plan runs.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = spark.read.format("cdm").option("path", path).option("variable", variable).option("layout", layout).option("max_elements", str(max_elements))
    return (r.option("section", section) if section else r).load()


def local_path(uri: str) -> str:
    """A file's path from Spark's name for it; only what all machines mount can be opened."""
    parts = urlsplit(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{uri}: files are opened by path, on a file system that all machines mount")
    return unquote(parts.path) if parts.scheme else uri


def read_files(spark: SparkSession, pattern: str, variable: str, section: str | None = None, layout: str = "cells", max_elements: int = MAX_ELEMENTS, like: str | None = None) -> DataFrame:
    """A variable's cells or chunks from every file of a folder or pattern, with the file's path as `file`.

    Spark lists the files and packs them into tasks by size; each is opened where it is read, and the driver opens one,
    `like` or the least path, for the schema. Files of unknown format or without the variable give no rows; one whose
    variable has another rank or type is an error. Lengths may differ, and the section must lie within each."""
    ship(spark)
    files = spark.read.format("binaryFile").load(pattern).select("path")
    least = like or files.agg(F.min("path")).first()[0]
    if least is None:
        raise ValueError(f"{pattern}: no files")
    options = {"variable": variable, "layout": layout, "max_elements": str(max_elements)} | ({"section": section} if section else {})
    schema = CdmSource(options | {"path": local_path(least)}).schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in map(local_path, batch.column(0).to_pylist()):
                ds = open_dataset(path)
                if ds is None or ds.root.find_variable(variable) is None:
                    continue
                if CdmSource(options | {"path": path}).schema() != schema:
                    raise ValueError(f"{path}: {variable} has another rank or type than in {least}")
                reader = CdmReader(schema, options | {"path": path})
                for part in reader.partitions():
                    for b in reader.read(part):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * b.num_rows, pa.string()), *b.columns], ["file", *b.schema.names])

    return files.mapInArrow(run, T.StructType([T.StructField("file", T.StringType()), *schema.fields]))


def plan(v: Variable, section: list[Range], max_elements: int) -> list[list[Range]]:
    """Boxes of a section: whole storage tiles where there are any, else pieces of bounded size."""
    if not v.shape or not size([len(r) for r in section]):
        return [section] if not v.shape else []
    if v.storage["kind"] == "fill" or v.storage["kind"] != "chunked":
        return list(max_chunks(section, max_elements))
    tiling = Tiling(tuple(v.shape), tuple(v.storage["chunk"]))
    cover = tiling.cover(section)
    counts, out = [len(r) for r in cover], []
    for number in range(size(counts)):
        tile = [r.start + number // w % n for r, w, n in zip(cover, strides(counts), counts, strict=True)]
        start = tiling.index(tile)
        out.append([Range(max(r.start, s), min(r.last, s + c - 1)) for r, s, c in zip(section, start, tiling.chunk, strict=True)])
    return out


@dataclass
class Boxes(InputPartition):
    boxes: list[list[Range]]
    variable: Variable


def python_values(path: str, v: Variable, data: np.ndarray) -> list:
    """Elements in row-major order as Spark takes them."""
    t = v.type
    if t.name in ("vlen", "string", "opaque", "compound"):
        with_heap = t.name == "vlen" or t.name == "string" and t.base is not None or t.name == "compound"
        raw = np.ascontiguousarray(data).tobytes()
        width = t.size or data.dtype.itemsize
        parts = [raw[k * width : (k + 1) * width] for k in range(data.size)]
        if with_heap and v.storage.get("heap", True) and v.storage.get("base") is not None:
            f = h5.File(path, v.storage["base"])
            with f.f:
                return [f.value(t, p) for p in parts]
        if t.name == "string":
            return [p.split(b"\0")[0].decode(errors="replace") for p in parts]
        return [h4.record(t, p) for p in parts] if t.name == "compound" else parts
    return data.ravel().tolist()


def arrow_values(path: str, v: Variable, data: np.ndarray, kind: pa.DataType) -> pa.Array:
    t = v.type
    if t.name in ("vlen", "string", "opaque", "compound"):
        return pa.array(python_values(path, v, data), kind)
    native = np.ascontiguousarray(data.ravel()).astype(data.dtype.newbyteorder("="))
    return pa.array(native).cast(kind)


class CdmReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.path, self.layout = options["path"], options.get("layout", "cells")
        ds = open_dataset(self.path)
        if ds is None:
            raise ValueError(f"{self.path}: unknown format")
        found = ds.root.find_variable(options["variable"])
        if found is None:
            raise ValueError(f"{self.path} has no variable {options['variable']}")
        self.variable, self.kind = found, schema
        self.section = fill(options.get("section"), found.shape)
        self.max_elements = int(options.get("max_elements", MAX_ELEMENTS))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of an index with a number cut the section, so only the tiles they leave are planned."""
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if self.layout == "cells" and name.startswith("d") and name[1:].isdigit() and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                k, x = int(name[1:]), int(f.value)
                r = self.section[k]
                lo = x if isinstance(f, EqualTo | GreaterThanOrEqual) else x + 1 if isinstance(f, GreaterThan) else r.start
                hi = x if isinstance(f, EqualTo | LessThanOrEqual) else x - 1 if isinstance(f, LessThan) else r.last
                if r.step == 1:
                    self.section[k] = Range(max(r.start, lo), min(r.last, hi))
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        if self.variable.shape and not all(len(r) for r in self.section):
            return [Boxes([], self.variable)]
        dense = [Range(r.start, r.last) for r in self.section]
        out, held, n = [], [], 0
        for box in plan(self.variable, dense, self.max_elements):
            held.append(box)
            n += size([len(r) for r in box])
            if n >= self.max_elements:
                out.append(held)
                held, n = [], 0
        if held or not out:
            out.append(held)
        # A partition carries only the tiles it reads.
        return [Boxes(boxes, self._slim(boxes)) for boxes in out]

    def _slim(self, boxes: list[list[Range]]) -> Variable:
        v, st = self.variable, self.variable.storage
        if st["kind"] != "chunked":
            return v
        keys = {tuple(r.start // c * c for r, c in zip(b, st["chunk"], strict=True)) for b in boxes}
        return Variable(v.name, v.type, v.dims, (), st | {"index": {k: x for k, x in st["index"].items() if k in keys}})

    def read(self, partition: Boxes) -> Iterator[pa.RecordBatch]:
        v, shape = partition.variable, partition.variable.shape
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.kind)
        for box in partition.boxes:
            data = read_section(self.path, v, box)
            if self.layout == "chunks":
                missing = v.storage["kind"] == "fill" or v.storage["kind"] == "chunked" and not v.storage["index"].get(tuple(r.start // c * c for r, c in zip(box, v.storage["chunk"], strict=True)))
                row = {"start": [r.start for r in box], "shape": [len(r) for r in box], "missing": bool(missing)}
                values = arrow_values(self.path, v, data, kind.field("data").type.value_type)
                packed = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind.field("data").type)
                yield pa.RecordBatch.from_arrays([pa.array([row["start"]], kind.field("start").type), pa.array([row["shape"]], kind.field("shape").type), pa.array([row["missing"]]), packed], schema=kind)
                continue
            index = [i.ravel() + r.start for i, r in zip(np.indices([len(r) for r in box]) if shape else [], box, strict=False)]
            keep = np.ones(data.size, bool)
            for i, r in zip(index, self.section, strict=False):
                keep &= (i - r.start) % r.step == 0
            elem = sum((i * s for i, s in zip(index, strides(shape), strict=True)), np.zeros(data.size, np.int64))
            columns = [pa.array(i[keep], pa.int64()) for i in [*index, elem]]
            values = arrow_values(self.path, v, data, kind.field("value").type)
            yield pa.RecordBatch.from_arrays([*columns, values.filter(pa.array(keep))], schema=kind)


class CdmSource(DataSource):
    """Options: path, variable, section, layout (cells or chunks), max_elements."""

    @classmethod
    def name(cls) -> str:
        return "cdm"

    def _variable(self) -> Variable:
        ds = open_dataset(self.options["path"])
        v = ds.root.find_variable(self.options["variable"]) if ds else None
        if v is None:
            raise ValueError(f"{self.options['path']} has no variable {self.options['variable']}")
        return v

    def schema(self) -> T.StructType:
        v = self._variable()
        value = v.type.spark()
        if self.options.get("layout") == "chunks":
            return T.StructType([T.StructField("start", T.ArrayType(T.LongType())), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("missing", T.BooleanType()), T.StructField("data", T.ArrayType(value))])
        return T.StructType([*[T.StructField(f"d{k}", T.LongType()) for k in range(len(v.shape))], T.StructField("elem", T.LongType()), T.StructField("value", value)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return CdmReader(schema, dict(self.options))


__all__ = ["CdmSource", "Dataset", "Datatype", "open_dataset", "read_cells", "read_files"]
