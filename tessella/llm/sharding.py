"""Size-tiered compaction of a table of immutable shards under an atomically committed, versioned manifest.

A store is a folder with data files and manifests. Appending writes arrivals as small shards and commits a manifest
that lists them. Compaction puts shards into tiers by size (each tier `fanout` times the one before); a tier with at
least `fanout` shards is merged by whole files into target-sized ones, without a shuffle, and the manifest that
replaces them is committed; full shards are left alone. Every version stays readable until vacuum() removes it.

A manifest is written beside its place and then given its name, which must not exist: by a hard link on a local or
mounted file system, by a rename elsewhere, which HDFS refuses if the name is taken. So of two writers one gets
CommitConflict. append() then tries again on the new version, since arrivals do not depend on what is there; compact()
starts anew. A lost executor or driver leaves the last version intact.

vacuum() removes older versions, the files that only they list, and files in no version that are older than `orphans_s`
seconds, which are left over from failed writers; younger ones may belong to a writer that has yet to commit.

Columns, nulls and repeated rows pass through unchanged; an empty table commits a version without shards. Arrivals with
new columns widen the table, whose older rows have null there; a column of another type is refused (SchemaConflict).
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessella.runtime import _fs

TARGET_BYTES, FANOUT = 128 << 20, 4
SHARD_ROWS = 32_768
ORPHANS_S = 7 * 86_400
TRIES = 20


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class SchemaConflict(ValueError):
    """Arrivals have a column of another type than the table."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT, shard_rows: int = SHARD_ROWS):
        self.spark, self.root, self.target, self.fanout, self.shard_rows = spark, root.rstrip("/"), target, fanout, shard_rows

    # manifests

    def _names(self, folder: str) -> list[tuple[str, int]]:
        p, fs = _fs(self.spark, f"{self.root}/{folder}")
        return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, _ in self._names("manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The latest (or a given) version: {version, schema, shards}; version 0 is empty."""
        version = (self.versions() or [0])[-1] if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        p, fs = _fs(self.spark, f"{self.root}/manifests/v{version:08d}.json")
        stream = fs.open(p)
        try:
            raw = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        out = json.loads(raw)
        return out | {"shards": [Shard(**s) for s in out["shards"]]}

    def commit(self, base: dict, shards: list[Shard], schema: str | None) -> dict:
        """Make `shards` the version after `base`, or raise CommitConflict."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": [asdict(s) for s in shards]}
        place, fs = _fs(self.spark, f"{self.root}/manifests/v{new['version']:08d}.json")
        draft, _ = _fs(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        try:
            if fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), place.toUri().getPath())
            elif fs.exists(place) or not fs.rename(draft, place):
                raise FileExistsError
        except FileExistsError as e:
            raise CommitConflict(f"version {new['version']} exists") from e
        finally:
            fs.delete(draft, False)
        return self.manifest(new["version"])

    # data

    def _write(self, df: DataFrame) -> list[Shard]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", self.shard_rows).parquet(f"{self.root}/{folder}")
        return [Shard(f"{folder}/{n}", size) for n, size in self._names(folder) if n.endswith(".parquet")]

    def _widened(self, schema: str | None, df: DataFrame) -> str:
        """The table's schema with the new columns of df."""
        known = StructType.fromJson(json.loads(schema)) if schema else StructType()
        types = {f.name: f.dataType for f in known}
        for f in df.schema:
            if f.name not in types:
                known = StructType([*known.fields, StructField(f.name, f.dataType, True)])
            elif types[f.name].simpleString() != f.dataType.simpleString():
                raise SchemaConflict(f"{f.name}: {f.dataType.simpleString()}, in the table {types[f.name].simpleString()}")
        return known.json()

    def append(self, df: DataFrame) -> dict:
        self._widened(self.manifest()["schema"], df)
        new = self._write(df)
        for k in range(TRIES):
            base = self.manifest()
            try:
                return self.commit(base, base["shards"] + new, self._widened(base["schema"], df))
            except CommitConflict:
                if k == TRIES - 1:
                    raise
        raise AssertionError

    def _read(self, shards: list[Shard], schema: str) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read(m["shards"], m["schema"])

    def tiers(self, shards: list[Shard]) -> dict[int, list[Shard]]:
        """Unfinished shards by tier; those of at least half the target are finished."""
        out: dict[int, list[Shard]] = {}
        smallest = min((s.bytes for s in shards), default=1) or 1
        for s in shards:
            if s.bytes * 2 < self.target:
                out.setdefault(int(math.log(max(s.bytes, 1) / smallest, self.fanout) + 1e-9), []).append(s)
        return out

    def _merge(self, shards: list[Shard], schema: str) -> list[Shard]:
        files = max(1, round(sum(s.bytes for s in shards) / self.target))
        folder = f"data/{uuid.uuid4().hex}"
        self._read(shards, schema).coalesce(files).write.parquet(f"{self.root}/{folder}")
        return [Shard(f"{folder}/{n}", size) for n, size in self._names(folder) if n.endswith(".parquet")]

    def compact(self) -> dict:
        """Merge tiers until none has `fanout` shards; each round commits one version, or raises CommitConflict."""
        while True:
            base = self.manifest()
            due = {t: s for t, s in self.tiers(base["shards"]).items() if len(s) >= self.fanout}
            if not due:
                return base
            gone = {s.path for group in due.values() for s in group}
            made = [m for group in due.values() for m in self._merge(sorted(group, key=lambda s: s.path), base["schema"])]
            base = self.commit(base, [s for s in base["shards"] if s.path not in gone] + made, base["schema"])

    def vacuum(self, orphans_s: float = ORPHANS_S) -> None:
        """Remove the versions before the latest, files that only they list, and files in no version older than orphans_s."""
        last = self.manifest()
        listed = {s.path for s in last["shards"]}
        older = [self.manifest(v) for v in self.versions() if v < last["version"]]
        gone = {s.path for m in older for s in m["shards"]} - listed
        before = (time.time() - orphans_s) * 1000
        for folder, _ in self._names("data"):
            p, fs = _fs(self.spark, f"{self.root}/data/{folder}")
            for status in fs.listStatus(p):
                name = f"data/{folder}/{status.getPath().getName()}"
                if name not in listed and name.endswith(".parquet") and (name in gone or status.getModificationTime() < before):
                    fs.delete(status.getPath(), False)
        for m in older:
            p, fs = _fs(self.spark, f"{self.root}/manifests/v{m['version']:08d}.json")
            fs.delete(p, False)


def shard_members(store: ShardStore) -> DataFrame:
    """The latest version's rows with shard (file name) and version, which take the place of columns with these names."""
    m = store.manifest()
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return store.read(m["version"]).withColumn("shard", name).withColumn("version", F.lit(m["version"]).cast("long"))
