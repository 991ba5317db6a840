"""Intermediate tables and what they leave behind."""

from pathlib import Path

from tessella.runtime import CLEAN_UP, materialize, release


def test_no_checksum_files(spark):
    """Checksum files, and the chmod of them and of the files, cost a fork of the JVM each."""
    out = materialize(spark.range(100).repartition(3, "id"), "plain")
    files = list(Path(out._tessella_path.removeprefix("file:")).rglob("*"))
    assert [f for f in files if f.name.startswith("part-")] and not [f for f in files if f.suffix == ".crc"]
    assert out.count() == 100
    release(out)


def test_shuffle_files_go(spark):
    """What a write has shuffled goes with it, and the session's setting is as before."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f.name for d in blocks.localDirs() for f in Path(d.getPath()).rglob("shuffle_*")}
    before, setting = held(), spark.conf.get(CLEAN_UP)
    out = materialize(spark.range(1000).repartition(7, "id"), "dealt")
    assert not held() - before and spark.conf.get(CLEAN_UP) == setting
    assert out.count() == 1000
    release(out)
