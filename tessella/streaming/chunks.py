"""User functions over chunks, in parallel with reading and decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def map_chunks(chunks: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str, each: bool = False) -> DataFrame:
    """fn over Arrow batches of chunk rows, or over each chunk alone; batches stay inside Spark's tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if each:
                yield from (fn(b.slice(k, 1)) for k in range(b.num_rows))
            else:
                yield fn(b)

    return chunks.mapInArrow(run, schema)


def stream_chunks(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Extension: chunk rows (Parquet) of a landing folder as a stream, for the same functions."""
    return spark.readStream.schema(schema).parquet(folder)
