"""Corpus pipeline: language, line dedup, near-duplicate documents, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the next. All but
the last return the columns of documents. A document goes only when

1. language: its text is null or has no letter (`und`), so that no language can be given to it;
2. lines: every line of it is a copy or near copy of a line kept elsewhere; otherwise it goes on with the lines it keeps;
3. near_duplicates: it is not the first (least doc_id) of its component of five-word shingle sets with Jaccard >= 0.8, or
   it repeats a row's doc_id and text;
4. decontaminate: ten consecutive words of a benchmark item, or a whole shorter item, occur in it.

Rows without a doc_id are kept by 2 and 3.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.columns import hide, show
from tessella.llm.decontaminate import contamination
from tessella.llm.jaccard import jaccard_components
from tessella.llm.language import UNDETERMINED, identify
from tessella.llm.line_dedup import dedup_lines
from tessella.llm.packing import pack
from tessella.runtime import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which a language can be given."""
    rows, names = hide(docs)
    found = identify(rows, tuple(rows.columns), names["text"], names["doc_id"], names["lang"])
    return show(found.where(F.col("lang_pred") != UNDETERMINED), names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one occurrence of each group of near-equal lines left in the corpus; n_chars follows the text."""
    rows, names = hide(docs)
    text = names["text"]
    kept = dedup_lines(rows, text, names["doc_id"]).where((F.col("n_kept") > 0) & (F.trim(text) != ""))
    if "n_chars" in names:
        kept = kept.withColumn(names["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return show(kept, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates."""
    rows, names = hide(docs)
    key = names["doc_id"]
    found = jaccard_components(rows, text=names["text"], doc_id=key, extra=tuple(c for c in rows.columns if c != key))
    first = found.where(F.col(key).isNull() | (F.col(key) == F.col("component_id")))
    # Repeated rows are copies, too: of rows with one id and one text a single one stays.
    again = materialize(first.groupBy(key).agg(F.count(F.lit(1)).alias("__rows")).where(F.col(key).isNotNull() & (F.col("__rows") > 1)).select(F.col(key).alias("__again")), "again")
    repeated = F.col(key) == F.col("__again")
    once = first.join(again, repeated, "left_anti").unionByName(first.join(again, repeated, "left_semi").dropDuplicates([key, names["text"]]))
    return show(once, names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, names = hide(docs)
    found = contamination(rows, items, text=names["text"], keep=tuple(rows.columns))
    return show(found.where(F.size("spans") == 0), names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the remaining documents with its place in a sequence."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("packing", packing)]

#: SimHash, the vectors and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
