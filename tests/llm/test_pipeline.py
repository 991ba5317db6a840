"""Stages and the whole pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest

from tessella.runtime import materialize

WORDS = [f"{a}{b}en" for a in "bcdfghklmnprst" for b in ("a", "e", "i", "o", "u", "ar", "el", "in", "or", "us")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    prose = lambda n: "\n".join(" ".join(rng.choice(WORDS) for _ in range(n // 4)) for _ in range(4))
    clean = [(k, prose(rng.choice([40, 120, 400])), "en", f"src{k % 3}", 0) for k in range(40)]
    bench = [(k, " ".join(rng.choice(WORDS) for _ in range(30))) for k in range(5)]
    words = clean[3][1].split(" ")
    words[5] = "changed"
    planted = [
        (100, clean[2][1], "en", "src0", 0),
        (101, None, None, None, None),
        (102, "123 456", "en", "src0", 0),
        (103, clean[4][1] + "\n" + " ".join(bench[1][1].split()[3:20]), "en", "src1", 0),
        (104, prose(80) + "\n" + bench[2][1], "en", "src1", 0),
    ]
    folder = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in clean + planted]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = [set(r[0] for r in docs.select("doc_id").collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = materialize(out, name)
        seen.append({r[0] for r in docs.select("doc_id").collect()})
    gone = [a - b for a, b in zip(seen, seen[1:], strict=False)]
    assert gone[0] == {101, 102} and gone[1] == {100} and gone[2] == set() and gone[3] == {103, 104}
    assert seen[-1] == set(range(40))
    assert docs.where("n_chars <> length(text)").count() == 0


def test_run(spark, corpus):
    pieces = corpus_pipeline.run(spark, corpus).collect()
    assert {r["doc_id"] for r in pieces} == set(range(40))


def test_near_duplicates_alone(spark, corpus):
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(200)]
    other = [*base[:100], "changed", *base[101:]]
    rows = [(7, " ".join(base), "en", "s", 1), (3, " ".join(other), "en", "s", 1), (9, "quite another text of its own", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, corpus).collect()} == {3, 9}


def test_repeated_rows(spark, corpus):
    """Of rows with the same id and text one stays; another text under the id stays, too."""
    rows = [(1, "a text that is here twice", "en", "s", 1), (1, "a text that is here twice", "en", "t", 1), (1, "quite another one of words", "en", "s", 1), (2, "x y z", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, corpus).collect())
    assert got == sorted({(r[0], r[1]) for r in rows})


def test_clashing_columns(spark, corpus):
    """Extra columns with names that operators use inside or return."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = ["n", "token", "uid", "set", "spans", "items", "score", "held_out", "n_kept", "component_id", "__text", "label"]
    wide = docs.withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, corpus)
        assert out.columns == wide.columns, name
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {tuple(names)}, name


def test_empty(spark, corpus, tmp_path):
    empty = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, corpus).count() == 0, name
