"""Every query of the catalogue against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from tessella.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = duck.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted(repr(tuple(plain(r[k]) for k in at)) for r in rel.fetchall())
    assert sorted(rel.columns) == cols
    assert got == want


def test_the_scan_gets_the_section(spark, sf):
    plan = QUERIES["sec_box"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,10)" in plan and "LessThanOrEqual(vec_id,19)" in plan


def test_tag_resolve_has_more_tasks_for_more_rows(spark, sf, duck, monkeypatch):
    from tessella.plans import algebra

    monkeypatch.setattr(algebra, "TASK_ROWS", 100)
    df = QUERIES["tag_resolve"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    assert "collect_list" not in plan and "BroadcastHashJoin" not in plan
    assert all(any(f"hashpartitioning({key}" in x and f", {n})" in x for x in plan.splitlines()) for key in ("vgroup", "p_partkey"))
    assert sorted(map(tuple, df.select("vgroup", "tags", "kinds").collect())) == sorted(duck.sql(f"select vgroup, tags, kinds from ({ORACLE_SQL['tag_resolve']})").fetchall())
