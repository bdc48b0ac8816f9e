"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

from corpuslens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"g2_pagerank", "g2_pagerank_rounds", "g3_has_cycles", "g4_cycle_count", "d6_g4_metrics_with_cycles", "j5_ivf_recall", "j5_ivf_search"}  # test_graph and test_text hold their operators on small input


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - SLOW))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = registry.queries()[name](spark, sf_dir)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - SLOW))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
