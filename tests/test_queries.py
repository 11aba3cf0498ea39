"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tallyrack.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def rows(values, columns, order):
    at = [columns.index(c) for c in order]

    def plain(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_tuple"):
            return str(v)
        return f"{float(v):.9g}"

    return sorted(tuple(plain(r[i]) for i in at) for r in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns, order) == rows(want.fetchall(), want.columns, order)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    top = registry.flagship(spark, sf).collect()
    assert 0 < len(top) <= 20 and [r.value for r in top] == sorted((r.value for r in top), reverse=True)


def test_interval_join_stays_a_hash_join(spark, sf):
    from tallyrack.operators.joins import join_job_samples
    from tallyrack.plans import fixtures as X

    plan = join_job_samples(X.jobs(spark, sf), X.samples(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
