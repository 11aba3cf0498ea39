"""Queries of the library and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, joins, windows
from . import fixtures

MODULES = ("listing", "aggregation", "analysis", "telemetry", "ingest", "streams")
BOOKS = [import_module(f"{__package__}.{m}").book for m in MODULES]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Counter deltas, collapsed over devices, as rates; matched to jobs; the twenty busiest jobs."""
    s = windows.counter_delta(fixtures.samples(spark, sf), 16)
    s = windows.rate_arc(aggregates.collapse_devices(s))
    rates = aggregates.job_rate(joins.join_job_samples(fixtures.jobs(spark, sf), s), "view", ["k0", "k1", "k2"], 1.0, seconds=86400)
    return rates.where("value is not null").orderBy(F.desc("value"), "jid").limit(20)


def queries() -> dict:
    return {k: f for b in BOOKS for k, f in b.queries.items()}


def oracle_sql() -> dict:
    return {k: s for b in BOOKS for k, s in b.oracles.items()}
