"""Filters of the job list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FAILED, as_fqdn, clamp, null_sentinels

RANGES = ("runtime", "nhosts", "node_hrs", "start_time", "end_time", "ncores")


def values(text: str) -> list[str]:
    """Comma-separated values, trimmed, each once."""
    return list(dict.fromkeys(v.strip() for v in text.split(",") if v.strip()))


def exact_multi(job: DataFrame, **wanted: str) -> DataFrame:
    """OR within a dimension, AND across; an empty dimension does not filter."""
    tests = [F.col(c).isin(values(v)) for c, v in wanted.items() if values(v)]
    return job.where(reduce(lambda a, b: a & b, tests)) if tests else job


def in_range(job: DataFrame, bounds: dict[str, object], account_has: str | None = None) -> DataFrame:
    """``runtime__gte`` and the like; keys that are not allowed are ignored."""
    for k, v in bounds.items():
        c, _, op = k.partition("__")
        if c in RANGES and op in ("gte", "lte"):
            job = job.where(F.col(c) >= F.lit(v) if op == "gte" else F.col(c) <= F.lit(v))
    return job.where(F.lower("account").contains(account_has.lower())) if account_has else job


def period_bounds(period: str) -> tuple[str, str]:
    """The first and last date of ``YYYY``, ``YYYY-MM`` or ``YYYY-M-D``."""
    import calendar

    p = [int(x) for x in period.split("-")]
    if len(p) == 1:
        return f"{p[0]:04d}-01-01", f"{p[0]:04d}-12-31"
    last = calendar.monthrange(p[0], p[1])[1]
    return f"{p[0]:04d}-{p[1]:02d}-{p[2] if len(p) > 2 else 1:02d}", f"{p[0]:04d}-{p[1]:02d}-{p[2] if len(p) > 2 else last:02d}"


def in_period(job: DataFrame, period: str, zone: str = "UTC", column: str = "end_time") -> DataFrame:
    """Jobs within the calendar period of the site's zone; a half-open range, so it can be pushed down."""
    lo, hi = period_bounds(period)
    at = lambda d, more: F.to_utc_timestamp(F.date_add(F.lit(d).cast("date"), more).cast("timestamp"), zone)
    return job.where((F.col(column) >= at(lo, 0)) & (F.col(column) < at(hi, 1)))


def on_host(job: DataFrame, host: str) -> DataFrame:
    return job.where(F.array_contains("host_list", host))


def by_metric(job: DataFrame, metric: DataFrame, tests: list[tuple[str, str, float]]) -> DataFrame:
    """Jobs that pass every (metric, >= or <=, value); a semi join each, so no job is repeated."""
    for name, op, v in tests:
        own = metric.where((F.col("metric") == name) & (F.col("value") >= v if op == ">=" else F.col("value") <= v))
        job = job.join(own.select("jid"), "jid", "left_semi")
    return job


def visible(job: DataFrame, user: str | None, staff: bool = False) -> DataFrame:
    """Staff see all; others their own jobs and those of accounts that they have used."""
    if staff:
        return job
    if user is None:
        return job.where(F.lit(False))
    mine = job.where(F.col("username") == user).select("account").distinct()
    used = job.join(mine.withColumn("used", F.lit(True)), "account", "left")
    return used.where((F.col("username") == user) | F.col("used")).select(*job.columns)


def major_state(group: str, c: str = "state") -> Column:
    """Whether a raw state is of the group, by name, suffix and prefix."""
    s = F.upper(c)
    named = lambda names: reduce(lambda a, b: a | b, [(s == n) | s.startswith(f"{n}+") for n in names])
    return {"completed": named(["COMPLETED"]), "failed": named(FAILED), "canceled": s.startswith("CANCEL"), "preempted": s.startswith("PREEMPT"), "timeout": named(["TIMEOUT"])}.get(group, F.lit(False))


def in_states(job: DataFrame, groups: list[str]) -> DataFrame:
    return job.where(reduce(lambda a, b: a | b, [major_state(g) for g in groups])) if groups else job


def eligible_wait(job: DataFrame, for_expansion: bool = False) -> DataFrame:
    j = job.where("start_time >= submit_time")
    return j.where("runtime > 0 and ncores > 0") if for_expansion else j


def drop_restricted(job: DataFrame, words: list[str]) -> DataFrame:
    """Jobs whose queue holds none of the words, as they are written but for case; a missing queue stays."""
    holds = [F.contains(F.lower("queue"), F.lit(w.lower())) for w in words]
    return job.where(F.coalesce(~reduce(lambda a, b: a | b, holds), F.lit(True))) if words else job


#: A table of names that is at most so long goes to every task, a longer one is joined.
SHORT_TABLE = 100_000


def short(names: DataFrame) -> DataFrame:
    """``names`` to be broadcast if it is short."""
    return F.broadcast(names) if names.limit(SHORT_TABLE + 1).count() <= SHORT_TABLE else names


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A rename table (kind, scope, old, new) of a CSV file with a header; ``kind`` is type or event, an empty scope holds for all types.

    Blank and repeated rows go; of two new names for one old one the last by name counts.
    """
    raw = spark.read.csv(path, header=True, schema="kind string, scope string, old string, new string", comment="#")
    d = raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in raw.columns]).where("kind in ('type', 'event') and old is not null and new is not null")
    return d.groupBy("kind", "scope", "old").agg(F.max("new").alias("new"))


def read_eventmap(spark: SparkSession, path: str) -> DataFrame:
    """A map (type, code, name) of control codes, hexadecimal with or without 0x, of a CSV file with a header."""
    raw = spark.read.csv(path, header=True, schema="type string, code string, name string", comment="#")
    code = F.regexp_replace(F.lower(F.trim("code")), "^0x0*|^0+(?=.)", "")
    return raw.select(F.trim("type").alias("type"), code.alias("code"), F.trim("name").alias("name")).where("type <> '' and code <> '' and name <> ''").groupBy("type", "code").agg(F.max("name").alias("name"))


def canonicalise(sample: DataFrame, names: DataFrame) -> DataFrame:
    """Canonical type and event names: (kind, scope, old, new) rows, the type's own scope before the global.

    The rename table (see ``read_names``) is broadcast if it is short.
    """
    types = names.where("kind = 'type'").select(F.col("old").alias("type"), F.col("new").alias("new_type"))
    scoped = names.where("kind = 'event' and scope is not null").select(F.col("scope").alias("type"), F.col("old").alias("event"), F.col("new").alias("own"))
    common = names.where("kind = 'event' and scope is null").select(F.col("old").alias("event"), F.col("new").alias("any"))
    s = sample.withColumnsRenamed({"type": "raw_type", "event": "raw_event"}).withColumn("type", F.col("raw_type")).withColumn("event", F.col("raw_event"))
    s = s.join(short(types), "type", "left").withColumn("type", F.coalesce("new_type", "type")).drop("new_type")
    s = s.join(short(scoped), ["type", "event"], "left").join(short(common), "event", "left")
    return s.withColumn("event", F.coalesce("own", "any", "event")).drop("own", "any")


def cleaned(sample: DataFrame, most: float | None = None) -> DataFrame:
    v = null_sentinels(F.col("value"))
    return sample.withColumn("value", v if most is None else clamp(v, most))


def fqdn_hosts(hosts: DataFrame, suffix: str) -> DataFrame:
    return hosts.withColumn("host", as_fqdn(F.col("host"), suffix)).where("host is not null")


def has_events(schema: Column, type_: str, events: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(schema[type_], F.array(*map(F.lit, events))), F.lit(False))


def own_runs(run: DataFrame) -> DataFrame:
    return run.where(~F.array_contains(F.split("exec_path", "/"), "usr")).withColumn("cwd", F.substring("cwd", 1, 128))
