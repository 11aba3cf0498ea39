"""Which jobs are complete, stale or need work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import INSUFFICIENT


def performance_rank(job: DataFrame, metric: DataFrame, plotted: DataFrame) -> DataFrame:
    """0 metrics and plots, 1 metrics, 2 to 4 rows without values by samples (5 and more, fewer, none), 5 no rows and short, 6 else."""
    m = metric.groupBy("jid").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("vals"))
    d = job.join(m, "jid", "left").join(plotted.select("jid").distinct().withColumn("plot", F.lit(True)), "jid", "left")
    n = F.coalesce("samples", F.lit(0))
    r = (
        F.when((F.col("vals") > 0) & F.coalesce("plot", F.lit(False)), 0).when(F.col("vals") > 0, 1).when((F.col("rows") > 0) & (n >= 5), 2)
        .when((F.col("rows") > 0) & (n >= 1), 3).when(F.col("rows") > 0, 4).when(F.col("runtime") < 600, 5).otherwise(6)
    )
    return d.withColumn("rank", r).withColumn("bucket", F.when(F.col("rank").between(2, 4), 2).otherwise(F.col("rank"))).select("jid", "rank", "bucket")


def coverage_ready(job: DataFrame, bounds: DataFrame, margin: int = 600) -> DataFrame:
    """Whether samples reach from the start to the end within ``margin`` seconds, and by how much they miss."""
    return coverage_of(job.join(bounds, "jid", "left"), margin)


def coverage_of(d: DataFrame, margin: int = 600) -> DataFrame:
    """The same of jobs with their ``first`` and ``last`` sample."""
    lead, lag = F.unix_seconds("first") - F.unix_seconds("start_time"), F.unix_seconds("end_time") - F.unix_seconds("last")
    return d.select("jid", lead.alias("lead"), lag.alias("lag"), F.coalesce((lead <= margin) & (lag <= margin), F.lit(False)).alias("ready"))


def post_end_ready(job: DataFrame, latest: DataFrame) -> DataFrame:
    """Whether each of a job's hosts has a sample after its end; ``latest`` has one row a host."""
    h = job.select("jid", "end_time", F.explode("host_list").alias("host")).join(latest, "host", "left")
    return h.groupBy("jid").agg(F.every(F.coalesce(F.col("last_time") > F.col("end_time"), F.lit(False))).alias("ready"))


def listing_gates(job: DataFrame, metric: DataFrame, expected: int, times: str | None = None) -> DataFrame:
    """Jobs to compute: with too few metric rows or none, with NULLs that lack a reason, or that once failed the gate and are to be looked at again.

    ``times`` names the column that has how many rows of ``metric`` a row stands for.
    """
    n = F.lit(1).cast("long") if times is None else F.col(times)
    stale = F.sum(F.when(F.col("value").isNull() & (F.coalesce("no_data_reason", F.lit("")) == ""), n).otherwise(0))
    m = metric.groupBy("jid").agg(F.sum(n).alias("rows"), stale.alias("stale"), F.bool_or(F.coalesce(F.col("no_data_reason") == INSUFFICIENT, F.lit(False))).alias("gate"))
    d = job.join(m, "jid", "left").fillna({"rows": 0, "stale": 0, "gate": False}, ["rows", "stale", "gate"])
    return d.where((F.col("rows") < expected) | (F.col("stale") > 0) | F.col("gate")).select("jid", "rows", "stale", "gate")


def needs_refresh(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Jobs whose samples have grown since their metrics were stored."""
    return live.join(stored.withColumnRenamed("n", "had"), "jid", "left").where(F.col("n") > F.coalesce("had", F.lit(0))).select("jid", "n", F.coalesce("had", F.lit(0)).alias("had"))


def period_keys(job: DataFrame) -> DataFrame:
    """Every month and year from the first to the last eligible end, empty ones too."""
    j = job.where("start_time >= submit_time and runtime > 0 and ncores > 0").agg(F.min("end_time").alias("a"), F.max("end_time").alias("b")).where("a is not null")
    months = j.select(F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("m"))
    years = j.select(F.explode(F.sequence(F.year("a"), F.year("b"))).alias("y")).select(F.col("y").cast("string").alias("period"))
    return months.select(F.lit("month").alias("kind"), F.date_format("m", "yyyy-MM").alias("period")).union(years.select(F.lit("year"), "period"))


def refresh_stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(period, action): rebuild what is new, changed or flagged; drop what is gone."""
    d = current.join(stored.withColumnRenamed("print", "had"), "period", "full")
    action = F.when(F.col("print").isNull(), "drop").when(F.col("had").isNull() | (F.col("had") != F.col("print")) | F.coalesce("flagged", F.lit(False)), "rebuild")
    return d.select("period", action.alias("action")).where("action is not null")


def order_jobs(job: DataFrame, key: str = "-end_time", allowed=("end_time", "start_time", "runtime", "nhosts", "node_hrs", "samples")) -> DataFrame:
    """An allowed key, ``-`` for descending; NULLs last both ways, jid breaks ties."""
    name = key.lstrip("-")
    if name not in allowed:
        key, name = "-end_time", "end_time"
    c = F.col(name)
    return job.orderBy(c.desc_nulls_last() if key[0] == "-" else c.asc_nulls_last(), "jid")


def page(job: DataFrame, number: object, size: int = 100) -> DataFrame:
    """A page; a bad number is the first, one past the end the last."""
    try:
        n = max(1, int(number))
    except (TypeError, ValueError):
        n = 1
    last = max(1, -(-job.count() // size))
    return order_jobs(job).offset((min(n, last) - 1) * size).limit(size)


def after_key(job: DataFrame, end_us: int | None, jid: str | None, size: int = 100) -> DataFrame:
    """The next jobs, newest first, behind (end_time, jid)."""
    e = F.unix_micros("end_time")
    j = job if end_us is None else job.where((e < end_us) | ((e == end_us) & (F.col("jid") < jid)))
    return j.orderBy(F.desc("end_time"), F.desc("jid")).limit(size)
