"""Samples, jobs and grids made of the driver's tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "f_sample": """SELECT ts AS time, 'h'||CAST(user_id%25 AS STRING) AS host, CAST(user_id AS STRING) AS jid, event_type AS type, CAST(event_id%4 AS STRING) AS dev,
  'k'||CAST(CAST(json_extract_string(props,'$.k') AS INT)%3 AS STRING) AS event, '#' AS unit, value FROM events""",
    "f_job": """SELECT CAST(o_orderkey AS STRING) AS jid, 'u'||CAST(o_custkey%50 AS STRING) AS username, c_mktsegment AS account, o_orderpriority AS queue,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'TIMEOUT' ELSE 'FAILED' END AS state,
  TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey%696 AS INT)) AS start_time, TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey%696+1+o_orderkey%24 AS INT)) AS end_time,
  TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey%696 AS INT)) - to_minutes(CAST((o_custkey%13-1)*20 AS INT)) AS submit_time,
  CAST((1+o_orderkey%24)*3600.0 AS DOUBLE) AS runtime, CAST(1+o_custkey%8 AS INT)*16 AS ncores,
  list_distinct(['h'||CAST(o_orderkey%25 AS STRING), 'h'||CAST(o_custkey%25 AS STRING)]) AS host_list,
  CASE WHEN o_orderkey%25 = o_custkey%25 THEN 1 ELSE 2 END AS nhosts, CASE WHEN o_orderkey%25 = o_custkey%25 THEN 1 ELSE 2 END * (1+o_orderkey%24)*1.0::DOUBLE AS node_hrs
  FROM orders JOIN customer ON c_custkey = o_custkey""",
    "f_jh": "SELECT *, unnest(host_list) AS h FROM f_job",
    "f_js": "SELECT j.jid, j.start_time, j.end_time, j.nhosts, j.ncores, s.host, s.time, s.type, s.dev, s.event, s.value FROM f_jh j JOIN f_sample s ON s.host = j.h AND s.time >= j.start_time AND s.time <= j.end_time",
    "f_delta": """SELECT *, CASE WHEN v - p < 0 THEN (v - p + 65536.0::DOUBLE) ELSE v - p END * 512 AS delta FROM
  (SELECT f_sample.*, value AS v, lag(value) OVER (PARTITION BY host, type, dev, event ORDER BY time) AS p FROM f_sample)""",
    "f_wide": "SELECT l_shipdate AS time, 's'||CAST(l_suppkey%20 AS STRING) AS host, CAST(l_linenumber AS STRING) AS dev, l_returnflag AS type, l_linestatus AS event, l_quantity AS value, l_quantity - 20 AS arc FROM lineitem",
    # cumulative-looking counters of four hosts on a common daily axis, a job a year
    "f_grid": """SELECT jid, host, time, event, q + epoch(time)/864 AS value, q AS arc FROM (SELECT 'j'||CAST(year(l_shipdate) AS STRING) AS jid, 'g'||CAST(l_suppkey%4 AS STRING) AS host,
  l_shipdate AS time, 'e'||CAST(l_linenumber%3 AS STRING) AS event, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3, 4)""",
    "f_metric": """SELECT jid, type, 'avg_'||event AS metric, '#' AS units, CASE WHEN count(*) > 1 THEN avg(value) END AS value, CASE WHEN count(*) > 1 THEN NULL ELSE 'insufficient' END AS no_data_reason FROM f_js GROUP BY jid, type, event""",
}
NEEDS = {"f_jh": ["f_job"], "f_js": ["f_sample", "f_job", "f_jh"], "f_delta": ["f_sample"], "f_metric": ["f_sample", "f_job", "f_jh", "f_js"]}


def with_views(*names: str) -> str:
    """A WITH clause that defines the named views and what they need."""
    wanted = [n for n in SQL if n in names or any(n in NEEDS.get(m, ()) for m in names)]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted) + "\n" if wanted else ""


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.select(
        F.col("ts").cast("timestamp").alias("time"), F.concat(F.lit("h"), F.col("user_id") % 25).alias("host"), F.col("user_id").cast("string").alias("jid"), F.col("event_type").alias("type"),
        (F.col("event_id") % 4).cast("string").alias("dev"), F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 3).alias("event"), F.lit("#").alias("unit"), "value",
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    j = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    at = 1704067200 + (F.col("o_orderkey") % 696) * 3600
    hours = 1 + F.col("o_orderkey") % 24
    j = j.select(
        F.col("o_orderkey").cast("string").alias("jid"), F.concat(F.lit("u"), F.col("o_custkey") % 50).alias("username"), F.col("c_mktsegment").alias("account"), F.col("o_orderpriority").alias("queue"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "TIMEOUT").otherwise("FAILED").alias("state"),
        F.timestamp_seconds(at).alias("start_time"), F.timestamp_seconds(at + hours * 3600).alias("end_time"), F.timestamp_seconds(at - (F.col("o_custkey") % 13 - 1) * 1200).alias("submit_time"),
        (hours * 3600).cast("double").alias("runtime"), ((1 + F.col("o_custkey") % 8).cast("int") * 16).alias("ncores"),
        F.array_distinct(F.array(F.concat(F.lit("h"), F.col("o_orderkey") % 25), F.concat(F.lit("h"), F.col("o_custkey") % 25))).alias("host_list"),
    )
    return j.withColumn("nhosts", F.size("host_list")).withColumn("node_hrs", F.col("nhosts") * F.col("runtime") / 3600)


def wide(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "lineitem")
    return r.select(F.col("l_shipdate").cast("timestamp").alias("time"), F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("host"), F.col("l_linenumber").cast("string").alias("dev"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("event"), F.col("l_quantity").alias("value"), (F.col("l_quantity") - 20).alias("arc"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "lineitem").select(F.col("l_shipdate").cast("timestamp").alias("time"), "l_suppkey", "l_linenumber", "l_quantity")
    r = r.groupBy(F.concat(F.lit("j"), F.year("time")).alias("jid"), F.concat(F.lit("g"), F.col("l_suppkey") % 4).alias("host"), "time", F.concat(F.lit("e"), F.col("l_linenumber") % 3).alias("event")).agg(F.sum("l_quantity").alias("arc"))
    return r.withColumn("value", F.col("arc") + F.unix_seconds("time") / 864)
