"""Queries on reading and writing: text and tables are made of the given tables by Spark first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..schema import PROC_LAST, PROC_PEAKS
from ..sources import linestream, monitor, rollup, sinks
from ..sources.store import scratch
from ..streaming import streams
from . import fixtures as X
from .common import Book, micros
from .listing import LATEST

book = Book()


def monitor_lines(spark, sf):
    """(file, block, pos, line): the events of each host and day as monitor text of its own, in time order and in blocks."""
    e = X.read(spark, sf, "events").withColumn("host", F.concat(F.lit("h"), F.col("user_id") % 25)).withColumn("file", F.concat_ws("/", "host", F.to_date("ts")))
    head = F.concat_ws(" ", F.format_string("%.6f", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), F.when(F.col("user_id") % 7 == 0, "-").otherwise(F.col("user_id").cast("string")), "host")
    bad = F.when(F.col("event_id") % 50 == 0, " 9 9").otherwise("")
    gpu = F.when(F.col("event_id") % 2 == 0, F.concat_ws(" ", F.lit("gpu"), F.lit("0"), F.lit("@fast"), F.col("value"))).otherwise(F.concat_ws(" ", F.lit("gpu 0 @full"), F.col("value"), F.lit("42")))
    body = F.array(head, F.concat(F.concat_ws(" ", F.lit("blk"), F.col("event_type"), F.col("event_id"), F.col("value")), bad), gpu, F.concat_ws(" ", F.lit("proc"), F.concat("event_type", F.lit("/1/2")), F.col("event_id"), F.col("user_id")), F.lit("ps x 1"))
    rows = e.select("file", "event_id", F.posexplode(body).alias("k", "line")).select("file", (F.col("event_id") * 8 + F.col("k") + 10).alias("pos"), "line")
    start = F.array(F.lit("$version 1"), F.concat(F.lit("$hostname "), F.col("host"), F.lit(".example.org")), F.lit("!blk rd,E,U=512B wr,E,W=48"), F.lit("!gpu util slow_temp,R=S"), F.lit("!proc vm_peak uid"), F.lit("!ps n"))
    top = e.select("host", "file").distinct().select("file", F.posexplode(start).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    return top.unionByName(rows).withColumn("block", F.expr("pos div 4096"))


LONG = """t AS (SELECT 'h' || CAST(user_id % 25 AS STRING) AS host, epoch_us(ts) AS time_us, CASE WHEN user_id % 7 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS jid, * FROM events),
s AS (SELECT host, time_us, jid, 'blk' AS type, event_type AS dev, 'rd' AS event, CAST(event_id AS DOUBLE) AS value FROM t WHERE event_id % 50 <> 0 UNION ALL SELECT host, time_us, jid, 'blk', event_type, 'wr', value FROM t WHERE event_id % 50 <> 0
  UNION ALL SELECT host, time_us, jid, 'gpu', '0', 'util', value FROM t UNION ALL SELECT host, time_us, jid, 'gpu', '0', 'slow_temp', 42 FROM t WHERE event_id % 2 = 1
  UNION ALL SELECT host, time_us, jid, 'proc', event_type || '/1/2', 'vm_peak', event_id FROM t UNION ALL SELECT host, time_us, jid, 'proc', event_type || '/1/2', 'uid', user_id FROM t)"""
OUT = ("host", "jid", "type", "dev", "event", "value")


def text_files(spark, sf):
    """The lines as text in a folder for each host that the cluster shares; files hold whole days, each behind its schema, and grow in number."""
    path = scratch(spark, "monitor")
    part = lambda i: F.split_part("file", F.lit("/"), F.lit(i))
    days = monitor_lines(spark, sf).select(part(1).alias("file"), part(2).alias("day"), "pos", F.col("line").alias("value"))
    days.repartition("file", "day").sortWithinPartitions("file", "day", "pos").select("file", "value").write.partitionBy("file").text(path)
    return path


@book("read_monitor_text", "", f"WITH {LONG} SELECT * FROM s")
def read_monitor_text(spark, sf):
    return monitor.read_monitor_text(spark, text_files(spark, sf) + "/*").select(*OUT, micros("time"))


@book("read_tiered_rows", "", f"WITH {LONG} SELECT host, time_us, event, value FROM s WHERE type = 'gpu'")
def read_tiered_rows(spark, sf):
    return monitor.parse_lines(monitor_lines(spark, sf)).where("type = 'gpu'").select("host", micros("time"), "event", "value")


@book("decode_hw_counters", "", "SELECT CAST(o_orderkey AS STRING) AS dev, CASE o_orderkey % 3 WHEN 0 THEN 'cycles' WHEN 1 THEN 'instr' ELSE 'OTHER' END AS event, o_totalprice AS value FROM orders")
def decode_hw_counters(spark, sf):
    o = X.read(spark, sf, "orders").select(F.lit("h").alias("host"), F.col("o_orderdate").alias("time"), F.lit("1").alias("jid"), F.lit("pmc").alias("type"), F.col("o_orderkey").cast("string").alias("dev"), (F.col("o_orderkey") % 3).alias("k"), "o_totalprice")
    s = o.withColumn("event", F.lit("CTL0")).withColumn("value", (F.col("k") + 0x3B).cast("double")).unionByName(o.withColumn("event", F.lit("CTR0")).withColumn("value", F.col("o_totalprice")))
    names = spark.createDataFrame([("pmc", "3b", "cycles"), ("pmc", "3c", "instr")], "type string, code string, name string")
    return monitor.decode_hw_counters(s, names).select("dev", "event", "value")


@book("read_proc_rows", "", f"WITH {LONG} SELECT jid, host, time_us, split_part(dev, '/', 1) AS proc, CAST(max(value) FILTER (event = 'vm_peak') AS BIGINT) AS vm_peak, CAST(max(value) FILTER (event = 'uid') AS BIGINT) AS uid FROM s WHERE type = 'proc' GROUP BY 1, 2, 3, 4")
def read_proc_rows(spark, sf):
    return monitor.read_proc_rows(monitor_lines(spark, sf)).select("jid", "host", micros("time"), "proc", "vm_peak", "uid")


@book("read_node_identity", "", "SELECT DISTINCT 'h' || CAST(user_id % 25 AS STRING) || '.example.org' AS host, '1' AS version, 'blk,gpu,proc,ps' AS types FROM events")
def read_node_identity(spark, sf):
    return monitor.read_node_identity(monitor_lines(spark, sf)).select("host", "version", F.array_join("types", ",").alias("types")).distinct()


@book("discover_files", "", "SELECT DISTINCT 'file=h' || CAST(user_id % 25 AS STRING) AS host, true AS found FROM events")
def discover_files(spark, sf):
    return monitor.discover_files(spark, text_files(spark, sf), 0, 1 << 60).select("host", (F.col("length") > 0).alias("found")).distinct()


@book("reingest_job", "", f"WITH {LONG} SELECT host, time_us, jid, type, dev, event, value FROM s WHERE host IN ('h' || CAST((SELECT min(o_orderkey) FROM orders WHERE o_orderkey > 100) % 25 AS STRING), 'h' || CAST((SELECT o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 1) % 25 AS STRING)) AND time_us >= epoch_us(TIMESTAMP '2024-01-01' + to_hours(CAST((SELECT min(o_orderkey) FROM orders WHERE o_orderkey > 100) % 696 - 1 AS INT))) AND floor(time_us / 1e6) <= epoch(TIMESTAMP '2024-01-01' + to_hours(CAST((SELECT min(o_orderkey % 696 + 1 + o_orderkey % 24) FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderkey > 100)) + 1 AS INT)))")
def reingest_job(spark, sf):
    job = X.jobs(spark, sf)
    jid = job.where("cast(jid as long) > 100").orderBy(F.col("jid").cast("long")).first().jid
    own = job.withColumn("host_list", F.transform("host_list", lambda h: F.concat(F.lit("file="), h)))
    return monitor.reingest_job(spark, own, text_files(spark, sf), jid).select(*OUT, micros("time"))


@book("read_accounting", "f_job", "SELECT jid, username, queue, runtime, CAST(3600 AS DOUBLE) AS timelimit, nhosts, node_hrs, 3 AS hosts FROM f_job WHERE CAST(jid AS BIGINT) % 10 <> 3")
def read_accounting(spark, sf):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    j = X.jobs(spark, sf).withColumn("bad", F.col("jid").cast("long") % 10 == 3)
    line = F.concat_ws("|", "jid", "username", "account", at("start_time"), at("end_time"), at("submit_time"), "queue", F.lit("01:00:00"), F.lit("x"), "state", F.when(F.col("bad"), "many").otherwise(F.col("nhosts").cast("string")), "ncores", F.lit("c[001-002],d9"))
    path = scratch(spark, "accounting")
    j.select(line.alias("JobID|User|Account|Start|End|Submit|Partition|Timelimit|JobName|State|NNodes|ReqCPUS|NodeList")).write.option("header", "true").option("quote", "").option("sep", "\t").csv(path)
    return monitor.read_accounting(spark, path).select("jid", "username", "queue", "runtime", "timelimit", "nhosts", "node_hrs", F.size("host_list").alias("hosts"))


@book("export_daily_accounting", "f_job", "SELECT strftime(end_time, '%Y-%m-%d') AS day, count(*) FILTER (nhosts = 2 OR end_time >= TIMESTAMP '2024-01-15') AS rows, count(*) FILTER (nhosts = 2 OR end_time >= TIMESTAMP '2024-01-15') >= count(*) FILTER (end_time < TIMESTAMP '2024-01-10') AS written FROM f_job GROUP BY 1")
def export_daily_accounting(spark, sf):
    j = X.jobs(spark, sf).select("jid", "username", "nhosts", "end_time", F.date_format("end_time", "yyyy-MM-dd").alias("day"))
    path = scratch(spark, "daily")
    sinks.write_daily(j.where("end_time < timestamp '2024-01-10'").drop("end_time"), path)
    return sinks.write_daily(j.where("nhosts = 2 or end_time >= timestamp '2024-01-15'").drop("end_time"), path)


@book("sink_samples", "f_sample", "SELECT host, epoch_us(time) AS time_us, type, dev, event, value FROM f_sample")
def sink_samples(spark, sf):
    s, path = X.samples(spark, sf), scratch(spark, "samples")
    sinks.write_samples(s.where("type <> 'view'"), path)
    sinks.write_samples(s.unionByName(s.where("type = 'error'")), path)
    return spark.read.parquet(path).select("host", micros("time"), "type", "dev", "event", "value")


@book("sink_metrics_upsert", "f_job", "SELECT jid, 'x' AS type, 'wait' AS metric, CASE WHEN queue = '5-LOW' THEN runtime + 2 ELSE runtime END AS value FROM f_job")
def sink_metrics_upsert(spark, sf):
    base = X.jobs(spark, sf).select("jid", F.lit("x").alias("type"), F.lit("wait").alias("metric"), F.col("runtime").alias("value"), "queue")
    low = base.where("queue = '5-LOW'").drop("queue")
    new = low.withColumns({"value": F.col("value") + 1, "seq": F.lit(1)}).unionByName(low.withColumns({"value": F.col("value") + 2, "seq": F.lit(2)}))
    return sinks.upsert_metrics(new, base.drop("queue"))


@book("sink_proc_peak_upsert", "", "SELECT CAST(l_orderkey AS STRING) AS jid, 's' || CAST(l_suppkey % 5 AS STRING) AS host, l_returnflag AS proc, arg_max(CAST(l_quantity AS BIGINT), {'d': l_shipdate, 'l': l_linenumber, 'p': l_partkey}) AS vm_rss, max(CAST(l_quantity AS BIGINT)) AS vm_peak FROM lineitem GROUP BY 1, 2, 3")
def sink_proc_peak_upsert(spark, sf):
    q = F.col("l_quantity").cast("long")
    r = X.read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("jid"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("host"), F.col("l_returnflag").alias("proc"), F.lit("d").alias("device"), F.struct("l_shipdate", "l_linenumber", "l_partkey").alias("seq"), *[q.alias(c) for c in (*PROC_PEAKS, *PROC_LAST)])
    return sinks.upsert_proc(r).select("jid", "host", "proc", "vm_rss", "vm_peak")


@book("compact_daily", "", "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS STRING) AS name, max(event_id % 13) AS size, arg_max(event_id, {'s': event_id % 13, 'i': event_id}) AS idx FROM events GROUP BY 1, 2")
def compact_daily(spark, sf):
    f = X.read(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").cast("string").alias("name"), (F.col("event_id") % 13).alias("size"), F.col("event_id").alias("idx"))
    return sinks.compact_daily(f)


@book("export_device_power", "f_jh f_sample", f"SELECT time_us, l.host, l.dev, coalesce(job, '') AS jid, s.value AS watts FROM ({LATEST}) l JOIN f_sample s ON epoch_us(s.time) = time_us AND s.host = l.host AND s.dev = l.dev AND s.type = 'error' WHERE s.event = 'k1'")
def export_device_power(spark, sf):
    path = scratch(spark, "power")
    sinks.device_power(X.samples(spark, sf), X.jobs(spark, sf), "error", ["k1"]).select(micros("time"), "host", "dev", "jid", "watts").write.option("header", "true").csv(path)
    return spark.read.csv(path, header=True, schema="time_us long, host string, dev string, jid string, watts double").fillna("", ["jid"])


@book("job_full_frame", "f_js", "SELECT jid, host, epoch_us(time) AS time_us, type, CAST(floor(epoch(time)) - min(floor(epoch(time))) OVER (PARTITION BY jid) AS BIGINT) AS elapsed, username, round(k0, 6) AS k0, round(k1, 6) AS k1 FROM (SELECT jid, host, time, type, sum(value) FILTER (event = 'k0') AS k0, sum(value) FILTER (event = 'k1') AS k1 FROM f_js WHERE type IN ('view', 'error') GROUP BY 1, 2, 3, 4) JOIN (SELECT jid, username FROM f_job) USING (jid)")
def job_full_frame(spark, sf):
    rounded = lambda d: d.withColumns({c: F.round(c, 6) for c in ("k0", "k1")})  # noqa: E731  once a sample, not for every job
    return sinks.job_full_frame(X.samples(spark, sf), X.jobs(spark, sf), ["view", "error"], rounded).select("jid", "host", micros("time"), "type", "elapsed", "username", "k0", "k1")


@book("read_runs_jdbc", "", "SELECT o_orderkey AS run_id, CAST(o_custkey AS STRING) AS job_id FROM orders")
def read_runs_jdbc(spark, sf):
    path = scratch(spark, "runs")
    X.read(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("string").alias("job_id")).write.parquet(f"{path}/run")
    return monitor.read_runs(spark, path=path)


@book("rollup_by_day", "f_sample", "SELECT strftime(time, '%Y-%m-%d') AS day, type, round(sum(value), 4) AS total, max(value) AS vmax, count(value) AS cnt FROM f_sample GROUP BY 1, 2")
def rollup_by_day(spark, sf):
    """Three batches of samples, the last of them told twice; each holds rows of days that others hold too."""
    path = scratch(spark, "by-day")
    s = X.samples(spark, sf).withColumns({"day": F.date_format("time", "yyyy-MM-dd"), "k": F.pmod(F.unix_seconds("time"), F.lit(3))})
    for batch in (0, 1, 2, 2):
        rollup.fold_days(s.where(F.col("k") == batch), path, ["type"], batch)
    return rollup.read_days(spark, path, ["day", "type"]).select(F.col("day").cast("string").alias("day"), "type", F.round("total", 4).alias("total"), "vmax", "cnt")


@book("stream_lines", "", "SELECT 'h' || CAST(user_id % 25 AS STRING) AS host, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_lines(spark, sf):
    """Monitor files arrive in two parts; the second run goes on where the first has ended."""
    folder = scratch(spark, "lines")
    days = monitor_lines(spark, sf).select(F.split_part("file", F.lit("/"), F.lit(1)).alias("host"), F.split_part("file", F.lit("/"), F.lit(2)).alias("day"), "pos", F.col("line").alias("value"))
    for own in (F.col("day") < "2024-01-16", F.col("day") >= "2024-01-16"):
        days.where(own).repartition("host").sortWithinPartitions("host", "day", "pos").select("host", "value").write.mode("append").partitionBy("host").text(f"{folder}/in")
        streams.available(linestream.lines(spark, f"{folder}/in"), folder)
    out = streams.result(spark, folder, linestream.SCHEMA).where(F.col("line").startswith("blk "))
    return out.groupBy(F.regexp_extract("file", "host=([^/]+)/", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.split("line", " ")[2].cast("long")).alias("ids"))
