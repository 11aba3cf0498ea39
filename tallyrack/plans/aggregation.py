"""Queries on sums, rates, roll-ups and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins
from ..operators.windows import counter_delta
from . import fixtures as X
from .common import Book, micros, r6
from .listing import f_metric, metrics_of

book = Book()


def jw(spark, sf):
    """(jobs, samples of each distinct window of their hosts)."""
    jobs = X.jobs(spark, sf)
    return jobs, joins.window_samples(jobs, X.samples(spark, sf))


def js(spark, sf):
    """(jobs, samples): what queries on whole jobs start from."""
    return X.jobs(spark, sf), X.samples(spark, sf)


PER = "SELECT host, epoch_us(time) AS time_us, {0} AS sum_val FROM f_wide {1} GROUP BY host, time"


@book("agg_sum_per_sample", "f_wide", PER.format("coalesce(sum(CASE WHEN arc >= 0 THEN arc END), 0)", "WHERE type = 'A'"))
def agg_sum_per_sample(spark, sf):
    return A.sum_per_sample(X.wide(spark, sf).where("type = 'A'"), "arc", nonnegative=True).select("host", micros("time"), "sum_val")


@book("agg_sum_per_sample_dev", "f_wide", "SELECT host, dev, epoch_us(time) AS time_us, sum(CASE WHEN arc >= 0 THEN arc END) AS sum_val FROM f_wide GROUP BY host, dev, time")
def agg_sum_per_sample_dev(spark, sf):
    return A.sum_per_sample(X.wide(spark, sf), "arc", ("host", "dev", "time"), True, False).select("host", "dev", micros("time"), "sum_val")


@book("agg_series", "f_js", """WITH p AS (SELECT *, CASE type WHEN 'error' THEN 0 WHEN 'view' THEN 1 END AS p FROM f_js WHERE type IN ('error', 'view') AND event IN ('k0', 'k1')), b AS (SELECT *, min(p) OVER (PARTITION BY jid) AS b FROM p)
  SELECT jid, host, epoch_us(time) AS time_us, round(sum(value) * 0.5, 6) AS value FROM b WHERE p = b GROUP BY jid, host, time""")
def agg_series(spark, sf):
    rounded = lambda d: d.withColumn("value", r6(F.col("value")))  # noqa: E731  once a sample, not for every job
    return A.job_series(X.jobs(spark, sf), X.samples(spark, sf), ["error", "view"], "value", ["k0", "k1"], 0.5, rounded).select("jid", "host", micros("time"), "value")


def rate_sql(value, type_, final="avg", extra="", per="coalesce(sum(value), 0)"):
    return f"""SELECT jid, round({final}(v), 6) AS value FROM (SELECT jid, host, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY jid, host ORDER BY b) AS r, count(*) OVER (PARTITION BY jid, host) AS n FROM (
      SELECT jid, host, floor(epoch(time) / 14400) AS b, avg({value}) AS v FROM (SELECT jid, host, time, {per} AS s FROM f_js WHERE type = '{type_}' AND event IN ('k0', 'k1') {extra} GROUP BY jid, host, time) GROUP BY 1, 2, 3)) WHERE r > 1 OR n = 1 GROUP BY 1, 2) GROUP BY jid"""


@book("agg_job_rate", "f_js", rate_sql("s * 0.1", "view"))
def agg_job_rate(spark, sf):
    jobs, s = js(spark, sf)
    own = s.where((F.col("type") == "view") & F.col("event").isin("k0", "k1"))
    rates = A.sum_per_sample(own, "value").withColumn("value", F.col("sum_val") * 0.1)
    return joins.totals(jobs, A.window_means(jobs, rates, ("value",), 14400), r6(F.avg("value")).alias("value"))


@book("agg_job_value_mean", "f_js", rate_sql("s * 2.0", "click", extra="AND value * 2.0 <= 60", per="avg(value)"))
def agg_job_value_mean(spark, sf):
    jobs, s = js(spark, sf)
    own = s.where((F.col("type") == "click") & F.col("event").isin("k0", "k1")).withColumn("value", F.col("value") * 2.0).where("value <= 60")
    return joins.totals(jobs, A.window_means(jobs, own, ("value",), 14400), r6(F.avg("value")).alias("value"))


@book("agg_cpu_allocated", "f_js", """SELECT jid, round(sum(v), 6) AS value FROM (SELECT jid, host, avg(v) AS v FROM (SELECT *, row_number() OVER (PARTITION BY jid, host ORDER BY b) AS r, count(*) OVER (PARTITION BY jid, host) AS n FROM (
  SELECT jid, host, floor(epoch(time) / 300) AS b, avg(u) AS v FROM (SELECT jid, host, time, CASE WHEN i IS NULL THEN coalesce(b, 0) * 0.01::DOUBLE WHEN coalesce(b, 0) + i = 0 THEN 0 ELSE coalesce(b, 0) / (coalesce(b, 0) + i) * ncores / nhosts END AS u FROM
  (SELECT jid, host, time, ncores, nhosts, sum(value) FILTER (event IN ('k0', 'k1')) AS b, sum(value) FILTER (event = 'k2') AS i FROM f_js WHERE type = 'view' GROUP BY ALL) WHERE b IS NOT NULL OR i IS NOT NULL) GROUP BY 1, 2, 3)) WHERE r > 1 OR n = 1 GROUP BY 1, 2) GROUP BY jid""")
def agg_cpu_allocated(spark, sf):
    jobs, s = js(spark, sf)
    use = joins.totals(jobs, A.window_cpu_use(jobs, s, "view", ["k0", "k1"], ["k2"]), F.sum("plain").alias("plain"), F.sum("share").alias("share"), keep=("jid", "ncores", "nhosts"))
    return A.cores_of(use).select("jid", r6(F.col("value")).alias("value"))


def mean_of(jobs, s, type_):
    parts = joins.window_sums(jobs, s.where(F.col("type") == type_), {"s": (F.sum("value"), F.sum), "n": (F.count("value"), F.sum)})
    return joins.totals(jobs, parts, (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("value"))


MEANS = "m AS (SELECT jid, avg(value) FILTER (type = 'error') AS e, avg(value) FILTER (type = 'purchase') AS p, avg(value) FILTER (type = 'view') AS v, avg(value) FILTER (type = 'click') AS c FROM f_js GROUP BY jid)"


@book("agg_first_available", "f_js", f"WITH {MEANS} SELECT jid, round(coalesce(e, v, c), 6) AS value, CASE WHEN e IS NOT NULL THEN 0 WHEN v IS NOT NULL THEN 1 ELSE 2 END AS source FROM m WHERE coalesce(e, v, c) IS NOT NULL")
def agg_first_available(spark, sf):
    jobs, s = js(spark, sf)
    return A.first_available([mean_of(jobs, s, t) for t in ("error", "view", "click")]).select("jid", r6(F.col("value")).alias("value"), "source")


@book("agg_sum_available", "f_js", f"WITH {MEANS} SELECT jid, round(coalesce(e, 0) + coalesce(v, 0), 6) AS value, CASE WHEN e IS NOT NULL THEN 'err' ELSE 'seen' END AS label FROM m WHERE e IS NOT NULL OR v IS NOT NULL")
def agg_sum_available(spark, sf):
    jobs, s = js(spark, sf)
    return A.sum_available({"err": mean_of(jobs, s, "error"), "seen": mean_of(jobs, s, "view")}).select("jid", r6(F.col("value")).alias("value"), "label")


@book("agg_ratio_metrics", "f_js", f"WITH {MEANS} SELECT jid, CASE WHEN v > 10 THEN round(c / v, 6) END AS value FROM m WHERE c IS NOT NULL AND v IS NOT NULL")
def agg_ratio_metrics(spark, sf):
    jobs, s = js(spark, sf)
    return A.ratio(mean_of(jobs, s, "click"), mean_of(jobs, s, "view"), 10.0).select("jid", r6(F.col("value")).alias("value"))


@book("collapse_devices", "f_wide", "SELECT host, type, event, epoch_us(time) AS time_us, CASE WHEN type = 'R' THEN dev ELSE '' END AS dev, sum(value) AS value FROM f_wide GROUP BY ALL")
def collapse_devices(spark, sf):
    w = X.wide(spark, sf).withColumns({"unit": F.lit("#"), "delta": F.col("arc"), "jid": F.lit("1")})
    return A.collapse_devices(w, ("R",)).select("host", "type", "event", micros("time"), "dev", "value")


@book("collapse_gpu_by_rule", "f_wide", "SELECT host, epoch_us(time) AS time_us, type AS event, round(CASE type WHEN 'A' THEN max(value) WHEN 'N' THEN avg(value) WHEN 'R' THEN CAST(bit_or(CAST(value AS BIGINT)) AS DOUBLE) ELSE sum(value) END, 6) AS value FROM f_wide GROUP BY host, time, type")
def collapse_gpu_by_rule(spark, sf):
    w = X.wide(spark, sf).withColumn("event", F.col("type"))
    return A.collapse_by_rule(w, ["host", "time"], {"A": "max", "N": "mean", "R": "or"}).select("host", micros("time"), "event", r6(F.col("value")).alias("value"))


@book("collapse_socket_clusters", "f_wide", """SELECT host, epoch_us(time) AS time_us, round(sum(v), 6) AS value FROM (SELECT host, time, p, avg(value) AS v FROM (SELECT *, sum(n) OVER (PARTITION BY host, time ORDER BY value RANGE UNBOUNDED PRECEDING) AS p FROM
  (SELECT host, time, value, CASE WHEN value - lag(value) OVER (PARTITION BY host, time ORDER BY value) > 4 THEN 1 ELSE 0 END AS n FROM f_wide)) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def collapse_socket_clusters(spark, sf):
    return A.cluster_mean_sum(X.wide(spark, sf), ["host", "time"], 4.0).select("host", micros("time"), r6(F.col("value")).alias("value"))


@book("agg_delta_totals", "f_grid", "SELECT jid, CASE WHEN event IN ('e0', 'e1') THEN 'read' ELSE 'write' END AS class, sum(arc) * 0.5 AS total FROM f_grid GROUP BY 1, 2")
def agg_delta_totals(spark, sf):
    return A.delta_totals(X.grid(spark, sf).withColumn("delta", F.col("arc")), {"read": ["e0", "e1"], "write": ["e2"]}, 0.5)


@book("agg_peak_job_wide", "f_grid", "SELECT jid, max(s) * 2.0 AS value FROM (SELECT jid, time, sum(arc) AS s FROM f_grid WHERE event IN ('e0', 'e2') GROUP BY 1, 2) GROUP BY jid")
def agg_peak_job_wide(spark, sf):
    return A.peak_job_wide(X.grid(spark, sf), ["e0", "e2"], 2.0)


UTIL = "SELECT jid, host, dev, event, count(value) AS cnt, max(value) AS vmax, avg(value) AS vmean FROM (SELECT *, min(p) OVER (PARTITION BY jid) AS b FROM (SELECT *, CASE type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 END AS p FROM f_js WHERE type IN ('purchase', 'view') AND event IN ('k0', 'k1'))) WHERE p = b GROUP BY 1, 2, 3, 4"


def _util(spark, sf, finish=lambda d: d, brief=False):
    jobs, s = js(spark, sf)
    return joins.over_jobs(jobs, A.window_device_use(jobs, s, ["purchase", "view"], ["k0", "k1"]), lambda d: finish(A.first_rank(d, "jid")), brief=brief)


@book("gpu_util_by_device", "f_js", f"SELECT jid, host, dev, event, cnt, vmax, round(vmean, 6) AS vmean FROM ({UTIL})")
def gpu_util_by_device(spark, sf):
    return _util(spark, sf).withColumn("vmean", r6(F.col("vmean")))


@book("gpu_summary", "f_js", f"SELECT jid, count(*) FILTER (vmax > 0) AS active, round(sum(vmax), 6) AS vmax, round(sum(vmean), 6) AS vmean FROM (SELECT *, row_number() OVER (PARTITION BY jid, host, dev ORDER BY CASE event WHEN 'k1' THEN 0 ELSE 1 END) AS r FROM ({UTIL})) WHERE r = 1 AND cnt > 1 GROUP BY jid")
def gpu_summary(spark, sf):
    return _util(spark, sf, lambda d: A.device_summary(d, ["k1", "k0"], 1), brief=True).select("jid", "active", r6(F.col("vmax")).alias("vmax"), r6(F.col("vmean")).alias("vmean"))


@book("gpu_count", "f_js", "SELECT jid, arg_min(n, p) AS n FROM (SELECT jid, p, CAST(round(sum(m)) AS BIGINT) AS n FROM (SELECT jid, CASE type WHEN 'purchase' THEN 0 ELSE 1 END AS p, host, max(floor(value) + 0.25) AS m FROM f_js WHERE type IN ('purchase', 'view') AND event = 'k2' GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE n > 0 GROUP BY jid")
def gpu_count(spark, sf):
    jobs, s = js(spark, sf)
    most = joins.window_sums(jobs, s.where("event = 'k2'"), {"value": (F.max(F.floor("value")) + 0.25, F.max)}, ("type", "event"))
    return joins.over_jobs(jobs, most, lambda d: A.device_count(d, ["purchase", "view"], "k2"), brief=True)


@book("gpu_inventory", "f_js", "SELECT jid, host, dev, max(value) FILTER (event = 'k0') AS util_max, round(avg(value) FILTER (event = 'k0'), 6) AS util_mean, count(value) FILTER (event = 'k0') AS samples, max(value) FILTER (event = 'k1') AS peak_power FROM f_js GROUP BY 1, 2, 3")
def gpu_inventory(spark, sf):
    jobs, d = jw(spark, sf)
    return joins.to_jobs(jobs, A.device_inventory(d, "k0", "k1")).withColumn("util_mean", r6(F.col("util_mean")))


@book("distinct_samples", "f_js", "SELECT jid, sum(n) AS n FROM (SELECT jid, host, count(DISTINCT time) AS n FROM f_js GROUP BY 1, 2) GROUP BY jid")
def distinct_samples(spark, sf):
    return A.distinct_samples(X.jobs(spark, sf), X.samples(spark, sf))


def bounds(spark, sf):
    jobs, s = js(spark, sf)
    return joins.totals(jobs, ends_of(jobs, s), F.min("first").alias("first"), F.max("last").alias("last"))


def ends_of(jobs, s):
    return joins.window_sums(jobs, s, {"first": (F.min("time"), F.min), "last": (F.max("time"), F.max)})


@book("telemetry_bounds", "f_js", "SELECT jid, min(epoch_us(time)) AS first_us, max(epoch_us(time)) AS last_us FROM f_js GROUP BY jid")
def telemetry_bounds(spark, sf):
    return bounds(spark, sf).select("jid", micros("first"), micros("last"))


def schemas(spark, sf, column):
    """``column`` of the schema of each job."""
    jobs, s = js(spark, sf)
    seen = joins.window_sums(jobs, s, {"n": (F.count(F.lit(1)), F.sum)}, ("type", "event"))
    return joins.over_jobs(jobs, seen.groupBy("jid").agg(F.collect_list(F.struct("type", "event")).alias("pairs")), lambda d: A.schema_of(d).select("jid", column))  # a small vocabulary


@book("job_schema", "f_js", "SELECT jid, string_agg(t, ';' ORDER BY t) AS schema FROM (SELECT jid, type || '=' || string_agg(DISTINCT event, ',' ORDER BY event) AS t FROM f_js GROUP BY jid, type) GROUP BY jid")
def job_schema(spark, sf):
    flat = F.array_join(F.transform(F.map_entries("schema"), lambda e: F.concat(e.key, F.lit("="), F.array_join(e.value, ","))), ";")
    return schemas(spark, sf, flat.alias("schema"))


@book("host_time_grid", "f_js", "SELECT DISTINCT jid, host, epoch_us(time) AS time_us FROM f_js")
def host_time_grid(spark, sf):
    return A.host_time_grid(X.jobs(spark, sf), X.samples(spark, sf)).select("jid", "host", micros("time"))


@book("cluster_mean_matrix", "f_grid", "SELECT jid, epoch_us(time) AS time_us, event, round(avg(value), 6) AS mean FROM f_grid GROUP BY 1, 2, 3")
def cluster_mean_matrix(spark, sf):
    return A.cluster_mean(X.grid(spark, sf), ["jid"], "value").select("jid", micros("time"), "event", r6(F.col("mean")).alias("mean"))


@book("type_detail_table", "f_grid", "SELECT jid, host AS type, event, CAST(epoch(time) - min(epoch(time)) OVER (PARTITION BY jid) AS BIGINT) AS elapsed, round(CASE WHEN host IN ('g0', 'g1') THEN value ELSE arc END, 6) AS mean FROM f_grid")
def type_detail_table(spark, sf):
    return A.type_detail(X.grid(spark, sf).withColumn("type", F.col("host")), ("g0", "g1")).withColumn("mean", r6(F.col("mean")))


@book("job_totals", "f_job", "SELECT count(*) AS jobs, round(sum(node_hrs), 4) AS node_hrs, round(avg(CASE WHEN start_time >= submit_time THEN (epoch_us(start_time) - epoch_us(submit_time)) / 3.6e9 END), 4) AS wait_hours FROM f_job")
def job_totals(spark, sf):
    return A.job_totals(X.jobs(spark, sf))


QUEUE = "CASE WHEN queue = '1-URGENT' THEN '(no queue)' ELSE queue END"


def _queues(spark, sf):
    return X.jobs(spark, sf).withColumn("queue", F.when(F.col("queue") == "1-URGENT", F.when(F.col("nhosts") == 1, " ")).otherwise(F.col("queue")))


@book("jobs_by_queue", "f_job", f"SELECT {QUEUE} AS queue, CAST(count(DISTINCT jid) AS DOUBLE) AS value FROM f_job GROUP BY 1")
def jobs_by_queue(spark, sf):
    return A.by_queue(_queues(spark, sf))


@book("node_hours_by_queue", "f_job", f"SELECT {QUEUE} AS queue, sum(node_hrs) AS value FROM f_job GROUP BY 1")
def node_hours_by_queue(spark, sf):
    return A.by_queue(_queues(spark, sf), "node_hrs")


@book("user_failure_rates", "f_job", "SELECT username, count(*) AS total, count(*) FILTER (state = 'FAILED') AS failed, count(*) FILTER (state = 'TIMEOUT') AS timed_out, round(100 * failed / total, 2) AS failed_pct, round(100 * timed_out / total, 2) AS timed_out_pct FROM f_job GROUP BY username HAVING count(*) > 150")
def user_failure_rates(spark, sf):
    return A.failure_rates(X.jobs(spark, sf), 300)


@book("user_gpu_rollup", "f_metric", "SELECT username, round(coalesce(sum(value) FILTER (metric = 'avg_k0'), 0), 4) AS active, round(coalesce(sum(value) FILTER (metric = 'avg_k1'), 0), 4) AS total FROM f_metric JOIN f_job USING (jid) WHERE metric IN ('avg_k0', 'avg_k1') GROUP BY username")
def user_gpu_rollup(spark, sf):
    return A.gpu_rollup(f_metric(spark, sf), X.jobs(spark, sf), "avg_k0", "avg_k1").select("username", F.round("active", 4).alias("active"), F.round("total", 4).alias("total"))


EF = "((epoch_us(start_time) - epoch_us(submit_time)) / 1e6 + runtime) / (ncores * runtime)"
OK = "start_time >= submit_time AND runtime > 0 AND ncores > 0"


@book("expansion_factor_month", "f_job", f"SELECT strftime(end_time, '%Y-%m') AS period, strftime(end_time, '%Y-%m-%d') AS part, round(avg({EF}), 6) AS mean FROM f_job WHERE {OK} GROUP BY 1, 2")
def expansion_factor_month(spark, sf):
    return A.expansion_means(X.jobs(spark, sf)).withColumn("mean", r6(F.col("mean")))


@book("expansion_factor_year", "f_job", f"SELECT strftime(end_time, '%Y') AS period, strftime(end_time, '%G-%V') AS part, round(avg({EF}), 6) AS mean FROM f_job WHERE {OK} GROUP BY 1, 2")
def expansion_factor_year(spark, sf):
    return A.expansion_means(X.jobs(spark, sf), "year").withColumn("mean", r6(F.col("mean")))


@book("histogram_fixed_edges", "f_sample", f"SELECT CAST(i AS INT) AS bin, e AS edge, (SELECT count(*) FROM f_sample WHERE value >= e AND (f IS NULL OR value < f)) AS n FROM (SELECT i, e, lead(e) OVER (ORDER BY i) AS f FROM (SELECT unnest(range(1, 18)) AS i, unnest({list(A.EDGES)}::DOUBLE[]) AS e))")
def histogram_fixed_edges(spark, sf):
    return A.hist_edges(X.samples(spark, sf), "value")


AUTO = """r AS (SELECT grp, min(v) AS lo, max(v) AS hi, greatest(3, CAST(floor(5 * ln(count(*))) AS BIGINT)) AS bins FROM d GROUP BY grp), n AS (SELECT grp, least(CAST(floor((v - lo) / (hi - lo) * bins) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM d JOIN r USING (grp) GROUP BY 1, 2)
  SELECT grp, b.bin, round(lo + b.bin * (hi - lo) / bins, 6) AS edge, coalesce(n, 0) AS n FROM (SELECT *, unnest(range(0, bins)) AS bin FROM r) b LEFT JOIN n USING (grp, bin)"""


@book("histogram_equal_width", "f_sample", "WITH d AS (SELECT type AS grp, value AS v FROM f_sample), " + AUTO)
def histogram_equal_width(spark, sf):
    d = X.samples(spark, sf).select(F.col("type").alias("grp"), "value")
    return A.hist_auto(d, "grp", "value").withColumn("edge", r6(F.col("edge")))


@book("job_histograms", "f_job", "WITH d AS (SELECT 'runtime' AS grp, runtime / 3600 AS v FROM f_job UNION ALL SELECT 'nhosts', CAST(nhosts AS DOUBLE) FROM f_job UNION ALL SELECT 'wait', (epoch_us(start_time) - epoch_us(submit_time)) / 3.6e9 FROM f_job WHERE start_time >= submit_time), " + AUTO)
def job_histograms(spark, sf):
    from ..functions.scalars import queue_wait_hours

    j = X.jobs(spark, sf).select((F.col("runtime") / 3600).alias("runtime"), F.col("nhosts").cast("double").alias("nhosts"), queue_wait_hours(F.col("submit_time"), F.col("start_time")).alias("wait"))
    return A.hist_auto(j.unpivot([], ["runtime", "nhosts", "wait"], "grp", "value").where("value is not null"), "grp", "value").withColumn("edge", r6(F.col("edge")))


@book("facet_options", "f_job", """SELECT 'username' AS dimension, username AS value, false AS truncated FROM f_job WHERE queue = '5-LOW' GROUP BY 2 UNION ALL SELECT 'queue', queue, false FROM f_job WHERE username = 'u3' GROUP BY 2
  UNION ALL SELECT 'state', CASE state WHEN 'COMPLETED' THEN 'completed' WHEN 'FAILED' THEN 'failed' ELSE 'timeout' END, false FROM f_job WHERE queue = '5-LOW' AND username = 'u3' GROUP BY 2""")
def facet_options(spark, sf):
    from ..functions.scalars import classify_state

    dims = {"username": F.col("username"), "queue": F.col("queue"), "state": classify_state(F.col("state"))}
    return A.facets(X.jobs(spark, sf), {"queue": "5-LOW", "username": "u3"}, dims)


@book("home_options", "f_job", "SELECT DISTINCT 'day' AS kind, strftime(end_time, '%Y-%m-%d') AS value, strftime(end_time, '%Y-%m') AS parent FROM f_job UNION SELECT 'year', strftime(end_time, '%Y'), NULL FROM f_job UNION SELECT 'queue', queue, NULL FROM f_job UNION SELECT 'state', state, NULL FROM f_job")
def home_options(spark, sf):
    return A.home_options(X.jobs(spark, sf))


HEALTH = "SELECT type, event, count(*) AS row_count, bool_or(CASE WHEN (type = 'click' AND event <> 'k0') OR (type = 'signup' AND event = 'k1') THEN 0 ELSE value END <> 0) AS has_nonzero, list_sort(list(DISTINCT host)) AS hosts FROM f_sample WHERE time >= TIMESTAMP '2024-01-10' AND event <> 'k2' GROUP BY 1, 2"


def _health(spark, sf):
    s = X.samples(spark, sf).where("event <> 'k2'").withColumn("value", F.when((F.col("type") == "click") & (F.col("event") != "k0"), 0.0).otherwise(F.col("value")))
    s = s.withColumn("value", F.when((F.col("type") == "signup") & (F.col("event") == "k1"), 0.0).otherwise(F.col("value")))
    return A.telemetry_health(s, F.to_timestamp(F.lit("2024-01-10 00:00:00")))


@book("telemetry_health", "f_sample", f"SELECT type, event, row_count, has_nonzero, array_to_string(hosts[1:16], ',') AS hosts FROM ({HEALTH})")
def telemetry_health(spark, sf):
    return _health(spark, sf).withColumn("hosts", F.array_join("hosts", ","))


#: A third of the hosts have told no identity; three types are core, one of which has no rows.
FINDINGS_SQL = f"""h AS ({HEALTH}), c(type) AS (VALUES ('click'), ('view'), ('fabric')),
  z AS (SELECT CASE WHEN type IN (SELECT type FROM c) THEN 'all_zero_core_event' ELSE 'all_zero_other_event' END AS kind, type, event, '' AS host, row_count FROM h WHERE NOT has_nonzero UNION ALL SELECT 'missing_core_type', type, '', '', NULL FROM c WHERE type NOT IN (SELECT type FROM h)
    UNION ALL SELECT 'signature_absent', '', '', host, NULL FROM (SELECT DISTINCT host FROM f_sample) WHERE CAST(host[2:] AS INT) % 3 = 0),
  f AS (SELECT *, CASE kind WHEN 'all_zero_other_event' THEN 'low' WHEN 'signature_absent' THEN 'medium' ELSE 'high' END AS severity, CAST(row_number() OVER (PARTITION BY kind ORDER BY type, event, host) AS INT) AS place, count(*) OVER (PARTITION BY kind) AS total FROM z)"""


def _findings(spark, sf):
    core = spark.createDataFrame([("click",), ("view",), ("fabric",)], "type string")
    hosts = X.samples(spark, sf).select("host").distinct()
    return A.telemetry_findings(_health(spark, sf), core, hosts, hosts.where(F.substring("host", 2, 9).cast("int") % 3 != 0), {"all_zero_core_event": 500, "signature_absent": 5})


@book("telemetry_findings", "f_sample", f"WITH {FINDINGS_SQL} SELECT kind, severity, type, event, host, row_count, place, total FROM f WHERE kind <> 'signature_absent' OR place <= 5")
def telemetry_findings(spark, sf):
    return _findings(spark, sf)


@book("telemetry_verdict", "f_sample", f"WITH {FINDINGS_SQL} SELECT count(*) FILTER (severity = 'high') AS actionable, count(*) FILTER (severity <> 'high' AND (kind <> 'signature_absent' OR place <= 5)) AS informational, any_value(n) AS nonzero_pairs, actionable = 0 AND any_value(n) > 0 AS healthy FROM f, (SELECT count(*) AS n FROM h WHERE has_nonzero)")
def telemetry_verdict(spark, sf):
    return A.telemetry_verdict(_findings(spark, sf), _health(spark, sf))


@book("fleet_freshness", "f_sample", "SELECT host, 1706745600 - CAST(floor(epoch(max(time))) AS BIGINT) AS age, CASE WHEN age > 604800 THEN '>1 week' WHEN age > 86400 THEN '>1 day' WHEN age > 3600 THEN '>1 h' WHEN age > 600 THEN '>10 min' ELSE 'ok' END AS bucket FROM f_sample GROUP BY host")
def fleet_freshness(spark, sf):
    return A.freshness(X.samples(spark, sf), F.timestamp_seconds(F.lit(1706745600)))


@book("merge_partial_aggs", "f_sample", "SELECT type, round(sum(value), 4) AS total, max(value) AS vmax, count(*) AS cnt, round(avg(value), 6) AS mean FROM f_sample GROUP BY type")
def merge_partial_aggs(spark, sf):
    p = X.samples(spark, sf).groupBy("type", "host").agg(F.sum("value").alias("s"), F.max("value").alias("m"), F.count("value").alias("n"))
    return A.merge_partials(p, ["type"]).select("type", F.round("total", 4).alias("total"), "vmax", "cnt", r6(F.col("mean")).alias("mean"))


@book("precision_mix", "f_metric", """WITH l(metric, kind, label) AS (VALUES ('avg_k0', 'gpu', 'tensor'), ('avg_k1', 'gpu', 'fp16'), ('avg_k2', 'cpu', 'fp64')), p AS (SELECT jid, kind, label, sum(value) AS value, max(CASE WHEN label = 'fp16' THEN 1 ELSE 0 END) OVER (PARTITION BY jid, kind) AS s FROM f_metric JOIN l USING (metric) WHERE value > 0 AND type = 'view' GROUP BY jid, kind, label)
  SELECT jid, kind, label, round(value / sum(value) OVER (PARTITION BY jid, kind), 6) AS share FROM p WHERE NOT (label = 'tensor' AND s > 0)""")
def precision_mix(spark, sf):
    labels = spark.createDataFrame([("avg_k0", "gpu", "tensor"), ("avg_k1", "gpu", "fp16"), ("avg_k2", "cpu", "fp64")], "metric string, kind string, label string")
    return A.precision_mix(f_metric(spark, sf).where("type = 'view'"), labels, "tensor", ["fp16"]).withColumn("share", r6(F.col("share")))


@book("cli_job_summary", "f_metric", "SELECT jid, round(100 * max(value) FILTER (metric = 'avg_k0') / any_value(ncores), 8) AS cpu_pct, round(max(value) FILTER (metric = 'avg_k1'), 6) AS gpu_pct, round(max(value) FILTER (metric = 'avg_k2'), 6) AS memory FROM f_metric JOIN f_job USING (jid) GROUP BY jid")
def cli_job_summary(spark, sf):
    jobs, d = js(spark, sf)
    parts, metrics = metrics_of(jobs, d)
    names = ("avg_k0", "avg_k1", "avg_k2")
    s = A.summary_of(joins.over_jobs(jobs, parts, lambda d: A.summary_parts(metrics(d), *names), keep=("jid", "ncores")))
    return s.select("jid", F.round("cpu_pct", 8).alias("cpu_pct"), *[r6(F.col(c)).alias(c) for c in ("gpu_pct", "memory")])
