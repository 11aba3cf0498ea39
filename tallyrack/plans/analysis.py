"""Queries on grid metrics, windows, sorting, sets and readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins
from ..operators import metrics as M
from ..operators import readiness as R
from ..operators import series as S
from ..operators import windows as W
from . import fixtures as X
from .aggregation import ends_of, js, jw, schemas
from .common import Book, micros, r6, simple_ctes, values
from ..operators.catalog import FP_DOUBLE, INSUFFICIENT
from .listing import f_metric, metrics_of

book = Book()
RATE = "r AS (SELECT *, CASE WHEN dt > 0 THEN (value - p) / dt END AS rate, epoch(time) - dt / 2 AS mid FROM (SELECT *, lag(value) OVER w AS p, epoch(time) - lag(epoch(time)) OVER w AS dt FROM g WINDOW w AS (PARTITION BY jid, host, event ORDER BY time)))"
DENSE = """g AS (SELECT t.jid, h.host, t.time, h.event, f.value FROM (SELECT DISTINCT jid, time FROM f_grid WHERE event IN ('e0', 'e1')) t JOIN (SELECT DISTINCT jid, host, event FROM f_grid WHERE event IN ('e0', 'e1')) h USING (jid) LEFT JOIN f_grid f ON f.jid = t.jid AND f.host = h.host AND f.event = h.event AND f.time = t.time)"""


def dense(spark, sf):
    return M.grid_densify(X.grid(spark, sf), ["e0", "e1"])


@book("grid_densify", "f_grid", f"WITH {DENSE} SELECT jid, host, epoch_us(time) AS time_us, event, value FROM g")
def grid_densify(spark, sf):
    return dense(spark, sf).select("jid", "host", micros("time"), "event", "value")


@book("interval_rate", "f_grid", f"WITH {DENSE}, {RATE} SELECT jid, host, epoch_us(time) AS time_us, event, round(rate, 9) AS rate FROM r")
def interval_rate(spark, sf):
    return M.interval_rate(dense(spark, sf)).select("jid", "host", micros("time"), "event", F.round("rate", 9).alias("rate"))


GOOD = "max({0}) FILTER ({0} > 0 AND {0} <= 400)".format
PEAK = "(v - lag(v) OVER w) / nullif(greatest(epoch(time) - lag(epoch(time)) OVER w, 0), 0) AS r"


@book("metric_peak_rate", "f_grid", f"""WITH o AS (SELECT * FROM f_grid WHERE event IN ('e0', 'e1')), t AS (SELECT jid, time, CASE WHEN count(a) = 2 THEN sum(a) END AS a, CASE WHEN count(v) = 2 THEN sum(v) END AS v FROM (SELECT jid, time, event, avg(arc) AS a, avg(value) AS v FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2),
  x AS (SELECT jid, a, {PEAK} FROM t WINDOW w AS (PARTITION BY jid ORDER BY time)), y AS (SELECT jid, {PEAK} FROM (SELECT jid, host, time, sum(value) AS v FROM o GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY jid, host ORDER BY time))
  SELECT jid, round(coalesce(p1, p2, p3), 6) AS value FROM (SELECT jid, {GOOD("a")} AS p1, {GOOD("r")} AS p2 FROM x GROUP BY jid) FULL JOIN (SELECT jid, {GOOD("r")} AS p3 FROM y GROUP BY jid) USING (jid)""")
def metric_peak_rate(spark, sf):
    return M.peak_rate(X.grid(spark, sf), ["e0", "e1"], 1.0, 400.0).select("jid", r6(F.col("value")).alias("value"))


@book("metric_end_to_end", "f_grid", """SELECT jid, round(nullif(avg(d), 0), 9) AS value FROM (SELECT jid, host, (sum(value) FILTER (time = t1) - sum(value) FILTER (time = t0)) / (epoch(t1) - epoch(t0)) * 1000 AS d FROM
  (SELECT *, min(time) OVER (PARTITION BY jid) AS t0, max(time) OVER (PARTITION BY jid) AS t1 FROM f_grid WHERE event = 'e1') GROUP BY jid, host, t0, t1) WHERE d >= 0 GROUP BY jid""")
def metric_end_to_end(spark, sf):
    return M.end_to_end(X.grid(spark, sf), "e1", 1000.0).select("jid", F.round("value", 9).alias("value"))


@book("metric_vector_mix", "f_grid", "SELECT jid, round(avg(100 * v / o), 6) AS percent, round(avg(o / n), 6) AS width FROM (SELECT jid, host, coalesce(sum(arc * CASE event WHEN 'e1' THEN 4 WHEN 'e2' THEN 8 END), 0) AS v, sum(arc * CASE event WHEN 'e0' THEN 1 WHEN 'e1' THEN 4 ELSE 8 END) AS o, sum(arc) AS n FROM f_grid GROUP BY 1, 2) GROUP BY jid")
def metric_vector_mix(spark, sf):
    return M.vector_mix(X.grid(spark, sf), {"e0": 1, "e1": 4, "e2": 8}).select("jid", r6(F.col("percent")).alias("percent"), r6(F.col("width")).alias("width"))


def imbalance_sql(source, col):
    return f"SELECT jid, round(100 * max(coalesce(s, 0)), 6) AS value FROM (SELECT jid, host, avg((m - x) / m) AS s FROM (SELECT *, max(x) OVER (PARTITION BY jid, time) AS m FROM (SELECT jid, host, time, greatest({col}, 0) AS x FROM {source} WHERE event = 'e0')) WHERE m > 0 GROUP BY 1, 2) GROUP BY jid"


@book("metric_node_imbalance", "f_grid", f"WITH {DENSE}, {RATE} " + imbalance_sql("r", "rate"))
def metric_node_imbalance(spark, sf):
    return M.node_imbalance(M.interval_rate(dense(spark, sf)).where("event = 'e0'"), "rate").select("jid", r6(F.col("value")).alias("value"))


@book("metric_snapshot_imbalance", "f_grid", imbalance_sql("f_grid", "arc"))
def metric_snapshot_imbalance(spark, sf):
    return M.node_imbalance(X.grid(spark, sf).where("event = 'e0'"), "arc").select("jid", r6(F.col("value")).alias("value"))


@book("metric_time_imbalance", "f_grid", f"""WITH {DENSE}, {RATE}, q AS (SELECT jid, host, mid, greatest(rate, 0) AS rate FROM r WHERE event = 'e0' AND rate IS NOT NULL), s AS (SELECT *, coalesce((rate + lag(rate) OVER w) / 2 * (mid - lag(mid) OVER w), 0) AS seg, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY jid, host) AS n FROM q WINDOW w AS (PARTITION BY jid, host ORDER BY mid)),
  c AS (SELECT *, sum(seg) OVER (PARTITION BY jid, host ORDER BY mid ROWS UNBOUNDED PRECEDING) AS cum, sum(seg) OVER (PARTITION BY jid, host) AS total, min(mid) OVER (PARTITION BY jid, host) AS t0, max(mid) OVER (PARTITION BY jid, host) AS t1 FROM s), d AS (SELECT *, lag(cum) OVER (PARTITION BY jid, host ORDER BY mid) AS before FROM c)
  SELECT jid, round(100 * min(q), 4) AS value FROM (SELECT jid, CASE WHEN before / (mid - t0) > 0 THEN ((total - cum) / (t1 - mid)) / (before / (mid - t0)) END AS q FROM d WHERE n >= 4 AND i >= 2 AND i <= n - 2) WHERE q >= 0 AND q <= 1e9 GROUP BY jid""")
def metric_time_imbalance(spark, sf):
    return M.time_imbalance(M.interval_rate(dense(spark, sf)).where("event = 'e0'")).select("jid", F.round("value", 4).alias("value"))


@book("metric_mem_hwm", "f_grid", "SELECT jid, round(max(u - coalesce(l, 0)) / 1024, 6) AS value FROM (SELECT jid, host, time, sum(value) FILTER (event = 'e0') AS u, sum(value) FILTER (event IN ('e1', 'e2')) AS l FROM f_grid GROUP BY 1, 2, 3) GROUP BY jid")
def metric_mem_hwm(spark, sf):
    return M.memory_high_water(X.grid(spark, sf), "e0", ["e1", "e2"], 1 / 1024).select("jid", r6(F.col("value")).alias("value"))


@book("metric_gpu_peaks", "f_js", "SELECT jid, coalesce(max(value) FILTER (type = 'purchase' AND event = 'k0' AND value > 0), max(value) FILTER (type = 'view' AND event = 'k0' AND value > 0)) AS power, coalesce(nullif(max(CAST(floor(value) AS BIGINT)) FILTER (type = 'purchase' AND event = 'k1' AND value > 0), 0), nullif(max(CAST(floor(value) AS BIGINT)) FILTER (type = 'view' AND event = 'k1' AND value > 0), 0)) AS mask FROM f_js WHERE type IN ('purchase', 'view') GROUP BY jid")
def metric_gpu_peaks(spark, sf):
    jobs, d = jw(spark, sf)
    most = d.where((F.col("value") > 0) & (F.col("value") < M.BLANK)).groupBy("jid", "type", "event").agg(F.max("value").alias("value"))
    return joins.over_jobs(jobs, d.select("jid", "type").distinct().join(most, ["jid", "type"], "left"), lambda d: M.gpu_peaks(d, ["purchase", "view"], "k0", "k1"))


POWER = "p AS (SELECT jid, host, time, CASE WHEN m > 0 THEN m ELSE coalesce(c, 0) + coalesce(g, 0) END AS w FROM (SELECT jid, host, time, sum(arc) FILTER (event = 'e9') AS m, sum(arc) FILTER (event = 'e0') AS c, sum(arc) FILTER (event = 'e2') AS g FROM f_grid GROUP BY 1, 2, 3) WHERE m > 0 OR c IS NOT NULL OR g IS NOT NULL)"


def power(spark, sf):
    return M.node_power(X.grid(spark, sf).withColumn("value", F.col("arc")), "e9", ["e8", "e0"], "e2")


@book("metric_node_power", "f_grid", f"WITH {POWER} SELECT jid, max(w) AS peak, round(avg(w), 6) AS mean FROM p GROUP BY jid")
def metric_node_power(spark, sf):
    return M.power_summary(power(spark, sf)).select("jid", "peak", r6(F.col("mean")).alias("mean"))


@book("metric_energy", "f_grid", f"WITH {POWER} SELECT jid, round(sum(e), 4) AS value FROM (SELECT jid, (w + lag(w) OVER x) / 2 * (epoch(time) - lag(epoch(time)) OVER x) / 3600 AS e FROM p WINDOW x AS (PARTITION BY jid, host ORDER BY time)) GROUP BY jid")
def metric_energy(spark, sf):
    return M.energy(power(spark, sf)).select("jid", F.round("value", 4).alias("value"))


#: What the types and events of the driver's samples stand for, so that every kind of simple metric has samples.
ROLES = {
    ("view", "k0"): ("host_ib", "port_xmit_data"), ("view", "k1"): ("host_ib", "port_rcv_data"), ("view", "k2"): ("host_opa", "PortXmitData"),
    ("click", "k0"): ("amd_x86_pmc", "fp_ops_retired"), ("click", "k1"): ("intel_x86_pmc_gpr8", FP_DOUBLE[2]), ("click", "k2"): ("intel_x86_pmc_gpr4", "SIMD_DOUBLE_256"),
    ("purchase", "k0"): ("host_block", "rd_sectors"), ("purchase", "k1"): ("lustre_llite", "vfs_read_bytes"), ("purchase", "k2"): ("host_nfs", "normal_read"),
    ("error", "k0"): ("nvidia_gpu", "tensor_active"), ("error", "k1"): ("amd_gpu", "tensor_active"), ("error", "k2"): ("nvidia_gpu", "gpu_mem_bw_bytes_rate"),
    ("signup", "k0"): ("host_cpu", "user"), ("signup", "k1"): ("host_cpu", "idle"), ("signup", "k2"): ("intel_x86_uncore_imc_skx", "dram_cas_reads"),
}
@book("metric_simple", "f_js", f"""WITH m(t, e, rt, re) AS (VALUES {values((*k, *v) for k, v in ROLES.items())}),
  s AS (SELECT jid, host, time, ncores, nhosts, rt AS type, re AS event, value, value - 20 AS arc FROM f_js JOIN m ON f_js.type = m.t AND f_js.event = m.e), {simple_ctes(14400)}
  SELECT jid, type, metric, units, value FROM simple JOIN units USING (metric)""")
def metric_simple(spark, sf):
    role = lambda i: F.create_map(*[F.lit(x) for k, v in ROLES.items() for x in ("/".join(k), v[i])])[F.concat_ws("/", "type", "event")]
    jobs, d = jw(spark, sf)
    own = d.withColumns({"type": role(0), "event": role(1), "arc": F.col("value") - 20}).where("type is not null")
    return M.simple_metrics(own, seconds=14400, job=jobs)


SPECS = (("view", "value", ("k0", "k1"), "seen", 0.5), ("error", "value", ("k2",), "errs", 2.0))


@book("summary_series", "f_js", "SELECT jid, host, epoch_us(time) AS time_us, round(sum(value) FILTER (type = 'view' AND event IN ('k0', 'k1')) * 0.5, 6) AS seen, round(sum(value) FILTER (type = 'error' AND event = 'k2') * 2, 6) AS errs FROM f_js WHERE (type = 'view' AND event IN ('k0', 'k1')) OR (type = 'error' AND event = 'k2') GROUP BY jid, host, time")
def summary_series(spark, sf):
    jobs, s = js(spark, sf)
    d = M.summary_series(s, SPECS, ("host", "time")).withColumns({c: r6(F.col(c)) for c in ("seen", "errs")})  # a sample's sums are the same in all jobs
    return joins.job_rows(jobs, d).select("jid", "host", micros("time"), "seen", "errs")


ROLE_SQL = f"""m(t, e, rt, re) AS (VALUES {values((*k, *v) for k, v in ROLES.items())}),
  s AS (SELECT jid, host, dev, date_trunc('day', time) AS time, rt AS type, re AS event, value, value - 20 AS arc FROM f_js JOIN m ON f_js.type = m.t AND f_js.event = m.e)"""


def _by_day(spark, sf):
    """The samples of the jobs' windows in their roles, and the jobs; times cut to days so that several counters share a sample."""
    role = lambda i: F.create_map(*[F.lit(x) for k, v in ROLES.items() for x in ("/".join(k), v[i])])[F.concat_ws("/", "type", "event")]
    jobs, s = js(spark, sf)
    own = s.withColumns({"type": role(0), "event": role(1), "at_day": F.date_trunc("day", "time"), "arc": F.col("value") - 20}).where("type is not null")
    d = joins.window_sums(jobs, own, {c: (F.sum(c), F.sum) for c in ("value", "arc")}, ("at_day", "type", "event"))
    return d.withColumnRenamed("at_day", "time"), jobs


SHOWN = ("ibbw", "flops64b", "amd_flops", "nv_tensor_active", "cpu")


@book("job_series", "f_js", f"""WITH {ROLE_SQL},
  w AS (SELECT jid, host, time, sum(arc) FILTER (type = 'host_ib') / 1048576 AS ib, sum(arc) FILTER (type = 'host_opa') / 125000 AS opa, sum(arc) FILTER (type = 'intel_x86_pmc_gpr8') * 1e-9::DOUBLE AS f8,
    sum(arc) FILTER (type = 'amd_x86_pmc') * 1e-9::DOUBLE AS amd, sum(value) FILTER (type = 'nvidia_gpu' AND event = 'tensor_active') AS tensor, sum(arc) FILTER (type = 'host_cpu' AND event = 'user') * 0.01::DOUBLE AS cpu FROM s GROUP BY ALL),
  c AS (SELECT jid, count(*) AS n, count(ib) AS ib, count(f8) AS f8, count(amd) AS amd, count(cpu) AS cpu FROM w GROUP BY jid)
  SELECT w.jid, host, epoch_us(time::TIMESTAMP) AS time_us, format('{{:.6e}}', CASE WHEN c.ib = n THEN w.ib ELSE opa END) AS ibbw, format('{{:.6e}}', CASE WHEN c.f8 = n THEN w.f8 END) AS flops64b,
    format('{{:.6e}}', CASE WHEN c.amd = n THEN w.amd END) AS amd_flops, format('{{:.6e}}', tensor) AS nv_tensor_active, format('{{:.6e}}', CASE WHEN c.cpu = n THEN w.cpu END) AS cpu FROM w JOIN c USING (jid)""")
def job_series(spark, sf):
    shown = ["host", micros("time"), *[F.when(F.col(c).isNotNull(), F.format_string("%.6e", c)).alias(c) for c in SHOWN]]
    return S.job_series(*_by_day(spark, sf), columns=shown)


@book("job_roofline", "f_js", f"""WITH {ROLE_SQL},
  w AS (SELECT jid, host, time, sum(arc) FILTER (type = 'intel_x86_pmc_gpr8') * 1e-9::DOUBLE AS f8, sum(arc) FILTER (type = 'intel_x86_pmc_gpr4') * 4e-9::DOUBLE AS f4, sum(arc) FILTER (type = 'intel_x86_uncore_imc_skx') * 64 / 1073741824 AS b FROM s GROUP BY ALL),
  p AS (SELECT w.jid, host, time, CASE WHEN n > 0 THEN f8 ELSE f4 END AS f, b FROM w JOIN (SELECT jid, count(f8) AS n FROM w GROUP BY jid) c USING (jid))
  SELECT jid, host, epoch_us(time::TIMESTAMP) AS time_us, format('{{:.6e}}', f) AS flops_gf, format('{{:.6e}}', b) AS bw_gb, format('{{:.6e}}', f / b) AS ai FROM p WHERE f > 0 AND b > 0""")
def job_roofline(spark, sf):
    return S.job_roofline(*_by_day(spark, sf), columns=["host", micros("time"), *[F.format_string("%.6e", c).alias(c) for c in ("flops_gf", "bw_gb", "ai")]])


@book("host_series", "f_sample", "SELECT host, epoch_us(time) AS time_us, round(sum(value) FILTER (type = 'view' AND event IN ('k0', 'k1')) * 0.5, 6) AS seen, round(sum(value) FILTER (type = 'error' AND event = 'k2') * 2, 6) AS errs FROM f_sample WHERE host = 'h3' AND time >= TIMESTAMP '2024-01-05' AND time <= TIMESTAMP '2024-01-12' AND ((type = 'view' AND event IN ('k0', 'k1')) OR (type = 'error' AND event = 'k2')) GROUP BY host, time")
def host_series(spark, sf):
    at = lambda d: F.to_timestamp(F.lit(f"{d} 00:00:00"))
    return M.host_series(X.samples(spark, sf), "h3", at("2024-01-05"), at("2024-01-20"), SPECS).select("host", micros("time"), r6(F.col("seen")).alias("seen"), r6(F.col("errs")).alias("errs"))


@book("hw_error_series", "f_grid", "SELECT jid, host, epoch_us(time) AS time_us, event, arc FROM f_grid g WHERE event IN ('e0', 'e1') AND EXISTS (SELECT 1 FROM f_grid o WHERE o.jid = g.jid AND o.event = g.event AND o.arc <> 0)")
def hw_error_series(spark, sf):
    return M.error_series(X.grid(spark, sf), ["e0", "e1"]).select("jid", "host", micros("time"), "event", "arc")


def roof_sql(keys, out, view):
    return f"SELECT {out}, round(f, 6) AS flops_gf, round(b, 6) AS bw_gb, round(f / b, 6) AS ai FROM (SELECT {keys}, coalesce(sum(arc) FILTER (event = '{{0}}'), 0) * 2 + coalesce(sum(arc) FILTER (event = '{{1}}'), 0) * 8 AS f, coalesce(sum(arc) FILTER (event = '{{2}}'), 0) * 0.5 AS b FROM {view} GROUP BY {keys}) WHERE b <> 0 AND f / b > 0 AND f > 0"


@book("roofline_cpu", "f_grid", roof_sql("jid, host, time", "jid, host, epoch_us(time) AS time_us", "f_grid").format("e0", "e1", "e2"))
def roofline_cpu(spark, sf):
    r = M.roofline(X.grid(spark, sf), {"e0": 2.0, "e1": 8.0}, {"e2": 0.5}, ["jid", "host", "time"])
    return r.select("jid", "host", micros("time"), *[r6(F.col(c)).alias(c) for c in ("flops_gf", "bw_gb", "ai")])


@book("roofline_gpu", "f_wide", roof_sql("host, dev, time", "host, dev, epoch_us(time) AS time_us", "(SELECT host, dev, time, type AS event, value AS arc FROM f_wide)").format("A", "R", "N"))
def roofline_gpu(spark, sf):
    w = X.wide(spark, sf).select("host", "dev", "time", F.col("type").alias("event"), F.col("value").alias("arc"))
    r = M.roofline(w, {"A": 2.0, "R": 8.0}, {"N": 0.5}, ["host", "dev", "time"])
    return r.select("host", "dev", micros("time"), *[r6(F.col(c)).alias(c) for c in ("flops_gf", "bw_gb", "ai")])


@book("roofline_peaks", "f_js", "SELECT jid, f AS peak_flops, round(coalesce(b, 7), 6) AS peak_bw, round(f / coalesce(b, 7), 6) AS ridge FROM (SELECT jid, coalesce(max(value) FILTER (event = 'k0'), CASE min(type) WHEN 'click' THEN 100.0 END) AS f, nullif(coalesce(max(value) FILTER (event = 'k1'), 0) + coalesce(max(value) FILTER (event = 'k2'), 0), 0) AS b FROM f_js GROUP BY jid HAVING min(type) = 'click')")
def roofline_peaks(spark, sf):
    t = spark.createDataFrame([("click", 100.0, 7.0)], "type string, peak_flops double, peak_bw double")
    jobs, s = js(spark, sf)

    def finish(d):
        own = d.join(d.groupBy("jid").agg(F.min("type").alias("m")).where("m = 'click'"), "jid", "left_semi")
        return M.roofline_peaks(own, "k0", ["k1", "k2"], t)

    peaks = joins.over_jobs(jobs, joins.window_sums(jobs, s, {"value": (F.max("value"), F.max)}, ("type", "event")), finish)
    return peaks.select("jid", "peak_flops", r6(F.col("peak_bw")).alias("peak_bw"), r6(F.col("ridge")).alias("ridge"))


@book("counter_delta", "f_delta", "SELECT host, type, dev, event, epoch_us(time) AS time_us, round(delta, 4) AS delta FROM f_delta")
def counter_delta(spark, sf):
    return W.counter_delta(X.samples(spark, sf), 16, 512).select("host", "type", "dev", "event", micros("time"), F.round("delta", 4).alias("delta"))


@book("rate_arc", "f_delta", "SELECT host, type, dev, event, epoch_us(time) AS time_us, round(delta / ((epoch_us(time) - lag(epoch_us(time)) OVER (PARTITION BY host, type, dev, event ORDER BY time)) / 1e6), 3) AS arc FROM f_delta")
def rate_arc(spark, sf):
    return W.rate_arc(W.counter_delta(X.samples(spark, sf), 16, 512)).select("host", "type", "dev", "event", micros("time"), F.round("arc", 3).alias("arc"))


BUCKETS = "(SELECT jid, host, floor(epoch(time) / 86400) AS b, count(*) AS n FROM f_js GROUP BY 1, 2, 3)"


@book("drop_first_bucket", "f_js", f"SELECT jid, host, CAST(b AS BIGINT) AS b, n FROM (SELECT *, row_number() OVER (PARTITION BY jid, host ORDER BY b) AS r, count(*) OVER (PARTITION BY jid, host) AS c FROM {BUCKETS}) WHERE r > 1 OR c = 1")
def drop_first_bucket(spark, sf):
    jobs, s = js(spark, sf)
    b = joins.window_sums(jobs, s.withColumn("b", F.floor(F.unix_seconds("time") / 86400)), {"n": (F.count(F.lit(1)), F.sum)}, ("b",))
    return joins.to_jobs(jobs, W.drop_first_bucket(b, ["jid", "host"], "b"))


@book("downsample_ntile", "f_grid", "SELECT jid, tile, max(epoch_us(time)) AS time_us FROM (SELECT *, CAST(ntile(20) OVER (PARTITION BY jid ORDER BY time) AS INT) AS tile FROM (SELECT DISTINCT jid, time FROM f_grid)) GROUP BY 1, 2")
def downsample_ntile(spark, sf):
    return W.thinned_tiles(X.grid(spark, sf), 20).select("jid", "tile", micros("time"))


@book("downsample_stride", "f_grid", "SELECT jid, CAST(floor((epoch_us(time) - t0) / greatest((t1 - t0) / 31, 1)) AS BIGINT) AS stride, max(epoch_us(time)) AS time_us FROM f_grid JOIN (SELECT jid, min(epoch_us(time)) AS t0, max(epoch_us(time)) AS t1 FROM f_grid GROUP BY 1) USING (jid) GROUP BY 1, 2")
def downsample_stride(spark, sf):
    return W.thinned_stride(X.grid(spark, sf), 32).select("jid", "stride", micros("time"))


@book("downsample_budget", "f_js", "SELECT jid, rows, CAST(CASE WHEN rows > 20 OR nhosts * runtime / 60 > 1000000 THEN greatest(32, least(2048, floor(100 / nhosts))) END AS BIGINT) AS buckets FROM (SELECT jid, count(*) AS rows FROM f_js GROUP BY 1) JOIN f_job USING (jid)")
def downsample_budget(spark, sf):
    jobs, s = js(spark, sf)
    n = joins.totals(jobs, joins.window_sums(jobs, s, {"n": (F.count(F.lit(1)), F.sum)}), F.sum("n").alias("rows"), keep=("jid", "nhosts", "runtime"))
    return W.budget_of(n, max_rows=20, budget=100)


@book("downsample_kept", "f_js", """WITH b AS (SELECT jid, count(*) AS rows, any_value(f_job.nhosts) AS nhosts, any_value(runtime) AS runtime FROM f_js JOIN f_job USING (jid) GROUP BY jid), c AS (SELECT jid, CASE WHEN rows > 60 OR nhosts * runtime / 60 > 1000000 THEN greatest(5, least(2048, 60 // nhosts)) END AS n FROM (SELECT jid, rows, nhosts, runtime FROM b)),
  t AS (SELECT jid, list(DISTINCT epoch_us(time)) AS ts, any_value(n) AS n FROM f_js JOIN c USING (jid) GROUP BY jid), u AS (SELECT jid, list_sort(ts) AS ts, n, len(ts) AS m FROM t WHERE n IS NOT NULL),
  k AS (SELECT jid, ts[CASE WHEN b < m % n THEN (b + 1) * (m // n + 1) ELSE (b + 1) * (m // n) + m % n END] AS time_us FROM (SELECT *, unnest(range(0, least(n, m))) AS b FROM u))
  SELECT jid, time_us, count(*) AS n FROM (SELECT jid, epoch_us(time) AS time_us FROM f_js) WHERE jid IN (SELECT jid FROM c WHERE n IS NULL) OR (jid, time_us) IN (SELECT jid, time_us FROM k) GROUP BY 1, 2""")
def downsample_kept(spark, sf):
    return W.thinned_counts(X.jobs(spark, sf), X.samples(spark, sf), max_rows=60, budget=60, least=5).select("jid", micros("time"), "n")


@book("latest_per_key", "f_sample", "SELECT host, event, epoch_us(time) AS time_us, value FROM f_sample QUALIFY row_number() OVER (PARTITION BY host, event ORDER BY time DESC, type, dev) = 1")
def latest_per_key(spark, sf):
    return W.latest_per_key(X.samples(spark, sf), ["host", "event"], [F.desc("time"), F.col("type"), F.col("dev")]).select("host", "event", micros("time"), "value")


@book("cumulative_trapezoid", "f_grid", "SELECT jid, host, epoch_us(time) AS time_us, round(sum(coalesce(p, 0)) OVER (PARTITION BY jid, host ORDER BY time ROWS UNBOUNDED PRECEDING), 4) AS area FROM (SELECT *, (arc + lag(arc) OVER w) / 2 * (epoch(time) - lag(epoch(time)) OVER w) AS p FROM f_grid WHERE event = 'e0' WINDOW w AS (PARTITION BY jid, host ORDER BY time))")
def cumulative_trapezoid(spark, sf):
    g = X.grid(spark, sf).where("event = 'e0'").withColumn("sec", F.unix_seconds("time"))
    return W.cumulative_trapezoid(g, ["jid", "host"], "arc").select("jid", "host", micros("time"), F.round("area", 4).alias("area"))


@book("order_jobs", "f_job", "SELECT jid, row_number() OVER (ORDER BY node_hrs DESC NULLS LAST, jid) AS place FROM f_job QUALIFY place <= 50")
def order_jobs(spark, sf):
    from pyspark.sql import Window

    top = R.order_jobs(X.jobs(spark, sf), "-node_hrs").limit(50)
    return top.select("jid", F.row_number().over(Window.orderBy(F.desc("node_hrs"), "jid")).cast("long").alias("place"))


@book("page_jobs", "f_job", "SELECT jid FROM f_job ORDER BY end_time DESC, jid LIMIT 100 OFFSET 200")
def page_jobs(spark, sf):
    return R.page(X.jobs(spark, sf), "3").select("jid")


@book("keyset_jobs", "f_job", "SELECT jid FROM f_job WHERE end_time < TIMESTAMP '2024-01-20 05:00:00' OR (end_time = TIMESTAMP '2024-01-20 05:00:00' AND jid < '5') ORDER BY end_time DESC, jid DESC LIMIT 100")
def keyset_jobs(spark, sf):
    return R.after_key(X.jobs(spark, sf), 1705726800000000, "5").select("jid")


@book("top_capped", "f_job", "SELECT queue, username, count(*) OVER (PARTITION BY queue) > 10 AS truncated FROM (SELECT DISTINCT queue, username FROM f_job) QUALIFY row_number() OVER (PARTITION BY queue ORDER BY username) <= 10")
def top_capped(spark, sf):
    return A.top_capped(X.jobs(spark, sf), "queue", "username", 10)


@book("union_series", "f_sample", "SELECT 'a' AS part, host, count(*) AS n FROM f_sample WHERE type = 'view' GROUP BY host UNION ALL SELECT 'b', host, count(*) FROM f_sample WHERE type = 'click' GROUP BY host")
def union_series(spark, sf):
    part = lambda t: X.samples(spark, sf).where(F.col("type") == t).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return A.union_series({"a": part("view"), "b": part("click")})


@book("union_distinct_times", "f_wide", "SELECT DISTINCT epoch_us(time) AS time_us FROM f_wide")
def union_distinct_times(spark, sf):
    hosts = F.substring("host", 2, 9).cast("int") % 3
    return A.union_distinct_times([X.wide(spark, sf).where(hosts == i) for i in range(3)]).select(micros("time"))


@book("missing_set", "f_job f_sample", "SELECT DISTINCT jid FROM f_job WHERE queue = '5-LOW' EXCEPT SELECT CAST(l_orderkey AS STRING) FROM lineitem")
def missing_set(spark, sf):
    return A.missing_set(X.jobs(spark, sf).where("queue = '5-LOW'"), X.read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("jid")), "jid")


@book("common_set", "f_js", "SELECT jid, string_agg(DISTINCT event, ',' ORDER BY event) AS events FROM f_js WHERE event IN ('k0', 'k2') GROUP BY jid")
def common_set(spark, sf):
    jobs, s = js(spark, sf)
    wanted = ["k0", "k2", "k7"]
    own = joins.window_sums(jobs, s.where(F.col("event").isin(wanted)), {"n": (F.count(F.lit(1)), F.sum)}, ("event",))
    return joins.over_jobs(jobs, own, lambda d: A.common_set(d, "jid", "event", wanted)).select("jid", F.array_join("common", ",").alias("events"))


@book("feasible_type_events", "f_js", "SELECT jid, bool_or(type = 'error' AND event IN ('k1', 'k9')) AS ok FROM f_js GROUP BY jid")
def feasible_type_events(spark, sf):
    from ..operators.filters import has_events

    return schemas(spark, sf, has_events(F.col("schema"), "error", ["k1", "k9"]).alias("ok"))


@book("performance_rank", "f_metric", """WITH m AS (SELECT jid, count(*) AS rows, count(value) AS vals FROM f_metric WHERE type = 'error' GROUP BY jid), r AS (SELECT j.jid, CASE WHEN vals > 0 AND j.queue = '5-LOW' THEN 0 WHEN vals > 0 THEN 1 WHEN rows > 0 AND ncores / 16 >= 5 THEN 2 WHEN rows > 0 AND ncores / 16 >= 1 THEN 3 WHEN rows > 0 THEN 4 WHEN runtime < 7200 THEN 6 ELSE 6 END AS rank FROM f_job j LEFT JOIN m USING (jid))
  SELECT jid, rank, CASE WHEN rank BETWEEN 2 AND 4 THEN 2 ELSE rank END AS bucket FROM r""")
def performance_rank(spark, sf):
    j = X.jobs(spark, sf).withColumn("samples", F.col("ncores") / 16)
    return R.performance_rank(j, f_metric(spark, sf).where("type = 'error'"), j.where("queue = '5-LOW'"))


BOUNDS = "b AS (SELECT jid, min(time) AS f, max(time) AS l FROM f_js GROUP BY jid)"


@book("coverage_ready", "f_js", f"WITH {BOUNDS} SELECT j.jid, CAST(floor(epoch(f)) - epoch(start_time) AS BIGINT) AS lead, CAST(epoch(end_time) - floor(epoch(l)) AS BIGINT) AS lag, coalesce(lead <= 3600 AND lag <= 3600, false) AS ready FROM f_job j LEFT JOIN b USING (jid)")
def coverage_ready(spark, sf):
    jobs, s = js(spark, sf)
    ends = lambda d: d.groupBy("jid").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return R.coverage_of(joins.over_jobs(jobs, ends_of(jobs, s), ends, keep=("jid", "start_time", "end_time"), how="left"), 3600)


@book("post_end_ready", "f_jh f_sample", "SELECT jid, bool_and(coalesce(t > end_time, false)) AS ready FROM f_jh LEFT JOIN (SELECT host, max(time) AS t FROM f_sample WHERE type <> 'view' GROUP BY 1) ON host = h GROUP BY jid")
def post_end_ready(spark, sf):
    latest = X.samples(spark, sf).where("type <> 'view'").groupBy("host").agg(F.max("time").alias("last_time"))
    return R.post_end_ready(X.jobs(spark, sf), latest)


@book("listing_gates", "f_metric", """WITH f AS (SELECT jid, value, CASE WHEN no_data_reason IS NULL OR right(jid, 1) = '3' THEN NULL WHEN right(jid, 1) IN ('5', '6') THEN '' WHEN right(jid, 1) IN ('7', '8') THEN 'Insufficient Data For Metrics Processing' ELSE no_data_reason END AS why FROM f_metric),
  m AS (SELECT jid, count(*) AS rows, count(*) FILTER (value IS NULL AND (why IS NULL OR why = '')) AS stale, bool_or(coalesce(why, '') = 'Insufficient Data For Metrics Processing') AS gate FROM f GROUP BY jid)
  SELECT j.jid, coalesce(rows, 0) AS rows, coalesce(stale, 0) AS stale, coalesce(gate, false) AS gate FROM f_job j LEFT JOIN m USING (jid) WHERE coalesce(rows, 0) < 4 OR stale > 0 OR gate""")
def listing_gates(spark, sf):
    """Stored reasons of some jobs are blank or lost, those of others a failed gate."""
    end = F.substring("jid", -1, 1)
    why = F.when(end == "3", None).when(F.col("no_data_reason").isNotNull() & end.isin("5", "6"), "").when(F.col("no_data_reason").isNotNull() & end.isin("7", "8"), INSUFFICIENT).otherwise(F.col("no_data_reason"))
    jobs, d = js(spark, sf)
    parts, metrics = metrics_of(jobs, d)
    lacks = F.when(F.col("value").isNotNull(), 0.0).alias("value")
    alike = joins.over_jobs(jobs, parts, lambda d: metrics(d).groupBy("jid", lacks, "no_data_reason").agg(F.count(F.lit(1)).alias("n")))  # rows that the gates cannot tell apart
    return R.listing_gates(jobs, alike.withColumn("no_data_reason", why), 4, "n")


@book("needs_refresh", "f_js", "WITH a AS (SELECT jid, count(DISTINCT host || CAST(time AS STRING)) AS n FROM f_js GROUP BY 1), b AS (SELECT jid, count(DISTINCT host || CAST(time AS STRING)) AS n FROM f_js WHERE type <> 'error' GROUP BY 1) SELECT jid, a.n, coalesce(b.n, 0) AS had FROM a LEFT JOIN b USING (jid) WHERE a.n > coalesce(b.n, 0)")
def needs_refresh(spark, sf):
    j, d = X.jobs(spark, sf), X.samples(spark, sf)
    return R.needs_refresh(A.distinct_samples(j, d.where("type <> 'error'")), A.distinct_samples(j, d))


@book("period_keys", "f_job", "SELECT 'month' AS kind, strftime(m, '%Y-%m') AS period FROM (SELECT unnest(range(date_trunc('month', min(end_time))::TIMESTAMP, max(end_time) + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m FROM f_job) WHERE m <= (SELECT max(end_time) FROM f_job WHERE start_time >= submit_time) UNION ALL SELECT DISTINCT 'year', strftime(end_time, '%Y') FROM f_job")
def period_keys(spark, sf):
    return R.period_keys(X.jobs(spark, sf))


def _prints(spark, sf, least):
    j = X.jobs(spark, sf).where(F.col("nhosts") >= least)
    return j.groupBy(F.date_format("end_time", "yyyy-MM-dd").alias("period")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("jid")), ","), 256).alias("print"))


@book("refresh_stale", "f_job", """WITH a AS (SELECT strftime(end_time, '%Y-%m-%d') AS period, sha256(string_agg(jid, ',' ORDER BY jid)) AS p FROM f_job GROUP BY 1), b AS (SELECT strftime(end_time, '%Y-%m-%d') AS period, sha256(string_agg(jid, ',' ORDER BY jid)) AS p FROM f_job WHERE nhosts >= 2 GROUP BY 1)
  SELECT period, 'rebuild' AS action FROM a LEFT JOIN b USING (period) WHERE a.period < '2024-01-20' AND (b.p IS NULL OR a.p <> b.p) UNION ALL SELECT period, 'drop' FROM b WHERE period >= '2024-01-20'""")
def refresh_stale(spark, sf):
    return R.refresh_stale(_prints(spark, sf, 2).withColumn("flagged", F.lit(False)), _prints(spark, sf, 1).where("period < '2024-01-20'"))
