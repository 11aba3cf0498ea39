"""Queries on all metrics of jobs, over the grid of the driver's tables in the roles of monitor counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import catalog as K
from ..operators import gridpass as G
from ..operators import metrics as M
from ..operators import series as S
from . import fixtures as X
from .common import Book, lit, micros, simple_ctes, values

book = Book()

#: What the three events of the grid stand for: (type, event, event of the grid, factor, jobs by year: every, the one left over).
TELEMETRY = (
    [("host_ib", e, f"e{i % 2}", k, 3, 0) for i, (e, k) in enumerate((("port_xmit_data", 1e6), ("port_rcv_data", 2e6), ("port_xmit_pkts", 10.0), ("port_rcv_pkts", 7.0)))]
    + [("host_opa", e, f"e{i % 2}", k, 3, 1) for i, (e, k) in enumerate((("PortXmitData", 1e3), ("PortRcvData", 2e3), ("PortXmitPkts", 10.0), ("PortRcvPkts", 7.0)))] + [("host_opa", "PortXmitWait", "e2", 3.0, 3, 1)]
    + [("host_net", e, f"e{i % 3}", k, 1, 0) for i, (e, k) in enumerate((("rx_bytes", 1e6), ("tx_packets", 9.0), ("tx_bytes", 3e6), ("rx_packets", 5.0)))] + [("host_lnet", "tx_bytes", "e0", 1e5, 2, 0), ("host_lnet", "rx_bytes", "e2", 1e5, 2, 0)]
    + [("lustre_llite", e, f"e{i % 3}", 1.0 + i, 2, 0) for i, e in enumerate(G.LLITE_OPS)] + [("beegfs_client", e, f"e{i % 3}", 2.0 + i, 2, 1) for i, e in enumerate(G.BEEGFS_OPS)]
    + [("host_nfs", "read_ops", "e0", 1.0, 1, 0), ("host_nfs", "write_ops", "e1", 1.0, 1, 0), ("host_numa", "numa_miss", "e0", 1.0, 1, 0), ("host_numa", "other_node", "e2", 2.0, 1, 0)]
    + [("nvidia_gpu", "gpu_io_link_total_bytes", "e0", 1e9, 1, 0), ("nvidia_gpu", "tensor_active", "e1", 1e-3, 1, 0), ("nvidia_gpu", "gpu_util", "e2", 1e-3, 2, 0), ("nvidia_gpu", "utilization", "e0", 1e-3, 2, 1)]
    + [("nvidia_gpu", "power_usage", "e0", 1e-3, 2, 0), ("amd_gpu", "power_usage", "e1", 1e-3, 1, 0), ("amd_gpu", "clocks_event_reasons", "e1", 1e-2, 1, 0), ("nvidia_gpu", "module_power_usage", "e2", 1e-3, 3, 0)]
    + [("host_cpu", "user", "e0", 1.0, 1, 0), ("host_mem", "mem_used", "e0", 1e6, 1, 0), ("host_mem", "slab", "e1", 10.0, 1, 0), ("host_mem", "file_pages", "e2", 10.0, 1, 0)]
    + [("amd_x86_uncore_df_rome", "dram_chan0_bytes", "e0", 1.0, 3, 0), ("amd_x86_uncore_df_rome", "dram_chan1_bytes", "e1", 1.0, 3, 0), ("intel_x86_uncore_imc_skx", "dram_cas_reads", "e1", 1.0, 3, 1), ("intel_x86_uncore_imc_spr", "dram_cas_reads", "e2", 1.0, 1, 0)]
    + [("amd_x86_pmc", "aperf", "e0", 1.0, 3, 0), ("amd_x86_pmc", "mperf", "e1", 1.0, 3, 0), ("amd_x86_pmc", "fp_ops_retired", "e2", 1.0, 3, 0), ("intel_x86_pmc_gpr8", "aperf", "e1", 2.0, 3, 1), ("intel_x86_pmc_gpr8", "mperf", "e2", 1.0, 3, 1)]
    + [("intel_x86_pmc_gpr8", e, f"e{i % 3}", 1.0 + i, 3, 1) for i, e in enumerate(G.FP_DOUBLE + G.FP_SINGLE)] + [("intel_x86_pmc_gpr4", e, f"e{i % 2}", 1.0 + i, 3, 2) for i, (e, _) in enumerate(G.SSE)]
    + [("lustre_llite", "vfs_read_bytes", "e0", 1e6, 2, 0), ("beegfs_client", "vfs_write_bytes", "e1", 1e6, 2, 1), ("nvidia_gpu", "gpu_count", "e0", 1e-4, 1, 0)]
    + [("intel_x86_rapl", "pkg_energy", "e1", 1e6, 3, 1), ("amd_x86_rapl", "pkg_energy", "e0", 1e6, 3, 0), ("host_cpu_hw", "dcgm_cpu_power_util_w", "e2", 1e-3, 3, 2)]
)
def telemetry_sql(roles):
    return f"roles(type, event, e, k, every, rest) AS (VALUES {values(roles)}), t AS (SELECT jid, host, time, type, roles.event, value * k AS value, arc * k AS arc FROM f_grid JOIN roles ON f_grid.event = e WHERE CAST(jid[2:] AS INT) % every = rest)"


TELEMETRY_SQL = telemetry_sql(TELEMETRY)


def telemetry(spark, sf, roles=TELEMETRY):
    roles = spark.createDataFrame(roles, "type string, event string, e string, k double, every int, rest int")
    g = X.grid(spark, sf).withColumnRenamed("event", "e").join(F.broadcast(roles), "e").where(F.substring("jid", 2, 4).cast("int") % F.col("every") == F.col("rest"))
    return g.select("jid", "host", "time", "type", "event", (F.col("value") * F.col("k")).alias("value"), (F.col("arc") * F.col("k")).alias("arc"))


_pmc = ", ".join(f"('{t}', {i})" for i, t in enumerate(G.PMC))
_imc = ", ".join(f"('{t}', {i})" for i, t in enumerate(G.IMC))
_case = lambda what, kv, other="NULL": f"CASE {' '.join(f'WHEN {k} THEN {lit(v)}' for k, v in kv)} ELSE {other} END" if what is None else f"CASE {what} {' '.join(f'WHEN {lit(k)} THEN {lit(v)}' for k, v in kv)} ELSE {other} END"
COMPLEX_CTES = f"""  src(grp, attempt, type, every, factor, event, part, weight) AS (VALUES {values([(s.group, s.attempt, s.type, s.every, s.factor, e, p, w) for s in G.SOURCES for e, p, w in s.terms])}),
  have AS (SELECT DISTINCT jid, type, event FROM t), pmc(type, r) AS (VALUES {_pmc}), imc(type, r) AS (VALUES {_imc}),
  first_pmc AS (SELECT jid, arg_min(type, r) AS type FROM have JOIN pmc USING (type) GROUP BY jid), first_imc AS (SELECT jid, arg_min(type, r) AS type FROM have JOIN imc USING (type) GROUP BY jid),
  fit AS (SELECT jid, grp, attempt, type, count(*) AS found, any_value(every) AS every, any_value(factor) AS factor FROM src JOIN have USING (type, event) GROUP BY jid, grp, attempt, type),
  ok AS (SELECT fit.* FROM fit JOIN (SELECT grp, attempt, count(*) AS terms FROM src GROUP BY 1, 2) USING (grp, attempt) LEFT JOIN first_pmc p USING (jid) LEFT JOIN first_imc i ON i.jid = fit.jid
    WHERE (NOT every OR found = terms) AND (grp NOT IN ('clock', 'vector64', 'vector32', 'flops') OR fit.type = p.type) AND (grp <> 'dram' OR fit.type NOT LIKE '%imc%' OR fit.type = i.type)),
  pick AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY jid, grp ORDER BY attempt) = 1),
  ax AS (SELECT jid, time, lag(time) OVER (PARTITION BY jid ORDER BY time) AS before, min(time) OVER (PARTITION BY jid) AS t0, max(time) OVER (PARTITION BY jid) AS t1 FROM (SELECT DISTINCT jid, time FROM t)),
  x AS (SELECT t.*, grp, pick.attempt, found, pick.factor, part, weight FROM t JOIN src USING (type, event) JOIN pick USING (jid, grp, attempt, type)),
  hs AS (SELECT jid, grp, attempt, type, factor, host, time, coalesce(sum(value * weight) FILTER (part = 0), 0) AS p0, coalesce(sum(value * weight) FILTER (part = 1), 0) AS p1, coalesce(sum(value * weight) FILTER (part = 2), 0) AS p2 FROM x GROUP BY jid, grp, attempt, type, factor, host, time, found HAVING count(*) = found),
  cs AS (SELECT jid, grp, attempt, type, factor, '' AS host, time, sum(v) AS p0, sum(a) AS arc FROM (SELECT jid, grp, attempt, type, factor, found, time, event, avg(value) * weight AS v, avg(arc) * weight AS a FROM x WHERE part = 0 GROUP BY jid, grp, attempt, type, factor, found, time, event, weight) GROUP BY jid, grp, attempt, type, factor, time, found HAVING count(*) = found),
  hr AS (SELECT a.*, ax.before, ax.t0, ax.t1, (a.p0 - b.p0) / (epoch(a.time) - epoch(b.time)) AS rate FROM hs a JOIN ax ON ax.jid = a.jid AND ax.time = a.time LEFT JOIN hs b ON b.jid = a.jid AND b.grp = a.grp AND b.host = a.host AND b.time = ax.before),
  cr AS (SELECT a.*, (a.p0 - b.p0) / (epoch(a.time) - epoch(b.time)) AS rate FROM cs a JOIN ax ON ax.jid = a.jid AND ax.time = a.time LEFT JOIN cs b ON b.jid = a.jid AND b.grp = a.grp AND b.time = ax.before),
  lim(grp, most) AS (VALUES ('fabric', 1e300), ('packets', 1e10), ('lnet', 1e300), ('llite', 1e300), ('nfs', 1e300), ('beegfs', 1e300), ('opa', 1e300), ('numa', 1e300), ('link', 1e5)),
  pk AS (SELECT jid, grp, type, coalesce(m, r) AS m, h FROM (SELECT jid, grp, type, max(arc * factor) FILTER (arc > 0 AND arc * factor <= most) AS m, max(rate * factor) FILTER (rate > 0 AND rate * factor <= most) AS r FROM cr JOIN lim USING (grp) GROUP BY 1, 2, 3)
    FULL JOIN (SELECT jid, grp, type, max(rate * factor) FILTER (rate > 0 AND rate * factor <= most) AS h FROM hr JOIN lim USING (grp) GROUP BY 1, 2, 3) USING (jid, grp, type)),
  mds AS (SELECT jid, max(m) FILTER (grp = 'llite') AS lm, max(h) FILTER (grp = 'llite') AS lh, max(m) FILTER (grp = 'nfs') AS nm, max(h) FILTER (grp = 'nfs') AS nh, max(m) FILTER (grp = 'beegfs') AS bm, max(h) FILTER (grp = 'beegfs') AS bh FROM pk GROUP BY jid),
  im AS (SELECT jid, grp, type, host, avg((m - x) / m) AS s FROM (SELECT *, max(x) OVER (PARTITION BY jid, grp, time) AS m FROM (SELECT jid, grp, type, host, time, CASE WHEN grp IN ('util', 'tensor') THEN p0 ELSE rate END AS x FROM hr WHERE grp IN ('flops', 'dram', 'lnet', 'cpu', 'util', 'tensor') OR (grp = 'fabric' AND attempt < 2))) WHERE m > 0 AND x IS NOT NULL GROUP BY 1, 2, 3, 4),
  ib AS (SELECT pick.jid, pick.grp, pick.type, coalesce(100 * max(s), 0) AS value FROM pick LEFT JOIN im USING (jid, grp) WHERE pick.grp IN ('flops', 'dram', 'lnet', 'cpu', 'util', 'tensor') OR (pick.grp = 'fabric' AND pick.attempt < 2) GROUP BY 1, 2, 3),
  q AS (SELECT jid, host, (epoch(ax.time) + epoch(ax.before)) / 2 AS mid, greatest(coalesce(rate, 0), 0) AS rate FROM ax JOIN (SELECT DISTINCT jid, host FROM hr WHERE grp = 'cpu') USING (jid) LEFT JOIN (SELECT jid, host, time, rate FROM hr WHERE grp = 'cpu') USING (jid, host, time) WHERE ax.before IS NOT NULL),
  tm AS (SELECT *, coalesce((rate + lag(rate) OVER w) / 2 * (mid - lag(mid) OVER w), 0) AS seg, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY jid, host) AS n FROM q WINDOW w AS (PARTITION BY jid, host ORDER BY mid)),
  tc AS (SELECT *, sum(seg) OVER (PARTITION BY jid, host ORDER BY mid ROWS UNBOUNDED PRECEDING) AS cum, sum(seg) OVER (PARTITION BY jid, host) AS total, min(mid) OVER (PARTITION BY jid, host) AS m0, max(mid) OVER (PARTITION BY jid, host) AS m1 FROM tm),
  td AS (SELECT *, lag(cum) OVER (PARTITION BY jid, host ORDER BY mid) AS earlier FROM tc),
  ti AS (SELECT jid, 100 * min(r) AS value FROM (SELECT jid, CASE WHEN earlier > 0 THEN ((total - cum) / (m1 - mid)) / (earlier / (mid - m0)) END AS r FROM td WHERE n >= 4 AND i >= 2 AND i <= n - 2) WHERE r >= 0 AND r <= 1e9 GROUP BY jid),
  g AS (SELECT a.jid, a.grp, a.type, a.factor, b.p0 - a.p0 AS d0, b.p1 - a.p1 AS d1, b.p2 - a.p2 AS d2, epoch(a.t1) - epoch(a.t0) AS dt FROM hr a JOIN hr b USING (jid, grp, host) WHERE a.time = a.t0 AND b.time = b.t1 AND a.t0 < a.t1),
  nd AS (SELECT jid, grp, type, nullif(avg(CASE WHEN d0 >= 0 THEN d0 * factor / dt END), 0) AS eth, avg(d0 * factor / nullif(d1, 0)) AS size, avg(2.7::DOUBLE * d0 / nullif(d1, 0)) AS clock, avg((d0 + d1) / nullif(d1 + d2, 0)) AS width, 100 * sum(d0) / nullif(sum(d0 + d1), 0) AS pct FROM g GROUP BY 1, 2, 3),
  gp AS (SELECT jid, event, type, max(CASE event WHEN 'power_usage' THEN value ELSE floor(value) END) AS v, CASE type WHEN 'nvidia_gpu' THEN 0 WHEN 'amd_gpu' THEN 1 ELSE 2 END AS r FROM t WHERE event IN ('power_usage', 'clocks_event_reasons') AND type LIKE '%gpu' AND value < 140737488355328 GROUP BY 1, 2, 3 HAVING v > 0),
  pw AS (SELECT jid, host, time, cpu, CASE WHEN m > 0 THEN m ELSE coalesce(cpu, 0) + coalesce(gpu, 0) END AS w FROM (SELECT jid, host, time, sum(value) FILTER (event = 'module_power_usage') AS m, sum(value) FILTER (type = 'nvidia_gpu' AND event = 'power_usage') AS gpu, coalesce(sum(value) FILTER (event = 'dcgm_cpu_power_util_w'), sum(arc * 0.00001526::DOUBLE) FILTER (type = 'intel_x86_rapl'), sum(arc * 0.00001526::DOUBLE) FILTER (type = 'amd_x86_rapl')) AS cpu FROM t GROUP BY 1, 2, 3) WHERE m > 0 OR cpu IS NOT NULL OR gpu IS NOT NULL),
  wh AS (SELECT jid, sum(e) AS e, sum(n) AS n FROM (SELECT jid, host, sum(e) AS e, count(cpu) AS n FROM (SELECT *, (w + lag(w) OVER o) / 2 * (epoch(time) - lag(epoch(time)) OVER o) / 3600 AS e FROM pw WINDOW o AS (PARTITION BY jid, host ORDER BY time)) GROUP BY 1, 2) WHERE e >= 0 GROUP BY jid),
  complex AS (SELECT jid, type, {_case("grp", [("packets", "max_packetrate"), ("lnet", "max_lnetbw"), ("opa", "max_opa_congestion_rate"), ("numa", "max_numa_remote_rate"), ("link", "max_gpu_link_gbps")])} AS metric, coalesce(m, h) AS value FROM pk WHERE grp IN ('packets', 'lnet', 'opa', 'numa', 'link')
    UNION ALL SELECT jid, type, 'max_fabricbw', coalesce(m, h) FROM pk WHERE grp = 'fabric' AND coalesce(m, h) <= 1e6
    UNION ALL SELECT jid, CASE WHEN lm IS NULL AND (bm IS NOT NULL OR bh > coalesce(greatest(lh, nm, nh), 0)) THEN 'beegfs_client' ELSE 'lustre_llite' END, 'max_mds', coalesce(lm, greatest(lh, nm, nh, bm, bh)) FROM mds
    UNION ALL SELECT jid, type, {_case("grp", list(G.IMBALANCES.items()))}, value FROM ib UNION ALL SELECT jid, 'host_cpu', 'time_imbalance', value FROM ti
    UNION ALL SELECT jid, type, 'avg_ethbw', eth FROM nd WHERE grp = 'ethernet' UNION ALL SELECT jid, type, 'avg_packetsize', size FROM nd WHERE grp = 'size' UNION ALL SELECT jid, type, 'avg_freq', clock FROM nd WHERE grp = 'clock'
    UNION ALL SELECT jid, type, 'avg_vector_width_' || grp[7:] || 'b', width FROM nd WHERE grp LIKE 'vector%' UNION ALL SELECT jid, type, 'vecpercent_' || grp[7:] || 'b', pct FROM nd WHERE grp LIKE 'vector%'
    UNION ALL SELECT jid, arg_min(type, r), CASE event WHEN 'power_usage' THEN 'max_gpu_power' ELSE 'max_gpu_clock_event_reasons' END, arg_min(v, r) FROM gp GROUP BY jid, event
    UNION ALL SELECT jid, 'host_mem', 'mem_hwm', max(p0) / 1048576 FROM hs WHERE grp = 'memory' GROUP BY jid HAVING max(p0) > 0
    UNION ALL SELECT jid, 'job', 'max_node_power_est_w', max(w) FROM pw GROUP BY jid UNION ALL SELECT jid, 'job', 'avg_node_power_est_w', avg(w) FROM pw GROUP BY jid UNION ALL SELECT jid, 'job', 'job_cpu_gpu_watt_hours', e FROM wh WHERE n > 0)"""


@book("metric_complex", "f_grid", f"""WITH {TELEMETRY_SQL}, {COMPLEX_CTES}, units(metric, units) AS (VALUES {values((k, u) for k, (_, u) in G.COMPLEX.items())})
  SELECT jid, type, metric, units, value FROM complex JOIN units USING (metric) WHERE value IS NOT NULL""")
def metric_complex(spark, sf):
    return G.complex_metrics(telemetry(spark, sf))


#: Jobs: one a year; the first two and the last have windows that their samples do not reach (none, or too few).
JOBS_SQL = "job AS (SELECT 'j' || CAST(y AS STRING) AS jid, make_timestamp(y, 1, 1, 0, 0, 0) AS start_time, make_timestamp(y, 12, 31, 0, 0, 0) AS end_time FROM (SELECT unnest(range((SELECT CAST(min(year(l_shipdate)) AS BIGINT) - 1 FROM lineitem), (SELECT CAST(max(year(l_shipdate)) AS BIGINT) + 2 FROM lineitem))) AS y))"


def yearly_jobs(spark, sf):
    y = X.read(spark, sf, "lineitem").agg(F.min(F.year("l_shipdate")).alias("a"), F.max(F.year("l_shipdate")).alias("b")).select(F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("y"))
    return y.select(F.concat(F.lit("j"), "y").alias("jid"), F.make_date("y", F.lit(1), F.lit(1)).cast("timestamp").alias("start_time"), F.make_date("y", F.lit(12), F.lit(31)).cast("timestamp").alias("end_time"))


def fsio_sql() -> str:
    case = lambda i: "CASE type " + " ".join(f"WHEN {lit(v[0])} THEN event IN ({', '.join(map(lit, v[i]))})" for v in K.FILE_SYSTEMS.values()) + " ELSE false END"
    return f"""fs(fs, type, absent, no_bytes, no_ops) AS (VALUES {values((f, v[0], *v[4:]) for f, v in K.FILE_SYSTEMS.items())}),
  ft AS (SELECT jid, type, time, sum(arc * 2) FILTER ({case(1)}) AS r, sum(arc * 2) FILTER ({case(2)}) AS w, count(*) FILTER ({case(1)} OR {case(2)}) AS n, sum(arc) FILTER ({case(1)} OR {case(2)}) AS b, sum(arc) FILTER ({case(3)}) AS o FROM t GROUP BY 1, 2, 3),
  fa AS (SELECT jid, type, coalesce(sum(r), 0) / 1048576 AS r, coalesce(sum(w), 0) / 1048576 AS w, max(b) / 1048576 AS b, max(o) AS o FROM ft GROUP BY 1, 2 HAVING sum(n) > 0),
  fj AS (SELECT job.jid, fs.*, fa.jid IS NULL AS gone, r, w, b, o FROM job CROSS JOIN fs LEFT JOIN fa ON fa.jid = job.jid AND fa.type = fs.type),
  fsio AS ({" UNION ALL ".join(f"SELECT jid, fs AS type, 'detail_fsio_' || fs || '_{k}' AS metric, '{u}' AS units, {c}::DOUBLE AS value, CASE WHEN gone THEN absent WHEN {c} IS NULL THEN {'no_ops' if k == 'peak_iops' else 'no_bytes'} END AS no_data_reason FROM fj" for (k, u), c in zip(K.FILE_ROWS, "rwbo"))})"""


@book("fsio_rows", "f_grid", f"WITH {TELEMETRY_SQL}, {JOBS_SQL}, {fsio_sql()} SELECT jid, type, metric, units, value, no_data_reason FROM fsio")
def fsio_rows(spark, sf):
    return A.fsio_rows(telemetry(spark, sf).withColumn("delta", F.col("arc") * 2), yearly_jobs(spark, sf))


def all_metrics(spark, sf):
    """The first four jobs of all are not yet computed."""
    j = yearly_jobs(spark, sf)
    d = telemetry(spark, sf).withColumns({"dev": F.lit("0"), "delta": F.col("arc") * 2, "ncores": F.lit(64), "nhosts": F.lit(4)})
    return G.job_metrics(j, d, j.where("jid >= 'j1993'"), margin=20 * 86400, seconds=7 * 86400)


_util = "SELECT jid, host, event, count(value) AS cnt, max(value) AS vmax, avg(value) AS vmean FROM t WHERE type = 'nvidia_gpu' AND event IN ('gpu_util', 'utilization') GROUP BY 1, 2, 3"
FILLED_SQL = f"""WITH {TELEMETRY_SQL}, {JOBS_SQL}, s AS (SELECT *, 64 AS ncores, 4 AS nhosts FROM t), {simple_ctes(604800)}, {COMPLEX_CTES}, {fsio_sql()},
  gu AS (SELECT jid, CAST(count(*) FILTER (vmax > 0) AS DOUBLE) AS active, sum(vmax) AS vmax, sum(vmean) AS vmean FROM (SELECT *, row_number() OVER (PARTITION BY jid, host ORDER BY event) AS r FROM ({_util})) WHERE r = 1 AND cnt > 2 GROUP BY jid),
  gc AS (SELECT jid, CAST(round(sum(m)) AS DOUBLE) AS n FROM (SELECT jid, host, max(value) AS m FROM t WHERE event = 'gpu_count' GROUP BY 1, 2) GROUP BY jid HAVING n > 0),
  val AS (SELECT jid, type, metric, value, NULL AS why FROM simple UNION ALL SELECT jid, type, metric, value, NULL FROM complex UNION ALL SELECT jid, 'gpu', 'detail_gpu_active', active, NULL FROM gu UNION ALL SELECT jid, 'gpu', 'detail_gpu_util_max', vmax, NULL FROM gu
    UNION ALL SELECT jid, 'gpu', 'detail_gpu_util_mean', vmean, NULL FROM gu UNION ALL SELECT jid, 'gpu', 'avg_gpuutil', vmean, NULL FROM gu UNION ALL SELECT jid, 'gpu', 'detail_gpu_count', n, NULL FROM gc UNION ALL SELECT jid, type, metric, value, no_data_reason FROM fsio),
  cat(metric, ctype, units, reason, series, ord) AS (VALUES {values((*r, i) for i, r in enumerate(K.ROWS))}), bd AS (SELECT jid, min(time) AS f, max(time) AS l FROM t GROUP BY jid),
  state AS (SELECT job.jid, CASE WHEN job.jid < 'j1993' THEN 'open' WHEN f IS NULL THEN 'none' WHEN epoch(f) - epoch(start_time) > 1728000 OR epoch(end_time) - epoch(l) > 1728000 THEN 'gate' ELSE 'done' END AS state FROM job LEFT JOIN bd USING (jid)),
  filled AS (SELECT jid, CASE WHEN v IS NOT NULL THEN type ELSE ctype END AS type, metric, units, v AS value, CASE WHEN v IS NOT NULL THEN NULL WHEN state = 'open' THEN 'Metric not computed' WHEN state = 'gate' THEN 'Insufficient Data For Metrics Processing' WHEN state = 'none' AND series THEN 'No time-series telemetry for this job' ELSE coalesce(why, reason) END AS no_data_reason, ord
    FROM (SELECT state.jid, cat.*, val.type, CASE WHEN state IN ('done', 'none') THEN val.value END AS v, val.why, state FROM state CROSS JOIN cat LEFT JOIN val ON val.jid = state.jid AND val.metric = cat.metric))"""


@book("metric_catalog_fill", "f_grid", FILLED_SQL + " SELECT jid, type, metric, units, value, no_data_reason FROM filled")
def metric_catalog_fill(spark, sf):
    return all_metrics(spark, sf).drop("ord")


@book("metric_display", "f_grid", FILLED_SQL + """ SELECT jid, metric, ord, CASE WHEN value IS NOT NULL THEN 0 WHEN no_data_reason <> 'Metric not computed' THEN 1 ELSE 2 END AS tier FROM filled
  WHERE NOT (metric = 'avg_gpuutil' AND value IS NOT NULL)""")
def metric_display(spark, sf):
    return M.display_order(all_metrics(spark, sf)).select("jid", "metric", "ord", "tier")


#: Errors, GPU work and reported peaks.
MORE = [
    ("host_ib", "symbol_error", "e0", 1.0, 1, 0), ("host_ib", "link_downed", "e1", 0.0, 1, 0), ("host_net", "rx_errors", "e2", 1.0, 2, 0), ("host_net", "rx_bytes", "e1", 1.0, 1, 0),
    ("nvidia_gpu", "gpu_flops_rate", "e0", 1e9, 1, 0), ("nvidia_gpu", "gpu_mem_bw_bytes_rate", "e1", 1e9, 2, 0), ("nvidia_gpu", "gpu_io_link_total_bytes", "e2", 1e9, 1, 0),
    ("host_roofline_peak", "cpu_peak_fp64_flops_per_s", "e0", 1e9, 3, 0), ("host_roofline_peak", "cpu_peak_dram_bw_bytes_per_s", "e1", 1e6, 3, 0), ("host_roofline_peak", "cpu_peak_hbm_bw_bytes_per_s", "e2", 1e6, 3, 0),
    ("host_roofline_peak", "gpu_peak_fp64_flops_per_s", "e0", 1e9, 2, 0), ("host_roofline_peak", "gpu_peak_mem_bw_bytes_per_s", "e1", 1e6, 2, 0), ("host_roofline_peak", "gpu_peak_io_link_bw_bytes_per_s", "e2", 1e6, 4, 0),
    ("intel_x86_uncore_imc_skx", "dram_cas_reads", "e1", 1.0, 3, 1), ("amd_x86_uncore_df_rome", "dram_chan0_bytes", "e0", 1.0, 3, 2), ("amd_x86_pmc", "fp_ops_retired", "e0", 1.0, 3, 2),
]
MORE_SQL = telemetry_sql(MORE)


@book("hardware_errors", "f_grid", f"WITH {MORE_SQL} SELECT jid, host, epoch_us(time) AS time_us, type, event, arc AS rate FROM t WHERE event IN ('symbol_error', 'link_downed', 'rx_errors') AND (jid, event) IN (SELECT (jid, event) FROM t WHERE arc <> 0)")
def hardware_errors(spark, sf):
    return S.hardware_errors(telemetry(spark, sf, MORE)).select("jid", "host", micros("time"), "type", "event", "rate")


@book("device_roofline", "f_grid", f"""WITH {MORE_SQL}, w AS (SELECT jid, host, time, sum(value) FILTER (event = 'gpu_flops_rate') * 1e-9::DOUBLE AS f, sum(value) FILTER (event = 'gpu_mem_bw_bytes_rate') / 1073741824 AS m, sum(arc) FILTER (event = 'gpu_io_link_total_bytes') / 1073741824 AS l FROM t WHERE type = 'nvidia_gpu' GROUP BY 1, 2, 3),
  c AS (SELECT jid, count(*) FILTER (f IS NOT NULL AND m > 0) > 0 AS mem FROM w GROUP BY jid), p AS (SELECT jid, host, time, f, CASE WHEN mem THEN m ELSE l END AS b, CASE WHEN mem THEN 'memory_bw' ELSE 'pcie_nvlink' END AS axis FROM w JOIN c USING (jid))
  SELECT jid, host, epoch_us(time) AS time_us, f AS flops_gf, b AS bw_gb, f / b AS ai, axis FROM p WHERE f > 0 AND f / nullif(b, 0) > 0""")
def device_roofline(spark, sf):
    return S.device_roofline(telemetry(spark, sf, MORE).withColumn("dev", F.lit("0"))).select("jid", "host", micros("time"), "flops_gf", "bw_gb", "ai", "axis")


@book("job_peaks", "f_grid", f"""WITH {MORE_SQL}, o AS (SELECT jid, max(value) FILTER (event = 'cpu_peak_fp64_flops_per_s') * 1e-9::DOUBLE AS f, greatest(coalesce(max(value) FILTER (event = 'cpu_peak_dram_bw_bytes_per_s') / 1073741824, 0), 0) + greatest(coalesce(max(value) FILTER (event = 'cpu_peak_hbm_bw_bytes_per_s') / 1073741824, 0), 0) AS b,
    bool_or(type = 'intel_x86_uncore_imc_skx') AS skx, bool_or(type = 'amd_x86_uncore_df_rome') AS amd FROM t GROUP BY jid),
  p AS (SELECT jid, CASE WHEN f > 0 AND b > 0 THEN f WHEN skx THEN 6400 WHEN amd THEN 4000 END::DOUBLE AS peak_flops, CASE WHEN f > 0 AND b > 0 THEN b WHEN skx THEN 460 WHEN amd THEN 410 END::DOUBLE AS peak_bw FROM o) SELECT *, peak_flops / peak_bw AS ridge FROM p WHERE peak_flops IS NOT NULL""")
def job_peaks(spark, sf):
    return S.job_peaks(telemetry(spark, sf, MORE))


@book("device_peaks", "f_grid", f"""WITH {MORE_SQL}, o AS (SELECT jid, max(value) FILTER (event = 'gpu_peak_fp64_flops_per_s') * 1e-9::DOUBLE AS peak_flops, coalesce(max(value) FILTER (event = 'gpu_peak_io_link_bw_bytes_per_s'), max(value) FILTER (event = 'gpu_peak_mem_bw_bytes_per_s')) / 1073741824 AS peak_bw FROM t GROUP BY jid)
  SELECT *, peak_flops / peak_bw AS ridge FROM o WHERE peak_flops > 0 AND peak_bw > 0""")
def device_peaks(spark, sf):
    return S.device_peaks(telemetry(spark, sf, MORE))
