"""Metrics on a job's grid of hosts and times, series and rooflines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import cores_of, cpu_use
from .catalog import BLANK, BYTES_GB, BYTES_MB, CPU_BUSY, CPU_IDLE, CPU_TYPE, INSUFFICIENT, NO_SAMPLES, NO_SERIES, NOT_COMPUTED, ROWS, SIMPLE, SIMPLE_PARTS
from .joins import over_jobs, totals
from .windows import drop_first_bucket


def simple_metrics(df: DataFrame, parts=SIMPLE_PARTS, seconds: int = 300, job: DataFrame | None = None) -> DataFrame:
    """(jid, type, metric, units, value) of all simple metrics that the samples of jobs allow.

    With ``job``, ``df`` holds the samples of the windows of its hosts (``window_samples``), and
    the means of a host are made once for each window.

    The short table of parts is joined to the samples once and one grouping makes the sums of
    all metrics: per sample, then bucket means, first bucket dropped, means of a host and of
    the job.  The terms of a try are summed and the first try with a value is taken.
    """
    spark, keys = df.sparkSession, {}
    for x in parts:  # a part's number, odd for a gauge, is all that the groupings carry
        keys.setdefault((x.metric, x.attempt, x.part, x.type, x.positive), 2 * len(keys) + x.gauge)
    rows = [(keys[x.metric, x.attempt, x.part, x.type, x.positive], x.type, x.event, x.factor, x.nonnegative, x.most) for x in parts]
    spec = spark.createDataFrame(rows, "p int, type string, event string, factor double, nonnegative boolean, most double")
    named = spark.createDataFrame([(p, *k) for k, p in keys.items()], "p int, metric string, attempt int, part int, type string, positive boolean")
    gauge, v, a = F.col("p") % 2 == 1, F.col("value") * F.col("factor"), F.col("arc") * F.col("factor")
    sane = (F.col("value") < BLANK) & F.coalesce(v <= F.col("most"), F.lit(True))
    own = F.when(gauge, F.when(sane, v)).when(F.col("nonnegative") & (F.col("arc") < 0), None).otherwise(a)
    d = df.join(F.broadcast(spec), ["type", "event"]).select("jid", "host", "time", "p", own.alias("v"))
    d = d.groupBy("jid", "host", "p", "time").agg(F.sum("v").alias("v"), F.count("v").alias("n"))
    n = F.when(gauge, F.col("n")).otherwise(1)
    d = d.where(n > 0).groupBy("jid", "host", "p", F.floor(F.unix_seconds("time") / seconds).alias("bucket")).agg((F.sum(F.coalesce("v", F.lit(0.0))) / F.sum(n)).alias("v"))
    d = drop_first_bucket(d, ["jid", "host", "p"], "bucket").groupBy("jid", "host", "p").agg(F.avg("v").alias("v"))
    use = lambda keep: cpu_use(df, CPU_TYPE, list(CPU_BUSY), list(CPU_IDLE), "arc", seconds, keep)
    if job is None:
        rows, cpu = _of_hosts(d, named), use(("ncores", "nhosts"))
    else:
        rows = over_jobs(job, d.drop("host"), lambda d: _of_hosts(d, named))
        cpu = totals(job, use(()), F.sum("plain").alias("plain"), F.sum("share").alias("share"), keep=("jid", "ncores", "nhosts"))
    cpu = cores_of(cpu).select("jid", F.lit(CPU_TYPE).alias("type"), F.lit("avg_cpuusage").alias("metric"), "value")
    units = F.create_map(*[F.lit(x) for m, (_, u) in SIMPLE.items() for x in (m, u)])
    return rows.unionByName(cpu).where("value is not null").select("jid", "type", "metric", units[F.col("metric")].alias("units"), "value")


def _of_hosts(d: DataFrame, named: DataFrame) -> DataFrame:
    """Metrics of a job, the two ratios included, from the means ``v`` of the parts ``p`` on its hosts."""
    d = d.groupBy("jid", "p").agg(F.avg("v").alias("v")).join(F.broadcast(named), "p")
    d = d.groupBy("jid", "metric", "attempt", "positive").agg(F.sum("v").alias("value"), F.min_by("type", "part").alias("type")).where("value is not null and (value > 0 or not positive)")
    d = d.groupBy("jid", "metric").agg(F.min_by(F.struct("type", "value"), "attempt").alias("r")).select("jid", "r.type", "metric", "r.value")
    pick = lambda m, c="value": F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = d.where(F.col("metric").isin("avg_ibbw", "avg_flops", "avg_tensor_active")).groupBy("jid").agg(pick("avg_ibbw").alias("b"), pick("avg_ibbw", "type").alias("type"), pick("avg_flops").alias("f"), pick("avg_tensor_active").alias("t"))
    fits = lambda c, least: F.when((F.col(c) > least) & (F.col("b") >= 0), F.col("b"))
    ratios = [("avg_fabric_mb_per_gflops", fits("f", 0.0) / F.col("f")), ("avg_fabric_mb_per_avg_tensor", fits("t", 1e-6) / (F.col("t") / 100))]
    return reduce(DataFrame.unionByName, [d, *[wide.select("jid", "type", F.lit(m).alias("metric"), r.alias("value")) for m, r in ratios]])


def grid_densify(df: DataFrame, events: list[str]) -> DataFrame:
    """Every (job, host, time of the job, event), missing cells NULL; filtered to ``events`` first."""
    d = df.where(F.col("event").isin(events)).groupBy("jid", "host", "time", "event").agg(F.sum("value").alias("value"))
    times, hosts = d.select("jid", "time").distinct(), d.select("jid", "host", "event").distinct()
    return times.join(hosts, "jid").join(d, ["jid", "host", "time", "event"], "left")


def interval_rate(grid: DataFrame, keys=("jid", "host", "event")) -> DataFrame:
    """``rate`` between neighbouring times of the grid; NULL if an end is missing."""
    w = Window.partitionBy(*keys).orderBy("time")
    dt = F.unix_seconds("time") - F.lag(F.unix_seconds("time")).over(w)
    return grid.withColumns({"rate": F.when(dt > 0, (F.col("value") - F.lag("value").over(w)) / dt), "mid": F.unix_seconds("time") - dt / 2})


def peak_rate(df: DataFrame, events: list[str], conv: float, most: float) -> DataFrame:
    """Highest over time of the host-mean rate summed over events; else of the rate of the host-mean value; else of one host."""
    own = df.where(F.col("event").isin(events))
    good = lambda c: F.max(F.when((c > 0) & (c <= most), c))
    n = len(events)
    t = own.groupBy("jid", "time", "event").agg(F.avg("arc").alias("a"), F.avg("value").alias("v")).groupBy("jid", "time")
    t = t.agg(F.when(F.count("a") == n, F.sum("a")).alias("a"), F.when(F.count("v") == n, F.sum("v")).alias("value")).withColumns({"host": F.lit(""), "event": F.lit("")})
    t = interval_rate(t).groupBy("jid").agg(good(F.col("a") * conv).alias("p1"), good(F.col("rate") * conv).alias("p2"))
    h = interval_rate(own.groupBy("jid", "host", "time").agg(F.sum("value").alias("value")).withColumn("event", F.lit(""))).groupBy("jid").agg(good(F.col("rate") * conv).alias("p3"))
    return t.join(h, "jid", "full").select("jid", F.coalesce("p1", "p2", "p3").alias("value"))


def end_to_end(df: DataFrame, event: str, conv: float) -> DataFrame:
    """(last - first) / span at the job's first and last time, per host, then the mean; a host missing there is skipped."""
    own = df.where(F.col("event") == event)
    own = own.join(own.groupBy("jid").agg(F.min("time").alias("t0"), F.max("time").alias("t1")), "jid")
    at = lambda t: F.sum(F.when(F.col("time") == F.col(t), F.col("value")))
    h = own.groupBy("jid", "host", "t0", "t1").agg(at("t0").alias("a"), at("t1").alias("b"))
    d = (F.col("b") - F.col("a")) / (F.unix_seconds("t1") - F.unix_seconds("t0")) * conv
    return h.withColumn("d", d).where("d >= 0").groupBy("jid").agg(F.nullif(F.avg("d"), F.lit(0.0)).alias("value"))


def vector_mix(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Share of vector work in percent and mean width: an event's count times its width, width 1 is scalar."""
    width = reduce(lambda c, kv: c.when(F.col("event") == kv[0], kv[1]), widths.items(), F)
    d = df.withColumn("w", width).where("w is not null")
    h = d.groupBy("jid", "host").agg(F.sum(F.when(F.col("w") > 1, F.col("arc") * F.col("w"))).alias("vec"), F.sum(F.col("arc") * F.col("w")).alias("ops"), F.sum("arc").alias("n"))
    ok = F.nullif(F.col("ops"), F.lit(0.0))
    return h.groupBy("jid").agg(F.avg(100 * F.coalesce("vec", F.lit(0.0)) / ok).alias("percent"), F.avg(F.col("ops") / F.nullif(F.col("n"), F.lit(0.0))).alias("width"))


def node_imbalance(rates: DataFrame, col: str) -> DataFrame:
    """100 times the worst host's mean relative shortfall against the best host of each time."""
    r = rates.withColumn("_x", F.greatest(F.col(col), F.lit(0.0)))
    r = r.withColumn("_m", F.max("_x").over(Window.partitionBy("jid", "time")))
    h = r.where("_m > 0").groupBy("jid", "host").agg(F.avg((F.col("_m") - F.col("_x")) / F.col("_m")).alias("s"))
    return h.groupBy("jid").agg((100 * F.max(F.coalesce("s", F.lit(0.0)))).alias("value"))


def time_imbalance(rates: DataFrame, most: float = 1e9) -> DataFrame:
    """100 times the least ratio of the mean rate after an inner split to that before it, over splits and hosts."""
    key = Window.partitionBy("jid", "host")
    w = key.orderBy("mid")
    r = rates.where("rate is not null").withColumn("rate", F.greatest("rate", F.lit(0.0)))
    seg = (F.col("rate") + F.lag("rate").over(w)) / 2 * (F.col("mid") - F.lag("mid").over(w))
    r = r.withColumn("seg", F.coalesce(seg, F.lit(0.0)))
    r = r.withColumn("cum", F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumns({"before": F.lag("cum").over(w), "all": F.sum("seg").over(key), "t0": F.min("mid").over(key), "t1": F.max("mid").over(key), "i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(key)})
    a = F.col("before") / F.nullif(F.col("mid") - F.col("t0"), F.lit(0.0))
    b = (F.col("all") - F.col("cum")) / F.nullif(F.col("t1") - F.col("mid"), F.lit(0.0))
    r = r.where("n >= 4 and i >= 2 and i <= n - 2").withColumn("q", F.when(a > 0, b / a)).where((F.col("q") >= 0) & (F.col("q") <= most))
    return r.groupBy("jid").agg((100 * F.min("q")).alias("value"))


def memory_high_water(df: DataFrame, used: str, less: list[str], conv: float) -> DataFrame:
    s = lambda ev: F.sum(F.when(F.col("event").isin(ev), F.col("value")))
    t = df.groupBy("jid", "host", "time").agg(s([used]).alias("u"), F.coalesce(s(less), F.lit(0.0)).alias("l"))
    return t.groupBy("jid").agg((F.max(F.col("u") - F.col("l")) * conv).alias("value"))


def gpu_peaks(df: DataFrame, vendors: list[str], power: str, mask: str) -> DataFrame:
    """Highest power and highest mask of clock reasons, each of the first vendor with one above 0."""
    rank = reduce(lambda c, it: c.when(F.col("type") == it[1], it[0]), enumerate(vendors), F)
    pick = lambda e: F.max(F.when((F.col("event") == e) & (F.col("value") > 0) & (F.col("value") < BLANK), F.col("value")))
    v = df.where(F.col("type").isin(vendors)).groupBy("jid", rank.alias("p")).agg(pick(power).alias("w"), F.nullif(pick(mask).cast("long"), F.lit(0)).alias("m"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("p")))
    return v.groupBy("jid").agg(first("w").alias("power"), first("m").alias("mask"))


def node_power(df: DataFrame, module: str, cpu: list[str], gpu: str) -> DataFrame:
    """(job, host, time, watts): the module's power if positive, else the first CPU source plus the GPU's."""
    pick = lambda e: F.sum(F.when(F.col("event") == e, F.col("value")))
    t = df.groupBy("jid", "host", "time").agg(pick(module).alias("m"), *[pick(c).alias(f"c{i}") for i, c in enumerate(cpu)], pick(gpu).alias("g"))
    own = F.coalesce(*[F.col(f"c{i}") for i in range(len(cpu))])
    both = F.when(own.isNotNull() | F.col("g").isNotNull(), F.coalesce(own, F.lit(0.0)) + F.coalesce("g", F.lit(0.0)))
    return t.select("jid", "host", "time", F.when(F.col("m") > 0, F.col("m")).otherwise(both).alias("watts")).where("watts is not null")


def power_summary(power: DataFrame) -> DataFrame:
    return power.groupBy("jid").agg(F.max("watts").alias("peak"), F.avg("watts").alias("mean"))


def energy(power: DataFrame) -> DataFrame:
    """Watt hours: the trapezoids of each host's power, summed; a host needs two points."""
    w = Window.partitionBy("jid", "host").orderBy("time")
    p = power.where("watts >= 0")
    part = (F.col("watts") + F.lag("watts").over(w)) / 2 * (F.unix_seconds("time") - F.lag(F.unix_seconds("time")).over(w)) / 3600
    return p.withColumn("e", part).groupBy("jid").agg(F.sum("e").alias("value")).where("value is not null")


def coverage_state(job: DataFrame, bounds: DataFrame, computed: DataFrame | None = None, margin: int = 600) -> DataFrame:
    """(jid, state) of each job: ``gate`` if its samples do not reach both ends, ``none`` without samples, ``open`` if not yet computed, else ``done``."""
    d = job.select("jid", "start_time", "end_time").join(bounds, "jid", "left")
    near = (F.unix_seconds("first") - F.unix_seconds("start_time") <= margin) & (F.unix_seconds("end_time") - F.unix_seconds("last") <= margin)
    if computed is not None:
        d = d.join(computed.select("jid").distinct().withColumn("_c", F.lit(True)), "jid", "left")
    state = F.when(F.col("_c").isNull(), "open") if computed is not None else F
    return d.select("jid", state.when(F.col("first").isNull(), "none").when(~near, "gate").otherwise("done").alias("state"))


def catalog_fill(state: DataFrame, metric: DataFrame, rows=ROWS) -> DataFrame:
    """Every job of ``state`` with every catalogue row and a value or the reason why there is none.

    A job that failed the gate has no values at all; one without samples has the reason of
    a missing series where a metric needs one.  A reason that ``metric`` gives itself holds
    before the catalogue's.  The catalogue is a short fixed list.
    """
    catalog = state.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], "metric string, _t string, _u string, _why string, _series boolean, ord int")
    own = [c for c in ("type", "no_data_reason") if c in metric.columns]
    d = state.crossJoin(F.broadcast(catalog)).join(metric.select("jid", "metric", "value", *own), ["jid", "metric"], "left")
    given = F.col("no_data_reason") if "no_data_reason" in own else F.lit(None).cast("string")
    value = F.when(~F.col("state").isin("gate", "open"), F.col("value"))
    why = F.when(F.col("state") == "open", NOT_COMPUTED).when(F.col("state") == "gate", INSUFFICIENT).when((F.col("state") == "none") & F.col("_series"), NO_SERIES).otherwise(F.coalesce(given, F.col("_why"), F.lit(NO_SAMPLES)))
    kind = F.coalesce(F.when(value.isNotNull(), F.col("type")), F.col("_t")) if "type" in own else F.col("_t")
    return d.select("jid", kind.alias("type"), "metric", F.col("_u").alias("units"), value.alias("value"), F.when(value.isNull(), why).alias("no_data_reason"), "ord")


def display_order(filled: DataFrame, hide: tuple[str, str] | None = ("avg_gpuutil", "detail_gpu_util_mean")) -> DataFrame:
    """``tier`` (value, reason, not computed) in the order of the catalogue; the first of ``hide`` goes when it equals the second."""
    tier = F.when(F.col("value").isNotNull(), 0).when(F.col("no_data_reason") != NOT_COMPUTED, 1).otherwise(2)
    d = filled.withColumn("tier", tier)
    if hide:
        other = F.max(F.when(F.col("metric") == hide[1], F.col("value"))).over(Window.partitionBy("jid"))
        d = d.withColumn("_o", other).where(~((F.col("metric") == hide[0]) & F.coalesce(F.abs(F.col("value") - F.col("_o")) < 1e-9, F.lit(False)))).drop("_o")
    return d.orderBy("jid", "tier", "ord")


#: Fixed values: (type, column, events, name, factor) of summary series; users may add rows.
SUMMARY = (
    ("amd_x86_pmc", "arc", ("fp_ops_retired",), "amd_flops", 1e-9), ("intel_x86_rapl", "arc", ("pkg_energy",), "watts", 0.00001526), ("amd_x86_rapl", "arc", ("pkg_energy",), "amd_pkg_w", 0.00001526),
    ("host_ib", "arc", ("port_rcv_data", "port_xmit_data"), "ibbw", BYTES_MB), ("host_opa", "arc", ("PortXmitWait", "SwPortCongestion"), "opa_wait_cong", 1.0),
    ("host_opa", "arc", ("PortRcvFECN", "PortRcvBECN"), "opa_ecn", 1.0), ("host_numa", "arc", ("numa_miss", "numa_foreign", "other_node"), "numa_remote_refs", 1.0),
    ("lustre_llite", "arc", ("vfs_read_bytes",), "lustre_read_mb_s", BYTES_MB), ("lustre_llite", "arc", ("vfs_write_bytes",), "lustre_write_mb_s", BYTES_MB),
    ("host_nfs", "arc", ("normal_read", "direct_read", "server_read"), "nfs_read_mb_s", BYTES_MB), ("host_nfs", "arc", ("normal_write", "direct_write", "server_write"), "nfs_write_mb_s", BYTES_MB),
    ("host_nfs", "arc", ("read_ops", "write_ops"), "nfs_iops", 1.0), ("host_cpu", "arc", ("user", "system", "nice"), "cpu", 0.01), ("nvidia_gpu", "value", ("gpu_util",), "nv_gpu_util", 1.0),
    ("nvidia_gpu", "value", ("mem_used_mb",), "nv_mem_used_mb", 1 / 1024), ("nvidia_gpu", "value", ("gpu_count",), "nv_gpu_count", 1.0), ("nvidia_gpu", "value", ("tensor_active",), "nv_tensor_active", 1.0),
    ("nvidia_gpu", "value", ("power_usage",), "nv_power_w", 1.0), ("nvidia_gpu", "value", ("module_power_usage",), "nv_module_power_w", 1.0),
    ("nvidia_gpu", "value", ("gpu_mem_bw_bytes_rate",), "nv_gpu_mem_bw_gbs", BYTES_GB), ("nvidia_gpu", "arc", ("gpu_io_link_total_bytes",), "nv_gpu_link_gbs", BYTES_GB), ("host_mem", "value", ("mem_used",), "mem", 1 / 1024**2),
)


def summary_series(df: DataFrame, specs=SUMMARY, keys=("jid", "host", "time")) -> DataFrame:
    """All series of ``specs`` as columns, in one grouping of the samples; an all-NULL sample stays NULL."""
    own = df.where(reduce(lambda a, b: a | b, [(F.col("type") == t) & F.col("event").isin(*ev) for t, _, ev, _, _ in specs]))
    return own.groupBy(*keys).agg(*[(F.sum(F.when((F.col("type") == t) & F.col("event").isin(*ev), F.col(c))) * k).alias(n) for t, c, ev, n, k in specs])


def host_series(df: DataFrame, host: str, start: Column, end: Column, specs=SUMMARY) -> DataFrame:
    """The same for one host over at most seven days."""
    stop = F.least(end, start + F.expr("interval 7 days"))
    return summary_series(df.where((F.col("host") == host) & (F.col("time") >= start) & (F.col("time") <= stop)), specs, ("host", "time"))


def error_series(df: DataFrame, events: list[str]) -> DataFrame:
    """Rates of error counters; a job's series stays only if any rate is not 0."""
    own = df.where(F.col("event").isin(events))
    return own.join(own.where("arc <> 0").select("jid", "event").distinct(), ["jid", "event"], "left_semi")


def roofline(df: DataFrame, flops: dict[str, float], nbytes: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, flops_gf, bw_gb, ai) of weighted events; only positive points."""
    s = lambda spec: reduce(lambda a, b: a + b, [F.coalesce(F.sum(F.when(F.col("event") == e, F.col("arc"))), F.lit(0.0)) * k for e, k in spec.items()])
    d = df.groupBy(*keys).agg(s(flops).alias("flops_gf"), s(nbytes).alias("bw_gb"))
    return d.withColumn("ai", F.col("flops_gf") / F.nullif(F.col("bw_gb"), F.lit(0.0))).where("ai > 0 and flops_gf > 0")


def roofline_peaks(df: DataFrame, flops: str, bandwidth: list[str], table: DataFrame) -> DataFrame:
    """Reported peaks of a job, else those of its hardware type; the ridge is their ratio.  ``table`` is a short fixed list."""
    m = lambda e: F.max(F.when(F.col("event") == e, F.col("value")))
    bw = reduce(lambda a, b: a + b, [F.coalesce(m(e), F.lit(0.0)) for e in bandwidth])
    p = df.groupBy("jid").agg(m(flops).alias("f"), F.nullif(bw, F.lit(0.0)).alias("b"), F.min("type").alias("type"))
    p = p.join(F.broadcast(table), "type", "left").select("jid", F.coalesce("f", "peak_flops").alias("peak_flops"), F.coalesce("b", "peak_bw").alias("peak_bw"))
    return p.withColumn("ridge", F.col("peak_flops") / F.col("peak_bw"))
