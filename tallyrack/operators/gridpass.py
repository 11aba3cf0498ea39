"""The 28 metrics of a job that read its grid of hosts and times, from one pass over its samples.

A job's grid has all distinct times of all its samples.  Samples (jid, host, time, type,
event, value, arc) are averaged over devices into cells once, and only of the events in the
short tables below; which source a job uses follows from the set of events that it has.
From the cells come, by group of counters, the sums of a host at a time, rates between
*neighbouring* times of the grid (none where an end is missing), and the values at the job's
first and last time.  A host without a complete group at a time has no sum there.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import scratch
from .aggregates import device_count, device_summary, device_util, fsio_rows, telemetry_bounds
from .catalog import AMD_DF, BEEGFS_OPS, BLANK, BYTES_MB, COMPLEX, CPU_TYPE, DRAM_CHANNELS, FP_DOUBLE, FP_SINGLE, LLITE_OPS, MOST_GBPS, SSE
from .metrics import catalog_fill, coverage_state, simple_metrics, time_imbalance


class Source(NamedTuple):
    """One way to fill a group: counters of a type with weights, by part; all must be there, or any."""

    group: str
    attempt: int
    type: str
    terms: tuple  # (event, part, weight)
    every: bool = True
    factor: float = 1.0


#: Types by preference.
PMC = ("amd_x86_pmc", "intel_x86_pmc_gpr8", "intel_x86_pmc_gpr4", "host_cpu_hw", "intel_x86_uncore_imc_skx", "intel_x86_uncore_imc_bdw", "intel_x86_uncore_imc_hsw", "intel_x86_uncore_imc_ivb", "intel_x86_uncore_imc_snb")
IMC = ("intel_x86_uncore_imc_skx", "intel_x86_uncore_imc_icx", "intel_x86_uncore_imc_spr", "intel_x86_uncore_imc_snb", "intel_x86_uncore_imc_ivb", "intel_x86_uncore_imc_hsw", "intel_x86_uncore_imc_bdw")
VENDORS = ("nvidia_gpu", "amd_gpu", "intel_gpu")
#: Nominal GHz; highest sane MB/s, packets/s and GB/s; joules of a count of package energy.
NOMINAL_GHZ, MOST_FABRIC, MOST_PACKETS, RAPL = 2.7, 1.0e6, 1.0e10, 0.00001526
FLITS = 1 / 125000
#: Vector widths of counters of 64-bit and 32-bit work.
WIDTHS_64 = tuple(zip(FP_DOUBLE, (1, 2, 4, 8))) + SSE
WIDTHS_32 = tuple(zip(FP_SINGLE, (1, 4, 8, 16)))
_sum = lambda *events: tuple((e, 0, 1.0) for e in events)
_mix = lambda widths: tuple(t for e, w in widths for t in (((e, 1, 1.0),) if w == 1 else ((e, 0, float(w)), (e, 2, 1.0))))  # noqa: E731  0: vector work, 1: scalar, 2: vector counts
#: The groups and where they come from, by preference.
SOURCES = (
    Source("fabric", 0, "host_ib", _sum("port_xmit_data", "port_rcv_data"), factor=BYTES_MB), Source("fabric", 1, "host_opa", _sum("PortXmitData", "PortRcvData"), factor=FLITS),
    Source("fabric", 2, "host_net", _sum("tx_bytes", "rx_bytes"), factor=BYTES_MB),
    Source("packets", 0, "host_ib", _sum("port_xmit_pkts", "port_rcv_pkts")), Source("packets", 1, "host_opa", _sum("PortXmitPkts", "PortRcvPkts")), Source("packets", 2, "host_net", _sum("tx_packets", "rx_packets")),
    Source("size", 0, "host_ib", _sum("port_xmit_data", "port_rcv_data") + (("port_xmit_pkts", 1, 1.0), ("port_rcv_pkts", 1, 1.0)), factor=BYTES_MB),
    Source("size", 1, "host_opa", _sum("PortXmitData", "PortRcvData") + (("PortXmitPkts", 1, 1.0), ("PortRcvPkts", 1, 1.0)), factor=FLITS),
    Source("size", 2, "host_net", _sum("tx_bytes", "rx_bytes") + (("tx_packets", 1, 1.0), ("rx_packets", 1, 1.0)), factor=BYTES_MB),
    Source("ethernet", 0, "host_net", _sum("rx_bytes", "tx_bytes"), factor=BYTES_MB), Source("lnet", 0, "host_lnet", _sum("tx_bytes", "rx_bytes"), factor=BYTES_MB),
    Source("llite", 0, "lustre_llite", _sum(*LLITE_OPS)), Source("nfs", 0, "host_nfs", _sum("read_ops", "write_ops")), Source("beegfs", 0, "beegfs_client", _sum(*BEEGFS_OPS)),
    Source("opa", 0, "host_opa", _sum("PortXmitWait", "SwPortCongestion", "PortRcvFECN", "PortRcvBECN"), every=False), Source("numa", 0, "host_numa", _sum("numa_miss", "numa_foreign", "other_node"), every=False),
    Source("link", 0, "nvidia_gpu", _sum("gpu_io_link_total_bytes"), factor=1e-9), Source("cpu", 0, CPU_TYPE, _sum("user")),
    Source("memory", 0, "host_mem", (("mem_used", 0, 1.0), ("slab", 0, -1.0), ("file_pages", 0, -1.0)), factor=1 / 1024**2),
    *[Source("tensor", i, t, _sum("tensor_active")) for i, t in enumerate(VENDORS)],
    *[Source("util", 2 * i + j, t, _sum(e)) for i, t in enumerate(VENDORS) for j, e in enumerate(("gpu_util", "utilization")) if (t, e) != ("amd_gpu", "utilization")],
    *[Source("dram", i, t, _sum(*DRAM_CHANNELS), every=False) for i, t in enumerate(AMD_DF)],
    *[Source("dram", len(AMD_DF) + i, t, _sum("dram_cas_reads", "dram_cas_writes", "hbm_cas_reads", "hbm_cas_writes"), every=False) for i, t in enumerate(IMC)],
    *[Source("clock", i, t, (("aperf", 0, 1.0), ("mperf", 1, 1.0))) for i, t in enumerate(PMC)],
    *[Source("vector64", i, t, _mix(WIDTHS_64), every=False) for i, t in enumerate(PMC)], *[Source("vector32", i, t, _mix(WIDTHS_32), every=False) for i, t in enumerate(PMC)],
    *[Source("flops", 4 * i + j, t, terms, every=False) for i, t in enumerate(PMC) for j, terms in enumerate((_sum("fp_ops_retired"), _sum(*FP_DOUBLE, *FP_SINGLE), tuple((e, 0, float(w)) for e, w in SSE), _sum("arm_est_flops")))],
)
#: Groups that take the first type a job has, whatever its events.
OF_FIRST_TYPE = {"clock": PMC, "vector64": PMC, "vector32": PMC, "flops": PMC}
PEAKS = {"fabric": None, "packets": MOST_PACKETS, "lnet": None, "llite": None, "nfs": None, "beegfs": None, "opa": None, "numa": None, "link": MOST_GBPS}
IMBALANCES = {"fabric": "fabric_node_imbalance", "flops": "flops_node_imbalance", "dram": "dram_bw_node_imbalance", "lnet": "lnet_node_imbalance", "cpu": "node_imbalance", "util": "gpu_util_node_imbalance", "tensor": "tensor_node_imbalance"}
SNAPSHOTS = ("util", "tensor")
ENDS = ("size", "ethernet", "clock", "vector64", "vector32")
#: Gauges of GPUs and parts of a node's power: name, type, event, column, factor.
GAUGES = (("power_usage", "watts"), ("clocks_event_reasons", "reasons"))
POWER = (
    ("module", "nvidia_gpu", "module_power_usage", "value", 1.0), ("gpu", "nvidia_gpu", "power_usage", "value", 1.0), ("cpu0", "host_cpu_hw", "dcgm_cpu_power_util_w", "value", 1.0),
    ("cpu1", "intel_x86_rapl", "pkg_energy", "arc", RAPL), ("cpu2", "amd_x86_rapl", "pkg_energy", "arc", RAPL),
)

_events = list(dict.fromkeys([(s.type, e) for s in SOURCES for e, _, _ in s.terms] + [(t, e) for t in VENDORS for e, _ in GAUGES] + [(t, e) for _, t, e, _, _ in POWER]))
#: Number of each event that is read; a type's other events share a number, so that it is known to be there.
CODES = {k: i for i, k in enumerate(_events)}
TYPES = {t: len(CODES) + i for i, t in enumerate(dict.fromkeys(PMC + IMC))}


def cells(df: DataFrame) -> DataFrame:
    """(jid, host, time, code, v, n, a, m): sum and count of value and of arc over devices.  Other samples only mark their time."""
    spec = df.sparkSession.createDataFrame([(*k, i) for k, i in CODES.items()], "type string, event string, code int")
    other = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), TYPES.items(), F).otherwise(-1)
    d = df.join(F.broadcast(spec), ["type", "event"], "left").withColumn("code", F.coalesce("code", other))
    return d.groupBy("jid", "host", "time", "code").agg(F.sum("value").alias("v"), F.count("value").alias("n"), F.sum("arc").alias("a"), F.count("arc").alias("m"))


def sources(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((jid, group, attempt, expected): of each group that a job can fill, its source and the number of terms to expect, (jid, t0, t1))."""
    spark = c.sparkSession
    have = _written(c.groupBy("jid", "code").agg(F.min("time").alias("t0"), F.max("time").alias("t1")), "events")
    bounds = have.groupBy("jid").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    of_first = {(g, t): ("pmc", i) for g in OF_FIRST_TYPE for i, t in enumerate(PMC)} | {("dram", t): ("imc", i) for i, t in enumerate(IMC)}
    ranks = [(code, family, i) for family, types in (("pmc", PMC), ("imc", IMC)) for i, t in enumerate(types) for code in [*(k for (u, _), k in CODES.items() if u == t), TYPES[t]]]
    first = have.join(F.broadcast(spark.createDataFrame(ranks, "code int, family string, rank int")), "code").groupBy("jid", "family").agg(F.min("rank").alias("first"))
    rows = [(CODES[s.type, e], s.group, s.attempt, len(s.terms) if s.every else 0, *of_first.get((s.group, s.type), ("", 0))) for s in SOURCES for e, _, _ in s.terms]
    terms = spark.createDataFrame(rows, "code int, group string, attempt int, need int, family string, rank int")
    fit = have.join(F.broadcast(terms), "code").groupBy("jid", "group", "attempt", "need", "family", "rank").agg(F.count(F.lit(1)).alias("expected")).where("need in (0, expected)")
    fit = fit.join(first, ["jid", "family"], "left").where("family = '' or rank = first")
    chosen = fit.groupBy("jid", "group").agg(F.min_by(F.struct("attempt", "expected"), "attempt").alias("s")).select("jid", "group", "s.attempt", "s.expected")
    return chosen, bounds


def host_sums(c: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((jid, group, attempt, host, time, p0, p1, p2) of complete groups, the same of the mean over hosts by value and arc)."""
    rows = [(CODES[s.type, e], s.group, s.attempt, part, w) for s in SOURCES for e, part, w in s.terms]
    terms = c.sparkSession.createDataFrame(rows, "code int, group string, attempt int, part int, weight double")
    d = c.where(F.col("code") >= 0).join(F.broadcast(terms), "code").join(wanted, ["jid", "group", "attempt"])
    mean = F.when((F.col("v") / F.col("n") < BLANK) | ~F.col("group").isin(*SNAPSHOTS), F.col("v") / F.col("n"))
    part = lambda i: F.coalesce(F.sum(F.when(F.col("part") == i, mean * F.col("weight"))), F.lit(0.0)).alias(f"p{i}")
    whole = F.count(mean) == F.max("expected")
    hosts = d.groupBy("jid", "group", "attempt", "host", "time").agg(part(0), part(1), part(2), whole.alias("whole")).where("whole").drop("whole")
    over = d.where(F.col("group").isin(*PEAKS)).groupBy("jid", "group", "attempt", "expected", "time", "code", "weight").agg(*[F.sum(x).alias(x) for x in "vnam"])
    both = over.groupBy("jid", "group", "attempt", "expected", "time").agg(*[F.sum(F.col(x) / F.col(y) * F.col("weight")).alias(z) for x, y, z in (("v", "n", "p0"), ("a", "m", "arc"))], F.count_if(F.col("n") > 0).alias("cv"), F.count_if(F.col("m") > 0).alias("ca"))
    both = both.select("jid", "group", "attempt", "time", F.when(F.col("cv") == F.col("expected"), F.col("p0")).alias("p0"), F.when(F.col("ca") == F.col("expected"), F.col("arc")).alias("arc"))
    return hosts, both


def axis(c: DataFrame) -> DataFrame:
    """(jid, time, before): every time of a job and the one before it."""
    return c.select("jid", "time").distinct().withColumn("before", F.lag("time").over(Window.partitionBy("jid").orderBy("time")))


def rates(sums: DataFrame, grid: DataFrame) -> DataFrame:
    """``sums`` with ``rate``: change over the seconds since the neighbouring time, NULL where the host has no sum there."""
    w = Window.partitionBy("jid", "group", "attempt", "host").orderBy("time")
    dt = F.unix_seconds("time") - F.unix_seconds("before")
    d = sums.join(grid, ["jid", "time"])
    near = (F.lag("time").over(w) == F.col("before")) & (dt > 0)
    return d.withColumn("rate", F.when(near, (F.col("p0") - F.lag("p0").over(w)) / dt))


def _of_source(values: list[tuple]) -> Column:
    return reduce(lambda c, v: c.when((F.col("group") == v[0]) & (F.col("attempt") == v[1]), v[2]), values, F)


def _factor() -> Column:
    return _of_source([(s.group, s.attempt, s.factor) for s in SOURCES if s.factor != 1.0]).otherwise(1.0)


def _type() -> Column:
    return _of_source([(s.group, s.attempt, s.type) for s in SOURCES])


def peaks(hosts: DataFrame, over: DataFrame) -> DataFrame:
    """(jid, group, attempt, mean, host): the highest rate of the mean over hosts (by arc, else by value), and of one host."""
    most = reduce(lambda c, kv: c.when(F.col("group") == kv[0], kv[1]), [(k, v) for k, v in PEAKS.items() if v], F).otherwise(float("inf"))
    good = lambda c: F.max(F.when((c * _factor() > 0) & (c * _factor() <= most), c * _factor()))
    m = over.groupBy("jid", "group", "attempt").agg(F.coalesce(good(F.col("arc")), good(F.col("rate"))).alias("mean"))
    h = hosts.where(F.col("group").isin(*PEAKS)).groupBy("jid", "group", "attempt").agg(good(F.col("rate")).alias("host"))
    return m.join(h, ["jid", "group", "attempt"], "full")


def peak_metrics(p: DataFrame) -> DataFrame:
    best = F.coalesce("mean", "host")
    name = {"fabric": "max_fabricbw", "packets": "max_packetrate", "lnet": "max_lnetbw", "opa": "max_opa_congestion_rate", "numa": "max_numa_remote_rate", "link": "max_gpu_link_gbps"}
    plain = p.where(F.col("group").isin(*name)).select("jid", reduce(lambda c, kv: c.when(F.col("group") == kv[0], kv[1]), name.items(), F).alias("metric"), _type().alias("type"), F.when((F.col("group") != "fabric") | (best <= MOST_FABRIC), best).alias("value"))
    at = lambda g, c: F.max(F.when(F.col("group") == g, F.col(c)))
    w = p.groupBy("jid").agg(*[at(g, c).alias(f"{g}_{c}") for g in ("llite", "nfs", "beegfs") for c in ("mean", "host")])
    others = F.greatest("llite_host", "nfs_mean", "nfs_host")
    bee = F.col("beegfs_mean").isNotNull() | (F.col("beegfs_host") > F.coalesce(others, F.lit(0.0)))
    ops = w.select("jid", F.lit("max_mds").alias("metric"), F.when(F.col("llite_mean").isNull() & bee, "beegfs_client").otherwise("lustre_llite").alias("type"), F.coalesce("llite_mean", F.greatest(others, "beegfs_mean", "beegfs_host")).alias("value"))
    return plain.unionByName(ops)


def imbalance_metrics(hosts: DataFrame, wanted: DataFrame) -> DataFrame:
    """100 times the worst host's mean relative shortfall against the best host of each time; 0 where no time counts."""
    x = F.when(F.col("group").isin(*SNAPSHOTS), F.col("p0")).otherwise(F.col("rate"))
    d = hosts.where(F.col("group").isin(*IMBALANCES) & ((F.col("group") != "fabric") | (F.col("attempt") < 2))).select("jid", "group", "host", "time", x.alias("x")).where("x is not null")
    d = d.withColumn("most", F.max("x").over(Window.partitionBy("jid", "group", "time"))).where("most > 0")
    d = d.groupBy("jid", "group", "host").agg(F.avg((F.col("most") - F.col("x")) / F.col("most")).alias("s")).groupBy("jid", "group").agg((100 * F.max("s")).alias("value"))
    own = wanted.select("jid", "group", "attempt").where(F.col("group").isin(*IMBALANCES) & ((F.col("group") != "fabric") | (F.col("attempt") < 2)))
    name = reduce(lambda c, kv: c.when(F.col("group") == kv[0], kv[1]), IMBALANCES.items(), F)
    return own.join(d, ["jid", "group"], "left").select("jid", name.alias("metric"), _type().alias("type"), F.coalesce("value", F.lit(0.0)).alias("value"))


def time_metric(hosts: DataFrame, grid: DataFrame) -> DataFrame:
    """The least ratio of work after an inner time to that before it; an interval without a rate counts as idle."""
    own = hosts.where("group = 'cpu'")
    every = grid.where("before is not null").join(own.select("jid", "host").distinct(), "jid").join(own.select("jid", "host", "time", "rate"), ["jid", "host", "time"], "left")
    d = every.select("jid", "host", F.coalesce("rate", F.lit(0.0)).alias("rate"), ((F.unix_seconds("time") + F.unix_seconds("before")) / 2).alias("mid"))
    return time_imbalance(d).select("jid", F.lit("time_imbalance").alias("metric"), F.lit(CPU_TYPE).alias("type"), "value")


def end_metrics(hosts: DataFrame, bounds: DataFrame) -> DataFrame:
    """Metrics of what a host's counters gained from the job's first to its last time; a host missing there is left out."""
    d = hosts.where(F.col("group").isin(*ENDS)).join(bounds, "jid").where("time = t0 or time = t1")
    gain = lambda i: F.sum(F.when(F.col("time") == F.col("t1"), F.col(f"p{i}")).otherwise(-F.col(f"p{i}"))).alias(f"d{i}")
    h = d.groupBy("jid", "group", "attempt", "host", "t0", "t1").agg(gain(0), gain(1), gain(2), F.count(F.lit(1)).alias("n")).where("n = 2")
    dt = F.unix_seconds("t1") - F.unix_seconds("t0")
    bytes_ = F.when((dt > 0) & (F.col("d0") >= 0), F.col("d0") * _factor() / dt)
    over = lambda a, b: F.when(b != 0, a / b)
    mixed = over(F.col("d0") + F.col("d1"), F.col("d1") + F.col("d2"))
    of = lambda g, c: F.when(F.col("group") == g, c)
    each = F.coalesce(of("ethernet", bytes_), of("size", over(F.col("d0") * _factor(), F.col("d1"))), of("clock", over(NOMINAL_GHZ * F.col("d0"), F.col("d1"))), of("vector64", mixed), of("vector32", mixed))
    j = h.groupBy("jid", "group", "attempt").agg(F.avg(each).alias("mean"), over(100 * F.sum("d0"), F.sum(F.col("d0") + F.col("d1"))).alias("percent"))
    name = {"ethernet": "avg_ethbw", "size": "avg_packetsize", "clock": "avg_freq", "vector64": "avg_vector_width_64b", "vector32": "avg_vector_width_32b"}
    means = j.select("jid", reduce(lambda c, kv: c.when(F.col("group") == kv[0], kv[1]), name.items(), F).alias("metric"), _type().alias("type"), F.when((F.col("group") != "ethernet") | (F.col("mean") != 0), F.col("mean")).alias("value"))
    mix = j.where(F.col("group").isin("vector64", "vector32")).select("jid", F.concat(F.lit("vecpercent_"), F.substring("group", 7, 2), F.lit("b")).alias("metric"), _type().alias("type"), F.col("percent").alias("value"))
    return means.unionByName(mix)


def gauge_metrics(c: DataFrame, hosts: DataFrame) -> DataFrame:
    """Peaks of memory, GPU power and clock reasons: of GPUs the first vendor with a value above 0."""
    rows = [(CODES[t, e], i, t, name) for i, t in enumerate(VENDORS) for e, name in GAUGES]
    spec = c.sparkSession.createDataFrame(rows, "code int, vendor int, type string, what string")
    x = F.col("v") / F.col("n")
    d = c.join(F.broadcast(spec), "code").groupBy("jid", "what", "vendor", "type").agg(F.max(F.when(x < BLANK, x)).alias("x"))
    d = d.withColumn("x", F.when(F.col("what") == "reasons", F.floor("x").cast("double")).otherwise(F.col("x"))).where("x > 0")
    d = d.groupBy("jid", "what").agg(F.min_by(F.struct("type", "x"), "vendor").alias("r"))
    gpu = d.select("jid", F.when(F.col("what") == "watts", "max_gpu_power").otherwise("max_gpu_clock_event_reasons").alias("metric"), "r.type", F.col("r.x").alias("value"))
    memory = hosts.where("group = 'memory'").groupBy("jid").agg(F.max("p0").alias("x")).where("x > 0")
    return gpu.unionByName(memory.select("jid", F.lit("mem_hwm").alias("metric"), F.lit("host_mem").alias("type"), (F.col("x") / 1024**2).alias("value")))


def power_metrics(c: DataFrame) -> DataFrame:
    """A node's power at a time is its module's if above 0, else the first CPU source's and the GPUs'; watt hours need a CPU source."""
    spec = c.sparkSession.createDataFrame([(CODES[t, e], name, col == "arc", k) for name, t, e, col, k in POWER], "code int, name string, rate boolean, factor double")
    x = F.when(F.col("rate"), F.when(F.col("m") > 0, F.col("a"))).otherwise(F.when(F.col("n") > 0, F.col("v"))) * F.col("factor")
    d = c.join(F.broadcast(spec), "code").groupBy("jid", "host", "time").agg(*[F.sum(F.when(F.col("name") == n, x)).alias(n) for n, *_ in POWER])
    cpu = F.coalesce("cpu0", "cpu1", "cpu2")
    both = F.when(cpu.isNotNull() | F.col("gpu").isNotNull(), F.coalesce(cpu, F.lit(0.0)) + F.coalesce("gpu", F.lit(0.0)))
    d = d.select("jid", "host", "time", cpu.alias("cpu"), F.when(F.col("module") > 0, F.col("module")).otherwise(both).alias("w")).where("w is not null")
    near = Window.partitionBy("jid", "host").orderBy("time")
    part = (F.col("w") + F.lag("w").over(near)) / 2 * (F.unix_micros("time") - F.lag(F.unix_micros("time")).over(near)) / 3.6e9
    h = d.withColumn("e", part).groupBy("jid", "host").agg(F.max("w").alias("most"), F.sum("w").alias("w"), F.count("w").alias("n"), F.sum("e").alias("e"), F.count("cpu").alias("cpu"))
    j = h.groupBy("jid").agg(F.max("most").alias("max_node_power_est_w"), (F.sum("w") / F.sum("n")).alias("avg_node_power_est_w"), F.when(F.sum("cpu") > 0, F.sum(F.when(F.col("e") >= 0, F.col("e")))).alias("job_cpu_gpu_watt_hours"))
    return j.unpivot("jid", ["max_node_power_est_w", "avg_node_power_est_w", "job_cpu_gpu_watt_hours"], "metric", "value").select("jid", "metric", F.lit("job").alias("type"), "value")


def gpu_details(df: DataFrame) -> DataFrame:
    """(jid, metric, type, value) of active GPUs, their utilisation and count."""
    util = device_summary(device_util(df.where(F.col("value") < BLANK), list(VENDORS), ["gpu_util", "utilization"]), ["gpu_util", "utilization"])
    names = {"detail_gpu_active": F.col("active").cast("double"), "detail_gpu_util_max": F.col("vmax"), "detail_gpu_util_mean": F.col("vmean"), "avg_gpuutil": F.col("vmean")}
    rows = util.select("jid", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in names.items()])).alias("x")).select("jid", "x.metric", F.lit("gpu").alias("type"), "x.value")
    count = device_count(df.where(F.col("value") < BLANK), list(VENDORS), "gpu_count")
    return rows.unionByName(count.select("jid", F.lit("detail_gpu_count").alias("metric"), F.lit("gpu").alias("type"), F.col("n").cast("double").alias("value"))).where("value is not null")


def job_metrics(job: DataFrame, df: DataFrame, computed: DataFrame | None = None, margin: int = 600, seconds: int = 300) -> DataFrame:
    """All 66 catalogue rows of every job: (jid, type, metric, units, value, no_data_reason, ord).

    ``df`` has the samples of jobs (jid, host, dev, time, type, event, value, arc, delta,
    ncores, nhosts).  They are written once to the shared folder, so that the join that made
    them runs once; bounds, simple and complex metrics and details read them from there.
    """
    d = _written(df.select("jid", "host", "dev", "time", "type", "event", "value", "arc", "delta", "ncores", "nhosts"), "samples")
    state = coverage_state(job, telemetry_bounds(d), computed, margin)
    why = F.lit(None).cast("string").alias("no_data_reason")
    parts = [simple_metrics(d, seconds=seconds).select("jid", "metric", "type", "value", why), complex_metrics(d).select("jid", "metric", "type", "value", why), gpu_details(d).select("jid", "metric", "type", "value", why)]
    parts.append(fsio_rows(d, job).select("jid", "metric", "type", "value", "no_data_reason"))
    return catalog_fill(state, reduce(DataFrame.unionByName, parts))


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = scratch(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def complex_metrics(df: DataFrame) -> DataFrame:
    """(jid, type, metric, units, value) of the complex metrics that the samples of jobs allow.

    The cells, and the rates made of them, are written once to the shared folder and read by
    each part from there: all parts together scan the samples and join them once.
    """
    c = _written(cells(df), "cells")
    (wanted, bounds), grid = sources(c), axis(c)
    wanted = _written(wanted, "sources")
    hosts, over = host_sums(c, wanted)
    hosts, over = _written(rates(hosts, grid), "rates"), rates(over.withColumn("host", F.lit("")), grid)
    parts = [peak_metrics(peaks(hosts, over)), imbalance_metrics(hosts, wanted), time_metric(hosts, grid), end_metrics(hosts, bounds), gauge_metrics(c, hosts), power_metrics(c)]
    rows = reduce(DataFrame.unionByName, [p.select("jid", "type", "metric", "value") for p in parts]).where("value is not null")
    units = F.create_map(*[F.lit(x) for m, (_, u) in COMPLEX.items() for x in (m, u)])
    return rows.select("jid", "type", "metric", units[F.col("metric")].alias("units"), "value")
