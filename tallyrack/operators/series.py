"""All series and rooflines of a job from its samples.

Samples (jid, host, dev, time, type, event, value, arc) are joined to a short table of terms
once and summed by one pivot; which source a job uses follows from counts for each job.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import AMD_DF, BANDWIDTH, BEEGFS_OPS, BYTES_GB, BYTES_MB, CAS_GB, CORE_PMC, DRAM_CHANNELS, FLOPS, FP_DOUBLE, FP_SINGLE, GPUS, IMC, LLITE_OPS, MOST_GBPS
from .joins import over_jobs
from .metrics import SUMMARY


class Term(NamedTuple):
    name: str
    type: str
    column: str
    events: tuple
    factor: float


#: Further series of one source each.
SINGLE = tuple(Term(n, t, c, ev, k) for t, c, ev, n, k in SUMMARY) + (
    Term("amd_instr", "amd_x86_pmc", "value", ("instr_retired",), 1.0), Term("amd_mcycles", "amd_x86_pmc", "arc", ("mperf",), 1.0), Term("amd_acycles", "amd_x86_pmc", "arc", ("aperf",), 1.0),
    Term("liops", "lustre_llite", "arc", LLITE_OPS, 1.0), Term("beegfs_read_mb_s", "beegfs_client", "arc", ("vfs_read_bytes",), BYTES_MB),
    Term("beegfs_write_mb_s", "beegfs_client", "arc", ("vfs_write_bytes",), BYTES_MB), Term("beegfs_iops", "beegfs_client", "arc", BEEGFS_OPS, 1.0),
    Term("nv_mem_total_mb", "nvidia_gpu", "value", ("mem_total_mb",), 1 / 1024), Term("nv_tensor_imma_active", "nvidia_gpu", "value", ("tensor_imma_active",), 1.0),
    Term("nv_tensor_hmma_active", "nvidia_gpu", "value", ("tensor_hmma_active",), 1.0), Term("nv_tensor_dfma_active", "nvidia_gpu", "value", ("tensor_dfma_active",), 1.0),
    Term("nv_sm_occupancy", "nvidia_gpu", "value", ("sm_occupancy",), 1.0), Term("nv_fp16_active", "nvidia_gpu", "value", ("fp16_active",), 1.0), Term("nv_fp32_active", "nvidia_gpu", "value", ("fp32_active",), 1.0),
    Term("nv_mem_util_pct", "nvidia_gpu", "value", ("mem_util",), 1.0), Term("dcg_cpu_power_w", "host_cpu_hw", "value", ("dcgm_cpu_power_util_w",), 1.0),
)
#: Series that a job shows only without a gap; the others may have gaps.
WHOLE = ("amd_flops", "amd_instr", "amd_mcycles", "amd_acycles", "ibbw", "liops", "cpu", "mem")
SPLIT = ("nv_tensor_imma_active", "nv_tensor_hmma_active", "nv_tensor_dfma_active")
#: Series of the first source that a job has without a gap.
FIRST = {
    "flops64b": [(t, FP_DOUBLE, 1e-9) for t in CORE_PMC] + [("host_cpu_hw", ("fp_arith_inst_retired_scalar_double",), 1e-9)],
    "flops32b": [(t, FP_SINGLE, 1e-9) for t in CORE_PMC] + [("host_cpu_hw", ("fp_arith_inst_retired_scalar_single",), 1e-9)],
    "instr": [(t, ("instr_retired",), 1.0) for t in CORE_PMC], "mcycles": [(t, ("mperf",), 1.0) for t in CORE_PMC], "acycles": [(t, ("aperf",), 1.0) for t in CORE_PMC],
    "mbw": [(t, ("dram_cas_reads", "dram_cas_writes", "hbm_cas_reads", "hbm_cas_writes"), CAS_GB) for t in IMC], "amd_mbw": [(t, DRAM_CHANNELS, BYTES_GB) for t in AMD_DF],
}
CHA, CHA_EVENTS = "intel_x86_uncore_cha_skx", ("SF_EVICTIONS_MES,E", "LLC_LOOKUP_DATA_READ_LOCAL,E", "BYPASS_CHA_IMC_ALL,E", "LLC_LOOKUP_WRITE")
OPA = ("PortXmitData", "PortRcvData")
NOMINAL_GHZ = 2.7
#: Counters of hardware errors by type.
ERRORS = {
    "host_ib": (
        "excessive_buffer_overrun_errors", "link_downed", "link_error_recovery", "local_link_integrity_errors", "port_rcv_constraint_errors", "port_rcv_errors",
        "port_rcv_remote_physical_errors", "port_rcv_switch_relay_errors", "port_xmit_constraint_errors", "port_xmit_discards", "symbol_error",
    ),
    "host_net": (
        "rx_crc_errors", "rx_errors", "rx_fifo_errors", "rx_frame_errors", "rx_length_errors", "rx_missed_errors", "rx_over_errors", "tx_aborted_errors",
        "tx_carrier_errors", "tx_errors", "tx_fifo_errors", "tx_heartbeat_errors", "tx_window_errors",
    ),
    "host_opa": ("PortErrorCounterSummary",),
}
#: Nominal GFLOP/s and GB/s of a node by the type of its memory counters.
PEAKS = {
    "intel_x86_uncore_imc_snb": (640.0, 85.0), "intel_x86_uncore_imc_ivb": (900.0, 102.0), "intel_x86_uncore_imc_hsw": (1400.0, 110.0), "intel_x86_uncore_imc_bdw": (1800.0, 140.0),
    "intel_x86_uncore_imc_skx": (6400.0, 460.0), "intel_x86_uncore_imc_icx": (6400.0, 480.0), "intel_x86_uncore_imc_spr": (8400.0, 550.0),
}
AMD_PEAKS, ARM_PEAKS, PEAK_TYPE = (4000.0, 410.0), (7100.0, 500.0), "host_roofline_peak"
#: GPU bandwidth by preference: type, column, events, axis.
GPU_LINK = ("gpu_pcie_tx_bytes", "gpu_pcie_rx_bytes", "gpu_nvlink_tx_bytes", "gpu_nvlink_rx_bytes")
GPU_BANDWIDTH = (
    ("nvidia_gpu", "value", ("gpu_mem_bw_bytes_rate",), "memory_bw"), ("amd_gpu", "value", ("gpu_mem_bw_bytes_rate",), "memory_bw"), ("nvidia_gpu", "arc", ("gpu_io_link_total_bytes",), "pcie_nvlink"),
    ("nvidia_gpu", "arc", GPU_LINK, "pcie_nvlink"), ("intel_gpu", "arc", ("gpu_pcie_tx_bytes", "gpu_pcie_rx_bytes", "gpu_xe_link_tx_bytes", "gpu_xe_link_rx_bytes"), "pcie_nvlink"),
)


def summed(df: DataFrame, terms, keys: list[str]) -> DataFrame:
    """A row for each of ``keys`` in ``df`` and a column for each name: the sum of its terms, NULL where none has a value."""
    rows = [(x.name, x.type, e, x.column == "arc", float(x.factor)) for x in terms for e in x.events]
    spec = df.sparkSession.createDataFrame(rows, "_n string, type string, event string, _arc boolean, _k double")
    names = list(dict.fromkeys(x.name for x in terms))
    v = F.when(F.col("_arc"), F.col("arc")).otherwise(F.col("value")) * F.col("_k")
    return df.join(F.broadcast(spec), ["type", "event"], "left").select(*keys, "_n", v.alias("_v")).groupBy(*keys).pivot("_n", names).agg(F.sum("_v"))


def _first(names: list[str], usable) -> Column:
    """The column of the first name that is usable for the job, gaps included: sources are never mixed."""
    return reduce(lambda c, n: c.when(usable(n), F.col(n)), names, F)


def job_series(df: DataFrame, job: DataFrame | None = None, columns: list = ("*",)) -> DataFrame:
    """(jid, host, time) with a column for each series; a row for every sample time of a host.

    A series of ``FIRST`` comes from its first source without a gap, a series of ``WHOLE`` is NULL
    for a job with a gap.  Fabric falls back to the second fabric, GPU use to its older name;
    the lumped tensor series goes if a split one is there.  Counts for each job decide, so no
    task holds a whole job.  With ``job``, ``df`` holds the samples of the windows of its hosts
    (``window_samples``), and sums are made once for each window.
    """
    tries = {n: [f"{n}_{i}" for i in range(len(sources))] for n, sources in FIRST.items()}
    terms = [*SINGLE, Term("opa_bw", "host_opa", "arc", OPA, 1 / 125000), Term("utilization", "nvidia_gpu", "value", ("utilization",), 1.0), Term("cha_counter_arc_sum", CHA, "arc", CHA_EVENTS, 1.0)]
    terms += [Term(c, t, "arc", ev, k) for n, sources in FIRST.items() for c, (t, ev, k) in zip(tries[n], sources)]
    wide = summed(df, terms, ["jid", "host", "time"])
    finish = lambda d: _chosen(_series_of(d, terms, tries), columns)
    return finish(wide) if job is None else over_jobs(job, wide, finish)


def _chosen(d: DataFrame, columns) -> DataFrame:
    """``columns`` beside the jid: made before rows go to the jobs, so once for all jobs with the same windows."""
    return d if tuple(columns) == ("*",) else d.select("jid", *columns)


def _series_of(wide: DataFrame, terms: list[Term], tries: dict[str, list[str]]) -> DataFrame:
    counts = wide.groupBy(F.col("jid").alias("_jid")).agg(F.count(F.lit(1)).alias("_all"), *[F.count(x.name).alias(f"_c_{x.name}") for x in terms])
    d = wide.join(counts, F.col("jid").eqNullSafe(F.col("_jid")))
    some, full = (lambda c: F.col(f"_c_{c}") > 0), (lambda c: F.col(f"_c_{c}") == F.col("_all"))
    out = {x.name: F.when(full(x.name), F.col(x.name)) if x.name in WHOLE else F.col(x.name) for x in SINGLE}
    out["ibbw"] = F.when(full("ibbw"), F.col("ibbw")).otherwise(F.col("opa_bw"))
    out["nv_gpu_util"] = F.when(some("nv_gpu_util"), F.col("nv_gpu_util")).otherwise(F.col("utilization"))
    out["nv_tensor_active"] = F.when(~reduce(lambda a, b: a | b, map(some, SPLIT)), F.col("nv_tensor_active"))
    out["nv_gpu_link_gbs"] = F.when(F.abs("nv_gpu_link_gbs") <= MOST_GBPS, F.col("nv_gpu_link_gbs"))
    out["cha_counter_arc_sum"] = F.col("cha_counter_arc_sum")
    out |= {n: _first(cols, full) for n, cols in tries.items()}
    d = d.select("jid", "host", "time", *[c.alias(n) for n, c in out.items()])
    ratio = lambda a, m: NOMINAL_GHZ * F.col(a) / F.nullif(F.col(m), F.lit(0.0))
    cpu, gpu = F.coalesce("dcg_cpu_power_w", "watts", "amd_pkg_w"), F.col("nv_power_w")
    node = F.when(F.col("nv_module_power_w") > 0, F.col("nv_module_power_w")).when(cpu.isNotNull() | gpu.isNotNull(), F.coalesce(cpu, F.lit(0.0)) + F.coalesce(gpu, F.lit(0.0)))
    return d.withColumns({"freq": F.coalesce(ratio("acycles", "mcycles"), ratio("amd_acycles", "amd_mcycles")), "node_power_est_w": node})


def hardware_errors(df: DataFrame, counters=ERRORS) -> DataFrame:
    """(jid, host, time, type, event, rate) summed over devices; a job's counter stays only if any rate is not 0."""
    own = df.where(reduce(lambda a, b: a | b, [(F.col("type") == t) & F.col("event").isin(*ev) for t, ev in counters.items()]))
    own = own.groupBy("jid", "host", "time", "type", "event").agg(F.sum("arc").alias("rate"))
    return own.join(own.where("rate <> 0").select("jid", "type", "event").distinct(), ["jid", "type", "event"], "left_semi").select("jid", "host", "time", "type", "event", "rate")


def _points(d: DataFrame, keys: list[str]) -> DataFrame:
    return d.withColumn("ai", F.col("flops_gf") / F.nullif(F.col("bw_gb"), F.lit(0.0))).where("flops_gf > 0 and ai > 0").select(*keys, "flops_gf", "bw_gb", "ai")


def job_roofline(df: DataFrame, job: DataFrame | None = None, columns: list = ("*",)) -> DataFrame:
    """(jid, host, time, flops_gf, bw_gb, ai) from the sources that the job has.

    AMD counters if it has both of theirs; else the first of the others for each axis, in the
    order of ``FLOPS`` and ``BANDWIDTH``.  With ``job``, ``df`` holds the samples of the windows
    of its hosts, as for ``job_series``.
    """
    terms, side = [], {"f": [], "b": []}
    for s, tries in (("f", FLOPS), ("b", BANDWIDTH)):
        for i, parts in enumerate(tries):
            side[s].append((f"{s}{i}", parts[0][0].startswith("amd_")))
            terms += [Term(f"{s}{i}", t, "arc", ev, k) for t, ev, k in parts]
    keys = ["jid", "host", "time"]
    wide = summed(df, terms, keys)
    finish = lambda d: _chosen(_roofline_of(d, side, keys), columns)
    return finish(wide) if job is None else over_jobs(job, wide, finish)


def _roofline_of(wide: DataFrame, side: dict, keys: list[str]) -> DataFrame:
    counts = wide.groupBy(F.col("jid").alias("_jid")).agg(*[F.count(c).alias(f"_c_{c}") for x in side.values() for c, _ in x])
    some = lambda c: F.col(f"_c_{c}") > 0
    of = {s: ([c for c, amd in x if amd], [c for c, amd in x if not amd]) for s, x in side.items()}
    both = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(some, of[s][0])) for s in "fb"])
    d = wide.join(counts, F.col("jid").eqNullSafe(F.col("_jid")))
    return _points(d.select(*keys, *[F.when(both, _first(of[s][0], some)).otherwise(_first(of[s][1], some)).alias(n) for s, n in (("f", "flops_gf"), ("b", "bw_gb"))]), keys)


def device_roofline(df: DataFrame) -> DataFrame:
    """(jid, host, dev, time, flops_gf, bw_gb, ai, axis) of GPUs: memory bandwidth, else link bytes, whichever first has usable points."""
    keys, terms = ["jid", "host", "dev", "time"], []
    for t in (*GPUS, "intel_gpu"):
        terms += [Term(f"{t}_f0", t, "arc", ("gpu_flops",), 1e-9), Term(f"{t}_f1", t, "value", ("gpu_flops_rate",), 1e-9)]
    terms += [Term(f"b{i}", t, c, ev, BYTES_GB) for i, (t, c, ev, _) in enumerate(GPU_BANDWIDTH)]
    wide = summed(df.where(F.col("type").isin(*GPUS, "intel_gpu")), terms, keys)
    tries = [(f"{t}_f{j}", f"b{i}", axis) for i, (t, _, _, axis) in enumerate(GPU_BANDWIDTH) for j in (0, 1)]
    counts = wide.groupBy(F.col("jid").alias("_jid")).agg(*[F.count_if(F.col(f).isNotNull() & (F.col(b) > 0)).alias(f"_c{n}") for n, (f, b, _) in enumerate(tries)])
    d = wide.join(counts, F.col("jid").eqNullSafe(F.col("_jid")))
    pick = lambda i: reduce(lambda c, n: c.when(F.col(f"_c{n}") > 0, F.lit(tries[n][2]) if i == 2 else F.col(tries[n][i])), range(len(tries)), F)
    d = d.select(*keys, pick(0).alias("flops_gf"), pick(1).alias("bw_gb"), pick(2).alias("axis"))
    return _points(d, [*keys, "axis"])


def job_peaks(df: DataFrame) -> DataFrame:
    """(jid, peak_flops, peak_bw, ridge): reported peaks, memory of both kinds summed; else the nominal ones of the job's hardware."""
    at = lambda e, k: F.col(e) * k
    events = {"cpu_peak_fp64_flops_per_s": 1e-9, "cpu_peak_dram_bw_bytes_per_s": BYTES_GB, "cpu_peak_hbm_bw_bytes_per_s": BYTES_GB}
    own = summed(df.where(F.col("type") == PEAK_TYPE), [Term(e, PEAK_TYPE, "value", (e,), 1.0) for e in events], ["jid", "host", "time"])
    own = own.groupBy("jid").agg(*[F.max(at(e, k)).alias(x) for (e, k), x in zip(events.items(), ("f", "dram", "hbm"))])
    plus = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    own = own.select("jid", "f", (plus("dram") + plus("hbm")).alias("b")).where("f > 0 and b > 0")
    has = lambda *types: F.bool_or(F.col("type").isin(*types))
    order = [*IMC, *[t for t in PEAKS if t not in IMC]]
    rules = [(has(t), PEAKS[t]) for t in order] + [(has(*AMD_DF) & has("amd_x86_pmc", "host_cpu_hw"), AMD_PEAKS), (has("arm_aarch64_imc"), ARM_PEAKS)]
    nominal = df.groupBy("jid").agg(*[reduce(lambda c, r: c.when(r[0], r[1][i]), rules, F).alias(n) for i, n in enumerate(("nf", "nb"))])
    d = nominal.join(own, "jid", "left").select("jid", F.coalesce("f", "nf").alias("peak_flops"), F.coalesce("b", "nb").alias("peak_bw"))
    return d.where("peak_flops is not null").withColumn("ridge", F.col("peak_flops") / F.col("peak_bw"))


def device_peaks(df: DataFrame, axis: str | None = None) -> DataFrame:
    """The same of GPUs; the bandwidth of ``axis`` (memory_bw or the link), else the other one."""
    events = {"gpu_peak_fp64_flops_per_s": 1e-9, "gpu_peak_mem_bw_bytes_per_s": BYTES_GB, "gpu_peak_io_link_bw_bytes_per_s": BYTES_GB}
    own = summed(df.where(F.col("type") == PEAK_TYPE), [Term(e, PEAK_TYPE, "value", (e,), k) for e, k in events.items()], ["jid", "host", "time"])
    own = own.groupBy("jid").agg(*[F.max(e).alias(x) for e, x in zip(events, ("peak_flops", "mem", "link"))])
    bw = F.coalesce("mem", "link") if axis == "memory_bw" else F.coalesce("link", "mem")
    return own.select("jid", "peak_flops", bw.alias("peak_bw")).where("peak_flops > 0 and peak_bw > 0").withColumn("ridge", F.col("peak_flops") / F.col("peak_bw"))
