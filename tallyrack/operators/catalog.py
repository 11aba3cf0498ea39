"""Specifications of the metrics: types, events, factors and units.

Names are the canonical ones (see ``canonicalise_names``).  All of these are fixed values:
monitors and stored metrics use these very names.
"""

from __future__ import annotations

from typing import NamedTuple

BYTES_MB, BYTES_GB = 1 / 1024**2, 1 / 1024**3
CAS_GB = 64 / 1024**3  # a column access moves 64 bytes
#: Values from 2**47 on are marks of a blank gauge; no link moves more GB/s than this.
BLANK, MOST_GBPS = 2.0**47, 1.0e5

#: Fixed values.
CORE_PMC = ("intel_x86_pmc_gpr8", "intel_x86_pmc_gpr4")
IMC = ("intel_x86_uncore_imc_skx", "intel_x86_uncore_imc_bdw", "intel_x86_uncore_imc_hsw", "intel_x86_uncore_imc_ivb", "intel_x86_uncore_imc_snb")
AMD_DF = ("amd_x86_uncore_df_rome", "amd_x86_uncore_df_milan", "amd_x86_uncore_df_genoa", "amd_x86_uncore_df_turin")
GPUS = ("nvidia_gpu", "amd_gpu")
FP_DOUBLE = ("FP_ARITH_INST_RETIRED_SCALAR_DOUBLE", "FP_ARITH_INST_RETIRED_128B_PACKED_DOUBLE", "FP_ARITH_INST_RETIRED_256B_PACKED_DOUBLE", "FP_ARITH_INST_RETIRED_512B_PACKED_DOUBLE")
FP_SINGLE = ("FP_ARITH_INST_RETIRED_SCALAR_SINGLE", "FP_ARITH_INST_RETIRED_128B_PACKED_SINGLE", "FP_ARITH_INST_RETIRED_256B_PACKED_SINGLE", "FP_ARITH_INST_RETIRED_512B_PACKED_SINGLE")
SSE = (("SSE_DOUBLE_SCALAR", 1), ("SSE_DOUBLE_PACKED", 2), ("SIMD_DOUBLE_256", 4))
DRAM_CHANNELS = ("dram_chan0_bytes", "dram_chan1_bytes", "dram_chan2_bytes", "dram_chan3_bytes")
VFS_BYTES = ("vfs_read_bytes", "vfs_write_bytes")
NFS_BYTES = ("normal_read", "normal_write", "direct_read", "direct_write", "server_read", "server_write")
LLITE_OPS = (
    "vfs_open_ops", "vfs_close_ops", "vfs_mmap_ops", "vfs_fsync_ops", "vfs_setattr_ops", "vfs_truncate_ops", "vfs_flock_ops", "vfs_getattr_ops", "vfs_statfs_ops", "vfs_alloc_inode_ops",
    "vfs_setxattr_ops", "vfs_listxattr_ops", "vfs_removexattr_ops", "vfs_readdir_ops", "vfs_create_ops", "vfs_lookup_ops", "vfs_link_ops", "vfs_unlink_ops", "vfs_symlink_ops", "vfs_mkdir_ops",
    "vfs_rmdir_ops", "vfs_mknod_ops", "vfs_rename_ops",
)
BEEGFS_OPS = (
    "vfs_open_ops", "vfs_close_ops", "vfs_getattr_ops", "vfs_setattr_ops", "vfs_truncate_ops", "vfs_readdir_ops", "vfs_create_ops", "vfs_mkdir_ops", "vfs_rmdir_ops", "vfs_rename_ops",
    "vfs_unlink_ops", "vfs_link_ops", "vfs_statfs_ops",
)


class Part(NamedTuple):
    """One term of a metric.  The terms of a try are summed; the first try with a value (above 0 if ``positive``) counts."""

    metric: str
    attempt: int
    part: int
    type: str
    event: str
    factor: float
    gauge: bool = False  # means of ``value`` in place of sums of ``arc``
    nonnegative: bool = False
    most: float | None = None
    positive: bool = False


def _parts(metric: str, *tries, **options) -> list[Part]:
    """``tries``: each a list of (type, events, factor) terms."""
    return [Part(metric, i, j, t, e, k, **options) for i, terms in enumerate(tries) for j, (t, events, k) in enumerate(terms) for e in events]


FLOPS = (
    [[("amd_x86_pmc", ("fp_ops_retired",), 1e-9)]] + [[(t, FP_DOUBLE + FP_SINGLE, 1e-9)] for t in CORE_PMC]
    + [[(t, (e,), 1e-9 * w) for e, w in SSE] for t in CORE_PMC] + [[("host_cpu_hw", ("arm_est_flops",), 1e-9)]]
)
BANDWIDTH = (
    [[(t, DRAM_CHANNELS, BYTES_GB)] for t in AMD_DF]
    + [[(t, ("dram_cas_reads", "dram_cas_writes"), CAS_GB), (t, ("hbm_cas_reads", "hbm_cas_writes"), CAS_GB)] for t in IMC]
    + [[("arm_aarch64_imc", ("dram_cas_reads", "dram_cas_writes"), CAS_GB)], [("host_cpu_hw", ("arm_dram_bw_bytes",), BYTES_GB)]]
)
FABRIC = (
    [("host_ib", ("port_xmit_data", "port_rcv_data"), BYTES_MB)], [("host_opa", ("PortXmitData", "PortRcvData"), 1 / 125000)], [("host_net", ("rx_bytes", "tx_bytes"), BYTES_MB)],
)
GAUGES = ("tensor_active", "tensor_imma_active", "tensor_hmma_active", "tensor_dfma_active", "fp16_active", "fp32_active", "fp64_active")
#: avg_cpuusage and the two ratios follow from these (see ``simple_metrics``).
SIMPLE_PARTS = (
    _parts("avg_blockbw", [("host_block", ("rd_sectors", "wr_sectors"), BYTES_MB)], nonnegative=True)
    + _parts("avg_sharedfs_iops", [("lustre_llite", LLITE_OPS, 1.0), ("host_nfs", ("read_ops", "write_ops"), 1.0), ("beegfs_client", BEEGFS_OPS, 1.0)])
    + _parts("avg_sharedfs_bw", [("lustre_llite", VFS_BYTES, BYTES_MB), ("host_nfs", NFS_BYTES, BYTES_MB), ("beegfs_client", VFS_BYTES, BYTES_MB)])
    + _parts("avg_ibbw", *FABRIC, nonnegative=True)
    + [p for e in GAUGES for p in _parts(f"avg_{e}", *[[(t, (e,), 1.0)] for t in GPUS], gauge=True)]
    + _parts("avg_flops64b", *[[(t, FP_DOUBLE, 1e-9)] for t in CORE_PMC], [("host_cpu_hw", ("fp_arith_inst_retired_scalar_double",), 1e-9)], positive=True)
    + _parts("avg_flops32b", *[[(t, FP_SINGLE, 1e-9)] for t in CORE_PMC], [("host_cpu_hw", ("fp_arith_inst_retired_scalar_single",), 1e-9)], positive=True)
    + _parts("avg_arm_int8_ops", [("host_cpu_hw", ("arm_int8_ops",), 1e-9)]) + _parts("avg_arm_int16_ops", [("host_cpu_hw", ("arm_int16_ops",), 1e-9)])
    + _parts("avg_gpu_mem_bw_gbps", *[[(t, ("gpu_mem_bw_bytes_rate",), 1e-9)] for t in GPUS], gauge=True, most=MOST_GBPS)
    + _parts("avg_flops", *FLOPS) + _parts("avg_mbw", *BANDWIDTH)
)
CPU_TYPE, CPU_BUSY, CPU_IDLE = "host_cpu", ("user", "system", "nice"), ("idle", "iowait", "irq", "softirq")

#: Type and unit of each metric of every job.
SIMPLE = {
    "avg_blockbw": ("host_block", "GB/s"), "avg_cpuusage": ("host_cpu", "#cores"), "avg_sharedfs_iops": ("lustre_llite", "iops"), "avg_sharedfs_bw": ("lustre_llite", "MB/s"),
    "avg_ibbw": ("host_ib", "MB/s"), "avg_fabric_mb_per_gflops": ("host_ib", "MB/GF"), "avg_tensor_active": ("nvidia_gpu", "%"), "avg_tensor_imma_active": ("nvidia_gpu", "%"),
    "avg_tensor_hmma_active": ("nvidia_gpu", "%"), "avg_tensor_dfma_active": ("nvidia_gpu", "%"), "avg_fp16_active": ("nvidia_gpu", "%"), "avg_fp32_active": ("nvidia_gpu", "%"),
    "avg_fp64_active": ("nvidia_gpu", "%"), "avg_flops64b": ("pmc", "GF"), "avg_flops32b": ("pmc", "GF"), "avg_arm_int8_ops": ("host_cpu_hw", "Gops"), "avg_arm_int16_ops": ("host_cpu_hw", "Gops"),
    "avg_gpu_mem_bw_gbps": ("nvidia_gpu", "GB/s"), "avg_fabric_mb_per_avg_tensor": ("host_ib", "MB/s"), "avg_flops": ("amd_x86_pmc", "GF"), "avg_mbw": ("amd_x86_uncore_df", "GB/s"),
}
COMPLEX = {
    "avg_freq": ("pmc", "GHz"), "avg_ethbw": ("net", "MB/s"), "avg_packetsize": ("host_ib", "MB"), "max_fabricbw": ("host_ib", "MB/s"), "max_lnetbw": ("host_lnet", "MB/s"),
    "max_mds": ("lustre_llite", "iops"), "max_packetrate": ("host_ib", "#/s"), "max_opa_congestion_rate": ("host_opa", "#/s"), "max_numa_remote_rate": ("host_numa", "#/s"),
    "max_gpu_power": ("nvidia_gpu", "W"), "max_node_power_est_w": ("job", "W"), "avg_node_power_est_w": ("job", "W"), "job_cpu_gpu_watt_hours": ("job", "Wh"),
    "max_gpu_link_gbps": ("nvidia_gpu", "GB/s"), "max_gpu_clock_event_reasons": ("nvidia_gpu", "#"), "mem_hwm": ("host_mem", "GiB"), "node_imbalance": ("host_cpu", "%"),
    "time_imbalance": ("host_cpu", "%"), "flops_node_imbalance": ("pmc", "%"), "fabric_node_imbalance": ("host_ib", "%"), "dram_bw_node_imbalance": ("imc", "%"),
    "lnet_node_imbalance": ("lnet", "%"), "gpu_util_node_imbalance": ("nvidia_gpu", "%"), "tensor_node_imbalance": ("nvidia_gpu", "%"), "vecpercent_64b": ("pmc", "%"),
    "avg_vector_width_64b": ("pmc", "#"), "vecpercent_32b": ("pmc", "%"), "avg_vector_width_32b": ("pmc", "#"),
}
DETAIL = {"detail_gpu_active": "count", "detail_gpu_util_max": "%", "detail_gpu_util_mean": "%", "detail_gpu_count": "count", "avg_gpuutil": "%"}
FILES = {f"detail_fsio_{f}_{k}": u for f in ("llite", "nfs", "beegfs") for k, u in (("read_mb", "MB"), ("write_mb", "MB"), ("peak_mb_s", "MB/s"), ("peak_iops", "#/s"))}
CATALOG = {k: u for k, (_, u) in (SIMPLE | COMPLEX).items()} | DETAIL | FILES
#: Why a metric of a job has no value.
NO_SERIES, NO_SAMPLES, NOT_COMPUTED = "No time-series telemetry for this job", "No host_data samples for this metric in the job window", "Metric not computed"
INSUFFICIENT = "Insufficient Data For Metrics Processing"
NO_GPU = "No usable GPU aggregate telemetry for job detail"
NO_VALUE = {
    "avg_freq": "No usable PMC telemetry for average CPU frequency", "avg_ethbw": "No usable network telemetry for average Ethernet bandwidth", "avg_gpuutil": "No usable GPU utilization telemetry",
    "avg_packetsize": "No usable InfiniBand/OPA telemetry for packet size", "max_fabricbw": "No usable fabric telemetry for peak bandwidth", "max_lnetbw": "No usable LNET telemetry for peak bandwidth",
    "max_mds": "No usable Lustre/NFS/BeeGFS telemetry for metadata/operation rate", "max_packetrate": "No usable fabric telemetry for peak packet rate", "max_opa_congestion_rate": "No usable OPA congestion telemetry",
    "max_numa_remote_rate": "No usable NUMA remote-access telemetry", "flops_node_imbalance": "No usable FLOPs telemetry for node imbalance", "fabric_node_imbalance": "No usable fabric telemetry for node imbalance",
    "dram_bw_node_imbalance": "No usable DRAM bandwidth telemetry for node imbalance", "lnet_node_imbalance": "No usable LNET byte telemetry for node imbalance", "max_gpu_power": "No usable GPU power telemetry",
    "max_node_power_est_w": "No usable node power estimate telemetry", "avg_node_power_est_w": "No usable node power estimate telemetry", "job_cpu_gpu_watt_hours": "No usable CPU power estimate for job energy (watt-hours)",
    "max_gpu_link_gbps": "No usable GPU PCIe/NVLink byte telemetry", "max_gpu_clock_event_reasons": "No usable GPU clock event reason telemetry", "gpu_util_node_imbalance": "No usable GPU utilization telemetry for imbalance",
    "tensor_node_imbalance": "No usable GPU tensor telemetry for imbalance", "mem_hwm": "No usable memory telemetry for high-water mark", "node_imbalance": "No usable CPU telemetry for node imbalance",
    "time_imbalance": "No usable CPU telemetry for time imbalance", "vecpercent_64b": "No usable PMC telemetry for 64b vector FLOP mix", "avg_vector_width_64b": "No usable PMC telemetry for 64b vector width",
    "vecpercent_32b": "No usable PMC telemetry for 32b vector FLOP mix", "avg_vector_width_32b": "No usable PMC telemetry for 32b vector width",
}
#: File systems of a job: type, read, written and operation counters, then why there are no bytes, no peak of bytes, no peak of operations.
FILE_SYSTEMS = {
    "llite": (
        "lustre_llite", ("vfs_read_bytes",), ("vfs_write_bytes",), LLITE_OPS, "No Lustre llite read/write byte deltas for this job",
        "No Lustre llite byte counter time series for peak MB/s", "No Lustre llite metadata operation time series for peak IOPS",
    ),
    "nfs": (
        "host_nfs", ("normal_read", "direct_read", "server_read"), ("normal_write", "direct_write", "server_write"), ("read_ops", "write_ops"), "No NFS client byte deltas for this job",
        "No NFS client byte counter time series for peak MB/s", "No NFS READ/WRITE op time series for peak IOPS",
    ),
    "beegfs": (
        "beegfs_client", ("vfs_read_bytes",), ("vfs_write_bytes",), BEEGFS_OPS, "No BeeGFS client read/write byte deltas for this job",
        "No BeeGFS client byte counter time series for peak MB/s", "No BeeGFS client metadata operation time series for peak IOPS",
    ),
}
FILE_ROWS = (("read_mb", "MB"), ("write_mb", "MB"), ("peak_mb_s", "MB/s"), ("peak_iops", "#/s"))
#: All rows of a job in order: metric, type, units, why it is missing though the job has samples, whether it needs a time series.
ROWS = (
    [(m, t, u, NO_SAMPLES, True) for m, (t, u) in SIMPLE.items()] + [(m, t, u, NO_VALUE[m], True) for m, (t, u) in COMPLEX.items()]
    + [(m, "gpu", u, NO_VALUE.get(m, NO_GPU), False) for m, u in DETAIL.items()] + [(f"detail_fsio_{f}_{k}", f, u, None, False) for f in FILE_SYSTEMS for k, u in FILE_ROWS]
)
