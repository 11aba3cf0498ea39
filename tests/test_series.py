"""Series and rooflines of small jobs, by the sources that each job has."""

from datetime import datetime, timedelta

import pytest

from tallyrack.operators import series as S
from tallyrack.operators.catalog import BYTES_GB, CAS_GB

START = datetime(2024, 1, 1)
SCHEMA = "jid string, host string, dev string, time timestamp, type string, event string, value double, arc double"


def frame(spark, *rows):
    """Rows of (jid, minute, type, event, value and rate[, host[, dev]])."""
    full = [(j, h[0] if h else "n1", h[1] if len(h) > 1 else "0", START + timedelta(minutes=m), t, e, v, v) for j, m, t, e, v, *h in rows]
    return spark.createDataFrame(full, SCHEMA)


def by_minute(d, *names):
    return {(r.jid, (r.time - START).seconds // 60): tuple(r[n] for n in names) for r in d.collect()}


def test_first_source_without_a_gap_and_whole_series(spark):
    p8, p4, sse = "intel_x86_pmc_gpr8", "intel_x86_pmc_gpr4", "FP_ARITH_INST_RETIRED_SCALAR_DOUBLE"
    d = frame(
        spark, ("a", 0, p8, sse, 1e9), ("a", 0, p4, sse, 2e9), ("a", 5, p4, sse, 3e9), ("a", 0, "host_mem", "mem_used", 2.0**20), ("a", 5, "host_mem", "mem_used", 2.0**21),
        ("b", 0, p8, sse, 5e9), ("b", 0, "host_cpu", "user", 100.0), ("b", 5, "x", "y", 1.0), ("c", 0, p4, sse, None),
    )
    got = by_minute(S.job_series(d), "flops64b", "mem", "cpu")
    assert got == {("a", 0): (2.0, 1.0, None), ("a", 5): (3.0, 2.0, None), ("b", 0): (None, None, None), ("b", 5): (None, None, None), ("c", 0): (None, None, None)}


def test_derived_series(spark):
    g = "nvidia_gpu"
    d = frame(
        spark, ("a", 0, "intel_x86_pmc_gpr8", "aperf", 10.0), ("a", 0, "intel_x86_pmc_gpr8", "mperf", 5.0), ("a", 0, "host_opa", "PortXmitData", 125000.0), ("a", 0, g, "tensor_active", 7.0),
        ("a", 0, g, "utilization", 30.0), ("a", 0, g, "utilization", 40.0, "n1", "1"), ("a", 0, g, "power_usage", 9.0), ("a", 0, "host_cpu_hw", "dcgm_cpu_power_util_w", 4.0),
        ("b", 0, "host_ib", "port_rcv_data", 2.0**20), ("b", 0, "host_opa", "PortXmitData", 125000.0), ("b", 0, g, "tensor_active", 7.0), ("b", 0, g, "tensor_hmma_active", 3.0),
        ("b", 0, g, "gpu_util", 5.0), ("b", 0, g, "utilization", 30.0), ("b", 0, g, "module_power_usage", 50.0), ("b", 0, g, "power_usage", 9.0), ("b", 0, g, "gpu_io_link_total_bytes", 1e30),
        ("b", 0, "intel_x86_uncore_imc_skx", "dram_cas_reads", 1 / CAS_GB), ("b", 0, "intel_x86_uncore_imc_skx", "hbm_cas_reads", 2 / CAS_GB),
    )
    got = by_minute(S.job_series(d), "freq", "ibbw", "nv_tensor_active", "nv_gpu_util", "node_power_est_w", "nv_gpu_link_gbs", "mbw")
    assert got["a", 0] == pytest.approx((5.4, 1.0, 7.0, 70.0, 13.0, None, None))
    assert got["b", 0] == pytest.approx((None, 1.0, None, 5.0, 50.0, None, 3.0))


def test_number_of_series(spark):
    assert len(S.job_series(frame(spark, ("a", 0, "x", "y", 1.0))).columns) - 3 == 47 + 1  # 38 of one source, 7 of FIRST, CHA, frequency and power
    assert sum(map(len, S.ERRORS.values())) == 25
    assert S.job_series(frame(spark, ("a", 0, "x", "y", 1.0)).limit(0)).count() == 0


def test_errors_of_a_job_stay_if_any_is_not_zero(spark):
    d = frame(spark, ("a", 0, "host_ib", "symbol_error", 0.0), ("a", 5, "host_ib", "symbol_error", 2.0), ("a", 5, "host_ib", "symbol_error", 1.0, "n1", "1"), ("b", 0, "host_ib", "symbol_error", 0.0), ("a", 0, "host_net", "rx_errors", None), ("a", 0, "x", "rx_errors", 1.0))
    assert by_minute(S.hardware_errors(d), "event", "rate") == {("a", 0): ("symbol_error", 0.0), ("a", 5): ("symbol_error", 3.0)}


def test_roofline_takes_the_sources_of_one_vendor(spark):
    amd, df, imc = "amd_x86_pmc", "amd_x86_uncore_df_rome", "intel_x86_uncore_imc_skx"
    d = frame(
        spark, ("a", 0, amd, "fp_ops_retired", 4e9), ("a", 0, df, "dram_chan0_bytes", 2 / BYTES_GB), ("a", 0, imc, "dram_cas_reads", 1 / CAS_GB), ("a", 5, amd, "fp_ops_retired", 4e9),
        ("b", 0, amd, "fp_ops_retired", 9e9), ("b", 0, "intel_x86_pmc_gpr4", "SSE_DOUBLE_PACKED", 3e9), ("b", 0, imc, "dram_cas_reads", 1 / CAS_GB), ("b", 0, imc, "hbm_cas_writes", 1 / CAS_GB),
        ("c", 0, "host_cpu_hw", "arm_est_flops", 1e9), ("c", 0, "host_cpu_hw", "arm_dram_bw_bytes", 4 / BYTES_GB), ("d", 0, amd, "fp_ops_retired", 1e9),
        ("b", 5, "intel_x86_pmc_gpr8", "SSE_DOUBLE_SCALAR", 3e9), ("b", 10, "intel_x86_pmc_gpr4", "SSE_DOUBLE_PACKED", 3e9), ("b", 10, imc, "dram_cas_reads", 1 / CAS_GB), ("b", 5, imc, "dram_cas_reads", 1 / CAS_GB),
    )
    got = by_minute(S.job_roofline(d), "flops_gf", "bw_gb", "ai")
    assert set(got) == {("a", 0), ("b", 5), ("c", 0)}  # b's other points are of a later source
    assert got["a", 0] == pytest.approx((4, 2, 2)) and got["b", 5] == pytest.approx((3, 1, 3)) and got["c", 0] == pytest.approx((1, 4, 0.25))


def test_device_roofline_falls_back_to_links(spark):
    n = "nvidia_gpu"
    d = frame(
        spark, ("a", 0, n, "gpu_flops", 2e9), ("a", 0, n, "gpu_mem_bw_bytes_rate", 1 / BYTES_GB), ("a", 0, n, "gpu_io_link_total_bytes", 8 / BYTES_GB), ("a", 0, n, "gpu_flops", 2e9, "n1", "1"),
        ("b", 0, n, "gpu_flops_rate", 2e9), ("b", 0, n, "gpu_mem_bw_bytes_rate", 0.0), ("b", 0, n, "gpu_pcie_tx_bytes", 1 / BYTES_GB), ("b", 0, n, "gpu_nvlink_rx_bytes", 3 / BYTES_GB),
    )
    got = {(r.jid, r.dev): (r.flops_gf, r.bw_gb, r.axis) for r in S.device_roofline(d).collect()}
    assert set(got) == {("a", "0"), ("b", "0")}
    assert got["a", "0"] == (pytest.approx(2), pytest.approx(1), "memory_bw") and got["b", "0"] == (pytest.approx(2), pytest.approx(4), "pcie_nvlink")


def test_peaks_reported_or_nominal(spark):
    p = S.PEAK_TYPE
    d = frame(
        spark, ("a", 0, p, "cpu_peak_fp64_flops_per_s", 5e9), ("a", 0, p, "cpu_peak_dram_bw_bytes_per_s", 1 / BYTES_GB), ("a", 0, p, "cpu_peak_hbm_bw_bytes_per_s", 4 / BYTES_GB), ("a", 0, "intel_x86_uncore_imc_skx", "x", 1.0),
        ("b", 0, "intel_x86_uncore_imc_skx", "x", 1.0), ("b", 0, p, "cpu_peak_fp64_flops_per_s", 5e9), ("c", 0, "amd_x86_uncore_df_rome", "x", 1.0), ("c", 0, "host_cpu_hw", "x", 1.0),
        ("d", 0, "amd_x86_uncore_df_rome", "x", 1.0), ("e", 0, "arm_aarch64_imc", "x", 1.0), ("f", 0, p, "gpu_peak_fp64_flops_per_s", 6e9), ("f", 0, p, "gpu_peak_mem_bw_bytes_per_s", 3 / BYTES_GB), ("f", 0, p, "gpu_peak_io_link_bw_bytes_per_s", 2 / BYTES_GB),
    )
    got = {r.jid: (r.peak_flops, r.peak_bw) for r in S.job_peaks(d).collect()}
    assert got == {"a": pytest.approx((5, 5)), "b": S.PEAKS["intel_x86_uncore_imc_skx"], "c": S.AMD_PEAKS, "e": S.ARM_PEAKS}
    assert [S.device_peaks(d, a).first()[2] for a in ("memory_bw", None)] == pytest.approx([3, 2])


def test_series_use_no_window(spark):
    plan = S.job_series(frame(spark, ("a", 0, "x", "y", 1.0)))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan
