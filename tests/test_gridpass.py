"""The 28 grid metrics and the reasons of missing ones, against plain arithmetic on small jobs."""

import math
from datetime import datetime, timedelta

import pytest

from tallyrack.operators import catalog as K
from tallyrack.operators import gridpass as G
from tallyrack.operators import metrics as M

SCHEMA = "jid string, host string, dev string, time timestamp, type string, event string, value double, arc double"
T0 = datetime(2024, 1, 1)


def at(i):
    return T0 + timedelta(seconds=300 * i)


def row(host, i, type_, event, value, arc=None, dev="0", jid="a"):
    return (jid, host, dev, at(i), type_, event, None if value is None else float(value), None if arc is None else float(arc))


def run(spark, rows):
    out = G.complex_metrics(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.jid, r.metric): (r.type, r.value) for r in out}


def near(got, type_, value):
    assert got[0] == type_ and math.isclose(got[1], value, rel_tol=1e-12), (got, value)


USER = {"x": [0, 300, 900, 1200, 1500, 1500], "y": [0, 600, 1200, 1800, 2400, 3000]}


def test_rates_and_imbalance(spark):
    """Devices are averaged; a host that lacks a time has no rate on either side of it; idle intervals count in time."""
    rows = [row(h, i, "host_cpu", "user", v + d, dev=str(d)) for h, vs in USER.items() for i, v in enumerate(vs) for d in (-1, 1) if (h, i) != ("x", 4)]
    got = run(spark, rows)
    ry = [2.0] * 5
    rx = [1.0, 2.0, 1.0, None, None]
    worst = sum((b - a) / b for a, b in zip(rx, ry) if a is not None) / 3
    near(got["a", "node_imbalance"], "host_cpu", 100 * worst)

    def least(rate):
        rate = [max(r or 0.0, 0.0) for r in rate]
        mid = [150 + 300 * i for i in range(len(rate))]
        seg = [(a + b) / 2 * 300 for a, b in zip(rate, rate[1:])]
        out = []
        for i in range(2, len(rate) - 1):
            before = sum(seg[: i - 1]) / (mid[i] - mid[0])
            if before > 0:
                out.append(sum(seg[i:]) / (mid[-1] - mid[i]) / before)
        return min(out)

    near(got["a", "time_imbalance"], "host_cpu", 100 * min(least(rx), least(ry)))
    assert set(got) == {("a", "node_imbalance"), ("a", "time_imbalance")}


def test_peaks_prefer_arc_and_stay_sane(spark):
    """The rate that came with the samples counts first; insane packet rates are left out, an insane fabric rate leaves none."""
    rows = []
    for h, k in (("x", 1), ("y", 3)):
        for i in range(4):
            rows += [row(h, i, "host_ib", "port_xmit_data", i * k * 300 * 1024**2, 50 * 1024**2 * k * i), row(h, i, "host_ib", "port_rcv_data", 0, 0)]
            rows += [row(h, i, "host_ib", "port_xmit_pkts", i * 30 * k if i < 3 else 2**63), row(h, i, "host_ib", "port_rcv_pkts", 0)]
            rows += [row(h, i, "host_lnet", "tx_bytes", i * 300 * 1024**2 * k), row(h, i, "host_lnet", "rx_bytes", 0)] if (h, i) != ("y", 2) else []
    got = run(spark, rows)
    near(got["a", "max_fabricbw"], "host_ib", 300.0)  # mean over hosts of 150 and 450
    near(got["a", "max_packetrate"], "host_ib", 0.2)
    near(got["a", "max_lnetbw"], "host_lnet", 4.0)  # means over hosts: 0, 2, 2, 6 times 300 MiB
    near(got["a", "fabric_node_imbalance"], "host_ib", 100 * 2 / 3)
    near(got["a", "lnet_node_imbalance"], "host_lnet", 100 * (2 / 3) / 3)  # x is behind in the one interval that y has
    big = [row("x", i, "host_opa", e, i * 1e15) for i in range(3) for e in ("PortXmitData", "PortRcvData")]
    assert ("a", "max_fabricbw") not in run(spark, big)


def test_first_to_last(spark):
    """Gains from the first to the last time of the job; a host that lacks one is left out, negative bytes too."""
    rows = []
    for h, (a, m) in {"x": (3e6, 2e6), "y": (1e6, 1e6)}.items():
        for i in (0, 2):
            rows += [row(h, i, "amd_x86_pmc", "aperf", a * i), row(h, i, "amd_x86_pmc", "mperf", m * i)]
    rows += [row("z", 0, "amd_x86_pmc", "aperf", 9e9), row("z", 1, "amd_x86_pmc", "aperf", 9e9), row("z", 2, "amd_x86_pmc", "mperf", 1)]
    rows += [row("x", i, "host_net", e, v) for i, pair in ((0, (0, 0)), (2, (600 * 1024**2, 1200 * 1024**2))) for e, v in zip(("rx_bytes", "tx_bytes"), pair)]
    rows += [row("y", i, "host_net", e, v) for i, v in ((0, 5), (2, 1)) for e in ("rx_bytes", "tx_bytes")]
    rows += [row(h, i, "host_ib", e, v * i * k) for h, k in (("x", 1), ("y", 2)) for i in (0, 2) for e, v in (("port_xmit_data", 1024**2), ("port_rcv_data", 1024**2), ("port_xmit_pkts", 2), ("port_rcv_pkts", 2 * k))]
    got = run(spark, rows)
    near(got["a", "avg_freq"], "amd_x86_pmc", 2.7 * (1.5 + 1.0) / 2)
    near(got["a", "avg_ethbw"], "host_net", 3.0)
    near(got["a", "avg_packetsize"], "host_ib", (2 / 4 + 4 / 12) / 2)


def test_vector_mix(spark):
    """Percent over all hosts together, width as a mean of hosts; the first type of counters decides."""
    ev = dict(zip(K.FP_DOUBLE, (1, 2, 4, 8)))
    n = {"x": (10, 0, 5, 0), "y": (0, 4, 0, 2)}
    rows = [row(h, i, "intel_x86_pmc_gpr8", e, c * i) for h, cs in n.items() for e, c in zip(ev, cs) for i in (0, 1)] + [row("x", i, "intel_x86_pmc_gpr4", "SSE_DOUBLE_SCALAR", 7 * i) for i in (0, 1)]
    got = run(spark, rows)
    vec, flops = 5 * 4 + 4 * 2 + 2 * 8, 10 + 5 * 4 + 4 * 2 + 2 * 8
    near(got["a", "vecpercent_64b"], "intel_x86_pmc_gpr8", 100 * vec / flops)
    near(got["a", "avg_vector_width_64b"], "intel_x86_pmc_gpr8", ((10 + 20) / 15 + (8 + 16) / 6) / 2)
    assert ("a", "vecpercent_32b") not in got


def test_gauges_and_power(spark):
    """The first vendor above 0; blanks are none; watt hours need a CPU source, module power comes first where it is above 0."""
    rows = [row("x", i, "nvidia_gpu", "power_usage", v) for i, v in enumerate((0, 2.0**47, 0))] + [row("x", i, "amd_gpu", "power_usage", 100 + i) for i in range(3)] + [row("x", 1, "amd_gpu", "clocks_event_reasons", 4), row("x", 2, "amd_gpu", "clocks_event_reasons", 3)]
    rows += [row("x", i, "host_mem", e, v) for i in range(2) for e, v in (("mem_used", 5 * 1024**2), ("slab", 1024**2), ("file_pages", i * 1024**2))]
    rows += [row("x", i, "intel_x86_rapl", "pkg_energy", 0, 1e6) for i in range(3)] + [row("y", i, "nvidia_gpu", "module_power_usage", 50) for i in (0, 2)]
    got = run(spark, rows)
    near(got["a", "max_gpu_power"], "amd_gpu", 102.0)
    near(got["a", "max_gpu_clock_event_reasons"], "amd_gpu", 4.0)
    near(got["a", "mem_hwm"], "host_mem", 4.0)
    cpu = 1e6 * G.RAPL
    x = [cpu + 0, cpu + 2.0**47, cpu + 0]
    near(got["a", "max_node_power_est_w"], "job", max(x))
    near(got["a", "avg_node_power_est_w"], "job", (sum(x) + 100) / 5)
    near(got["a", "job_cpu_gpu_watt_hours"], "job", ((x[0] + x[1]) / 2 + (x[1] + x[2]) / 2) * 300 / 3600 + 50 * 600 / 3600)
    assert ("a", "job_cpu_gpu_watt_hours") not in run(spark, [r for r in rows if r[4] != "intel_x86_rapl"])


@pytest.fixture(scope="module")
def filled(spark):
    jobs = spark.createDataFrame([("a", at(0), at(4)), ("late", at(0), at(40)), ("bare", at(0), at(4)), ("new", at(0), at(4))], "jid string, start_time timestamp, end_time timestamp")
    rows = [row("x", i, "host_cpu", "user", 10 * i, 1, jid=j) for i in range(5) for j in ("a", "late", "new")] + [row("x", i, "lustre_llite", "vfs_read_bytes", 0, None, jid="a") for i in range(5)]
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, SCHEMA).withColumns({"delta": F.lit(1024.0**2), "ncores": F.lit(4), "nhosts": F.lit(1)})
    return {(r.jid, r.metric): r for r in G.job_metrics(jobs, d, jobs.where("jid <> 'new'")).collect()}


def test_every_row_has_a_value_or_a_reason(filled):
    assert len(K.ROWS) == 66 and len(filled) == 4 * 66
    assert all((r.value is None) != (r.no_data_reason is None) for r in filled.values())


def test_reasons(filled):
    reason = lambda j, m: filled[j, m].no_data_reason
    assert {r.no_data_reason for (j, _), r in filled.items() if j == "late"} == {K.INSUFFICIENT}
    assert {r.no_data_reason for (j, _), r in filled.items() if j == "new"} == {K.NOT_COMPUTED}
    assert reason("bare", "avg_cpuusage") == reason("bare", "max_mds") == K.NO_SERIES
    assert reason("bare", "detail_gpu_count") == K.NO_GPU and reason("bare", "avg_gpuutil") == K.NO_VALUE["avg_gpuutil"]
    assert reason("bare", "detail_fsio_nfs_peak_iops") == K.FILE_SYSTEMS["nfs"][4]
    assert filled["a", "avg_cpuusage"].value is not None and filled["a", "node_imbalance"].value == 0.0
    assert reason("a", "avg_blockbw") == K.NO_SAMPLES and reason("a", "avg_freq") == K.NO_VALUE["avg_freq"]
    assert (filled["a", "detail_fsio_llite_read_mb"].value, filled["a", "detail_fsio_llite_write_mb"].value) == (5.0, 0.0)
    assert reason("a", "detail_fsio_llite_peak_mb_s") == K.FILE_SYSTEMS["llite"][5] and reason("a", "detail_fsio_llite_peak_iops") == K.FILE_SYSTEMS["llite"][6]


def test_display_hides_a_repeated_mean(spark):
    rows = [("a", "avg_gpuutil", "gpu", "%", 5.0, None, 0), ("a", "detail_gpu_util_mean", "gpu", "%", 5.0 + 1e-12, None, 1), ("b", "avg_gpuutil", "gpu", "%", 5.0, None, 0), ("b", "x", "gpu", "%", None, K.NOT_COMPUTED, 2), ("b", "y", "gpu", "%", None, "why", 3)]
    d = spark.createDataFrame(rows, "jid string, metric string, type string, units string, value double, no_data_reason string, ord int")
    assert [(r.jid, r.metric, r.tier) for r in M.display_order(d).collect()] == [("a", "detail_gpu_util_mean", 0), ("b", "avg_gpuutil", 0), ("b", "y", 1), ("b", "x", 2)]
