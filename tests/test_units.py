"""Host lists, thinning, gates, series with gaps, findings and split monitor files on small inputs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyrack.functions import hostlists
from tallyrack.operators import aggregates as A
from tallyrack.operators import catalog as K
from tallyrack.operators import joins
from tallyrack.operators import readiness as R
from tallyrack.operators import windows as W
from tallyrack.sources import monitor

T0 = datetime(2024, 1, 1)
LISTS = {
    "r[1-2]n[01-03]": ["r1n01", "r1n02", "r1n03", "r2n01", "r2n02", "r2n03"], "c[001-003,007],d9": ["c001", "c002", "c003", "c007", "d9"], "a": ["a"], "": [], None: [],
    "x[1,3]y[8-9]-ib,z[09-11]": ["x1y8-ib", "x1y9-ib", "x3y8-ib", "x3y9-ib", "z09", "z10", "z11"], "p[1-2][3-4]": ["p13", "p14", "p23", "p24"], "q[1-1]": ["q1"],
}


def test_host_lists(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(LISTS)], "i int, nodes string")
    got = hostlists.expanded(d, "nodes").groupBy("i").agg(F.sort_array(F.collect_list("host")).alias("h")).collect()
    assert {r.i: r.h for r in got} == {i: sorted(v) for i, v in enumerate(LISTS.values()) if v}
    arrays = {r.nodes: r.host_list for r in hostlists.with_host_list(d, "nodes").collect()}
    assert {k: [x for x in v if x] for k, v in arrays.items()} == LISTS
    assert list(hostlists.names("b[3-1],e[x],open[1")) == ["ex", "open[1"]


@pytest.mark.parametrize("n,tiles", [(0, 3), (1, 3), (3, 3), (7, 3), (8, 3), (9, 3), (5, 1), (4, 9)])
def test_kept_times_are_the_last_of_ntile(spark, n, tiles):
    times = spark.createDataFrame([("a", T0 + timedelta(hours=i)) for i in range(n)] * 2, "jid string, time timestamp")
    got = [r.time for r in W.kept_times(times, spark.createDataFrame([("a", tiles), ("b", None)], "jid string, buckets long")).orderBy("time").collect()]
    want = [r.time for r in W.thinned_tiles(times, tiles).orderBy("time").collect()] if n else []
    assert got == want


def test_thinned_samples_keep_all_hosts_of_kept_times(spark):
    rows = [(j, h, T0 + timedelta(minutes=i), float(i)) for j, n in (("big", 50), ("small", 3)) for i in range(n) for h in "xy"]
    s = spark.createDataFrame(rows, "jid string, host string, time timestamp, value double")
    jobs = spark.createDataFrame([("big", 2, 60.0), ("small", 2, 60.0)], "jid string, nhosts int, runtime double")
    got = W.thinned_samples(s, jobs, max_rows=20, budget=20, least=2).collect()
    big = {(r.host, r.value) for r in got if r.jid == "big"}
    assert big == {(h, float(i)) for h in "xy" for i in range(4, 50, 5)} and sum(r.jid == "small" for r in got) == 6


def test_listing_gates(spark):
    rows = [("full", 1.0, None), ("full", None, "why"), ("stale", 1.0, None), ("stale", None, None), ("blank", 1.0, None), ("blank", None, ""), ("gate", 1.0, None), ("gate", None, K.INSUFFICIENT), ("short", 1.0, None)]
    m = spark.createDataFrame(rows, "jid string, value double, no_data_reason string")
    jobs = spark.createDataFrame([(j,) for j in ("full", "stale", "blank", "gate", "short", "none")], "jid string")
    got = {r.jid: (r.rows, r.stale, r.gate) for r in R.listing_gates(jobs, m, 2).collect()}
    assert got == {"stale": (2, 1, False), "blank": (2, 1, False), "gate": (2, 0, True), "short": (1, 0, False), "none": (0, 0, False)}


def test_a_gap_of_one_job_leaves_the_others(spark):
    rows = [(j, i, t, "e", 1.0) for j in "ab" for i in range(3) for t in ("p", "q") if (j, i, t) != ("a", 1, "q")]
    d = spark.createDataFrame(rows, "jid string, time int, type string, event string, value double")
    got = joins.series_on_grid(d, {"p": ("p", ["e"]), "q": ("q", ["e"]), "s": ("q", ["e"])}, ["jid", "time"], frozenset("s")).orderBy("jid", "time").collect()
    assert [r.q for r in got] == [None] * 3 + [1.0] * 3 and [r.p for r in got] == [1.0] * 6 and [r.s for r in got] == [1.0, None, 1.0, 1.0, 1.0, 1.0]


def test_findings_caps_and_verdict(spark):
    health = spark.createDataFrame([("cpu", f"e{i}", 5, False) for i in range(3)] + [("ib", f"e{i:02}", 5, False) for i in range(60)] + [("mem", "used", 9, True)], "type string, event string, row_count long, has_nonzero boolean")
    core = spark.createDataFrame([("cpu",), ("mem",), ("net",)], "type string")
    hosts, known = spark.createDataFrame([("n1",), ("n2",)], "host string"), spark.createDataFrame([("n1",), (None,)], "host string")
    f = A.telemetry_findings(health, core, hosts, known, {"all_zero_core_event": 2, "all_zero_other_event": 50})
    count = {k: (n, t) for k, n, t in f.groupBy("kind").agg(F.count("kind"), F.max("total")).collect()}
    assert count == {"all_zero_core_event": (2, 3), "all_zero_other_event": (50, 60), "missing_core_type": (1, 1), "signature_absent": (1, 1)}
    assert f.where("kind = 'signature_absent'").first().host == "n2"
    assert not A.telemetry_verdict(f, health).first().healthy
    idle = health.where("type <> 'cpu'")
    assert A.telemetry_verdict(A.telemetry_findings(idle, core.where("type = 'mem'"), hosts, known), idle).first().healthy
    assert not A.telemetry_verdict(A.telemetry_findings(health.limit(0), core.limit(0)), health.limit(0)).first().healthy


def plain_samples(text):
    """The monitor protocol line by line: (host, seconds, type, dev, event, value)."""
    out, head, schema = [], None, {}
    for line in text.split("\n"):
        t = line.split()
        if not t or t[0].startswith("$"):
            continue
        if t[0].startswith("!"):
            schema[t[0][1:]] = [x.split(",")[0] for x in t[1:]]
        elif len(t) == 3 and t[0].replace(".", "").isdigit():
            head = t
        elif head and t[0] in schema and len(t) - 2 == len(schema[t[0]]):
            out += [(head[2], float(head[0]), t[0], t[1], e, float(v)) for e, v in zip(schema[t[0]], t[2:])]
    return sorted(out)


@pytest.mark.parametrize("split", ["128m", "3k", "200b"])
def test_monitor_files_in_blocks(spark, tmp_path, split):
    """A file of many splits gives what it gives whole; schemas change on the way and samples go across splits."""
    rng, text = random.Random(3), "$version 1\n!blk rd,E wr\n"
    for i in range(120):
        text += f"\n{1700000000 + i}.5 {i % 4} n{i // 50}\n" + "".join(f"blk s{k} {rng.randrange(99)} {rng.randrange(99)}\n" for k in range(rng.randrange(6))) + f"gpu 0 {i}\n"
        text += {30: "!gpu util\n", 70: "!blk rd\n", 90: "!blk rd wr\n"}.get(i, "")
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        s = monitor.read_monitor_text(spark, f"file://{tmp_path}")
        assert s.select("file", "block").distinct().count() >= {"128m": 2, "3k": 4, "200b": 20}[split]
        got = {f: sorted((r.host, r.time.timestamp(), r.type, r.dev, r.event, r.value) for r in s.where(F.col("file").endswith(f"{f}.txt")).collect()) for f in "ab"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = plain_samples(text)
    assert [x[2:] for x in got["a"]] == [x[2:] for x in want] and [x[0] for x in got["a"]] == [x[0] for x in want] and got["a"] == got["b"]
