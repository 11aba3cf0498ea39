"""The daily aggregate table and the JDBC scan."""

import os
import uuid

from pyspark.sql import functions as F

from tallyrack.operators import filters
from tallyrack.sources import monitor, rollup

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("day=")}


def test_only_touched_days_are_folded(spark, tmp_path):
    path, schema = f"{tmp_path}/agg", "day string, host string, value double"
    first = [("2024-01-01", "a", 1.0), ("2024-01-02", "a", 2.0), ("2024-01-02", "b", None)]
    more = [("2024-01-02", "a", 5.0), ("2024-01-03", "b", 7.0)]
    make = lambda rows: spark.createDataFrame(rows, schema)
    rollup.fold_days(make(first), path, ["host"], 0)
    before = files(path)
    for _ in range(2):  # told again, a batch changes nothing
        rollup.fold_days(make(more), path, ["host"], 1)
    after = files(path)
    assert after["day=2024-01-01"] == before["day=2024-01-01"] and after["day=2024-01-02"] != before["day=2024-01-02"] and "day=2024-01-03" in after
    got = {(str(r.day), r.host): (r.total, r.vmax, r.cnt) for r in rollup.read_days(spark, path, ["day", "host"]).collect()}
    assert got == {("2024-01-01", "a"): (1.0, 1.0, 1), ("2024-01-02", "a"): (7.0, 5.0, 2), ("2024-01-02", "b"): (None, None, 0), ("2024-01-03", "b"): (7.0, 7.0, 1)}
    # a run that ended when one of its days was written: the other day alone is folded now
    rollup.fold_days(make([("2024-01-01", "a", 10.0)]), path, ["host"], 2)
    rollup.fold_days(make([("2024-01-01", "a", 10.0), ("2024-01-03", "b", 1.0)]), path, ["host"], 2)
    got = {str(r.day): r.total for r in rollup.read_days(spark, path, ["day", "host"]).where("total is not null").collect()}
    assert got == {"2024-01-01": 11.0, "2024-01-02": 7.0, "2024-01-03": 8.0}


def test_jdbc_scan_in_ranges(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    runs = spark.range(1000).select(F.col("id").alias("run_id"), F.concat(F.lit("j"), F.col("id") % 10).alias("job_id"), F.when(F.col("id") % 100 != 7, F.col("id")).alias("seconds"))
    runs.write.format("jdbc").options(url=url, dbtable="run", driver=DERBY, createTableColumnTypes="job_id VARCHAR(20)").save()
    d = monitor.read_runs(spark, url, column="seconds", rows=300, driver=DERBY)
    assert d.rdd.getNumPartitions() == 4 and d.count() == 1000
    some = d.where("job_id = 'j3' and seconds > 500").select("run_id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(job_id,j3)" in plan and "GreaterThan(seconds,500)" in plan
    assert sorted(r.run_id for r in some.collect()) == [i for i in range(501, 1000) if i % 10 == 3]
    assert monitor.read_runs(spark, url, driver=DERBY).rdd.getNumPartitions() == 1


def test_loaded_maps(spark, tmp_path):
    """Rename and event maps from files; blank rows, comments and repeated rows go, codes come in any writing."""
    (tmp_path / "names.csv").write_text("kind,scope,old,new\n# old types\ntype,,cpu,host_cpu\nevent,host_cpu,usr,user\nevent,,usr,other\nevent,,usr,other\n,,x,y\nevent,,z,\n")
    names = filters.read_names(spark, str(tmp_path / "names.csv"))
    s = spark.createDataFrame([("cpu", "usr"), ("net", "usr"), ("net", "rx")], "type string, event string")
    assert sorted((r.type, r.event) for r in filters.canonicalise(s, names).collect()) == [("host_cpu", "user"), ("net", "other"), ("net", "rx")]
    (tmp_path / "events.csv").write_text("type,code,name\npmc,0x003C,cycles\npmc,C0,instr\npmc,,none\n")
    rows = [("h", 1, "j", "pmc", "0", e, v) for e, v in (("CTL0", 60.0), ("CTR0", 5.0), ("CTL1", 192.0), ("CTR1", 6.0), ("CTL2", 1.0), ("CTR2", 7.0))]
    d = spark.createDataFrame(rows, "host string, time int, jid string, type string, dev string, event string, value double")
    got = {r.event: r.value for r in monitor.decode_hw_counters(d, filters.read_eventmap(spark, str(tmp_path / "events.csv"))).collect()}
    assert got == {"cycles": 5.0, "instr": 6.0, "OTHER": 7.0}


def test_restricted_queues_are_plain_words(spark):
    jobs = spark.createDataFrame([("a.b",), ("axb",), ("A.B-long",), (None,)], "queue string")
    assert {r.queue for r in filters.drop_restricted(jobs, ["a.b"]).collect()} == {"axb", None}


def test_lines_are_sorted_whole(spark):
    """Before, the parts of each line went through both sorts beside the line, which took several times the memory."""
    text = spark.createDataFrame([("f", 0, i, line) for i, line in enumerate(["!blk rd wr", "10.5 7 h1", "blk sda 1 2"])], "file string, block long, pos long, line string")
    d = monitor.parse_lines(text)
    assert [(r.host, r.jid, r.event, r.value) for r in d.orderBy("event").collect()] == [("h1", "7", "rd", 1.0), ("h1", "7", "wr", 2.0)]
    found = []

    def walk(node):
        if node.nodeName() == "Window":
            kept = node.children().apply(0).output()
            found.append({kept.apply(i).name() for i in range(kept.size())})
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(d._jdf.queryExecution().optimizedPlan())
    assert len([f for f in found if "line" in f]) == 2 and not any("tok" in f for f in found)
