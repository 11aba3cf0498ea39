"""Reading the node monitor's line protocol.

``$key value`` lines describe the node, ``!type event[,options] ...`` lines declare a type's
columns, ``<epoch> <job> <host>`` starts a sample, and ``<type> <device> v1 v2 ...`` lines
belong to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import job_id, parse_field_options

HEADER = r"^\d+(\.\d+)?\s+\S+\s+\S+$"
#: Types that are read but not stored.
EXCLUDED = ("ps", "sysv_shm", "vfs")


def lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, pos, line) of text files; a large file is read in blocks, ``pos`` counts within one in order."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("line"))
    return t.where("line <> ''")


def carried(text: DataFrame, values: dict, keys: list[str] = ["file"]) -> DataFrame:  # noqa: B006
    """``text`` with the last value so far of each of ``values`` (name: expression, NULL where a line has none) within ``keys``.

    Lines are followed within their block; what a block ends with is handed on by a prefix
    over blocks, one row each, so that no task needs all lines of a file.
    """
    w = Window.partitionBy(*keys, "block").orderBy("pos")
    d = text.withColumns({n: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n, v in values.items()})
    ends = text.groupBy(*keys, "block").agg(*[F.max_by(v, F.when(v.isNotNull(), F.col("pos"))).alias(n) for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "block", *[F.last(n, ignorenulls=True).over(before).alias(f"_{n}") for n in values])
    d = d.join(ends, [*keys, "block"])
    return d.withColumns({n: F.coalesce(n, f"_{n}") for n in values}).drop(*[f"_{n}" for n in values])


def parse_lines(text: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Long samples (file, block, pos, host, time, jid, type, dev, event, unit, width, value) of (file, block, pos, line) rows.

    A line whose number of values is not that of its schema is left out.  ``@fast`` rows hold
    the columns that are not slow, ``@full`` and unmarked rows all; absent ones give no row.
    Lines are sorted as they are and taken apart afterwards, since their parts take several
    times the memory.
    """
    d = carried(text, {"head": F.when(F.col("line").rlike(HEADER), F.col("line"))})
    first = F.split("line", r"\s+", 2)[0]
    d = d.withColumn("type", F.when(first.startswith("!"), F.substring(first, 2, 1000)).otherwise(first))
    tok = F.split("line", r"\s+")
    fields = F.transform(F.slice(tok, F.lit(2), F.size(tok) - 1), parse_field_options)
    d = carried(d, {"schema": F.when(first.startswith("!"), fields)}, ["file", "type"])
    d = d.withColumns({"tok": tok, "head": F.split("head", r"\s+")})
    d = d.where(~first.startswith("!") & ~first.startswith("$") & ~F.col("line").rlike(HEADER) & F.col("head").isNotNull() & F.col("schema").isNotNull() & ~F.col("type").isin(*excluded))
    tier = F.when(F.get("tok", F.lit(2)).isin("@fast", "@full"), F.get("tok", F.lit(2)))
    skip = F.when(tier.isNotNull(), 4).otherwise(3)
    d = d.withColumns({
        "vals": F.slice("tok", skip, F.greatest(F.size("tok") - skip + 1, F.lit(0))),
        "cols": F.when(tier == "@fast", F.filter("schema", lambda f: ~f.slow)).otherwise(F.col("schema")),
    }).where(F.size("vals") == F.size("cols"))
    d = d.select("file", "block", "pos", "head", "type", F.get("tok", F.lit(1)).alias("dev"), F.explode(F.arrays_zip("cols", "vals")).alias("x"))
    return d.select(
        "file", "block", "pos", F.col("head")[2].alias("host"), F.timestamp_micros((F.col("head")[0].cast("double") * 1e6).cast("long")).alias("time"), job_id(F.col("head")[1]).alias("jid"), "type", "dev",
        F.col("x.cols.name").alias("event"), F.col("x.cols.unit").alias("unit"), F.col("x.cols.width").alias("width"), F.col("x.cols.multiplier").alias("multiplier"), F.expr("try_cast(x.vals as double)").alias("value"),
    )


def read_monitor_text(spark: SparkSession, path) -> DataFrame:
    return parse_lines(lines(spark, path))


def decode_hw_counters(sample: DataFrame, eventmap: DataFrame, keys=("host", "time", "jid", "type", "dev")) -> DataFrame:
    """Rows of CTLn and CTRn: the control value names its counter by a map (see ``read_eventmap``), an unknown one is OTHER."""
    from ..operators.filters import short

    n = F.regexp_extract("event", r"^CT[LR](\d+)$", 1)
    s = sample.withColumn("n", n)
    ctl = s.where(F.col("event").startswith("CTL")).select(*keys, "n", F.lower(F.hex(F.col("value").cast("long"))).alias("code"))
    ctr = s.where(F.col("event").startswith("CTR")).select(*keys, "n", "value")
    return ctr.join(ctl, [*keys, "n"]).join(short(eventmap), ["type", "code"], "left").select(*keys, F.coalesce("name", F.lit("OTHER")).alias("event"), "value")


def read_proc_rows(text: DataFrame, type_: str = "proc") -> DataFrame:
    """(jid, host, proc, device, counters...) of process lines; the name is the device's first path part."""
    from ..schema import PROC_LAST, PROC_PEAKS

    p = parse_lines(text, excluded=()).where(F.col("type") == type_).withColumn("proc", F.split_part("dev", F.lit("/"), F.lit(1)))
    g = p.groupBy("jid", "host", "proc", F.col("dev").alias("device"), "time")
    return g.agg(*[F.max(F.when(F.lower("event") == c, F.col("value"))).cast("long").alias(c) for c in (*PROC_PEAKS, *PROC_LAST)])


def read_node_identity(text: DataFrame, cap: int = 200) -> DataFrame:
    """One row a file: host, version and system name of its ``$`` lines, and the declared types."""
    key = lambda k: F.max(F.when(F.col("line").startswith(f"${k} "), F.substring("line", len(k) + 3, 1000)))
    types = F.slice(F.array_sort(F.collect_set(F.when(F.col("line").startswith("!"), F.regexp_extract("line", r"^!(\S+)", 1)))), F.lit(1), F.lit(cap))
    return text.groupBy("file").agg(key("hostname").alias("host"), key("version").alias("version"), key("uname").alias("uname"), types.alias("types"))


def discover_files(spark: SparkSession, folder: str, lo_us: int, hi_us: int, hosts: list[str] | None = None) -> DataFrame:
    """Files modified in the window and, of each host, the neighbours just outside it; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.unix_micros("modificationTime").alias("at"), "length")
    f = f.withColumn("host", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    f = f.where(F.col("host").isin(hosts)) if hosts else f
    w = Window.partitionBy("host").orderBy("at", "path")
    near = F.col("at").between(lo_us, hi_us) | ((F.col("at") < lo_us) & (F.lead("at").over(w) >= lo_us)) | ((F.col("at") > hi_us) & (F.lag("at").over(w) <= hi_us))
    return f.withColumn("near", near).where("near").drop("near")


def reingest_job(spark: SparkSession, job: DataFrame, folder: str, jid: str) -> DataFrame:
    """Samples of one job's hosts and padded window, read again from their files."""
    from ..functions.scalars import padded_window

    lo, hi = padded_window(F.col("start_time"), F.col("end_time"), F.current_timestamp())
    row = job.where(F.col("jid") == jid).select("host_list", lo.alias("lo"), hi.alias("hi")).first()
    paths = [f"{folder}/{h}" for h in row.host_list] if row else []
    s = read_monitor_text(spark, paths)
    return s.where(F.unix_seconds("time").between(row.lo, row.hi))


def read_accounting(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of a pipe-delimited export; malformed lines are dropped."""
    from ..functions.hostlists import with_host_list
    from ..functions.scalars import parse_timelimit, seconds_between

    names = ("JobID", "User", "Account", "Start", "End", "Submit", "Partition", "Timelimit", "JobName", "State", "NNodes", "ReqCPUS", "NodeList")
    raw = spark.read.csv(path, sep="|", header=True, mode="DROPMALFORMED", schema=", ".join(f"{n} string" for n in names))
    at = lambda c: F.try_to_timestamp(F.nullif(F.nullif(F.col(c), F.lit("Unknown")), F.lit("None")))
    d = raw.withColumns({"end_time": at("End")}).withColumn("start_time", F.coalesce(at("Start"), "end_time"))
    run = seconds_between(F.col("start_time"), F.col("end_time"))
    n = F.expr("try_cast(NNodes as int)")
    return with_host_list(d.where(n.isNotNull()), "NodeList").select(
        F.col("JobID").alias("jid"), at("Submit").alias("submit_time"), "start_time", "end_time", run.alias("runtime"), parse_timelimit(F.col("Timelimit")).alias("timelimit"), (n * run / 3600).alias("node_hrs"), n.alias("nhosts"),
        F.expr("try_cast(ReqCPUS as int)").alias("ncores"), F.col("User").alias("username"), F.col("Account").alias("account"), F.col("Partition").alias("queue"), F.col("State").alias("state"), F.col("JobName").alias("jobname"), "host_list",
    )


def read_runs(spark: SparkSession, url: str | None = None, path: str | None = None, table: str = "run", *, column: str | None = None, rows: int = 1_000_000, **options) -> DataFrame:
    """Run records of a second database by JDBC, or of Parquet.

    With a numeric or time ``column`` the scan is cut into ranges of it, one for about
    ``rows`` rows, by the bounds and the count that the database tells; filters and columns
    of the query are pushed down to it.  Rows without a value there come with the first range.
    """
    if path:
        return spark.read.parquet(f"{path}/{table}")
    of = lambda: spark.read.format("jdbc").options(url=url, **options)  # noqa: E731  options of a reader add up
    reader = of()
    if column:
        ends = of().option("query", f'SELECT MIN("{column}") AS lo, MAX("{column}") AS hi, COUNT(*) AS n FROM {table}').load().first()
        low, high, n = ends[0], ends[1], int(ends[2])
        if n > rows and low is not None and low < high:
            reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=-(-n // rows))
    return reader.option("dbtable", table).load()
