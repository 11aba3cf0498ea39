"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every row of a source has the same expected number of copies, its rate.  Rows of a source
stand in a fixed order; the prefix sum of the rate after row k is k times the rate.  One
offset in [0, 1) is added for the source, and a row is emitted once for each integer that
its own step of the prefix sum crosses.

The order needs no task that sees a whole source: rows fall into buckets by the leading
bits of the md5 of their key, bucket counts give the rank at which each bucket starts, and
a window inside (bucket, source) gives the rest.  Within a bucket rows run by size,
up in even buckets and down in odd ones, so that the words taken follow the rows taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, hash_bits, table, without

#: Rows in a bucket, over all sources.
BUCKET_ROWS = 2048
MAX_REPEAT = 3


def level_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, weight, ...) with ``target``.

    Targets share the sum of all sizes by weight; none is above ``max_repeat`` times its
    source's size, and what is above is shared again.  Sorted by size per weight, the
    sources at their limit come first, so one running sum finds them all.  One row a source.
    """
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "source_size", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * max_repeat
    whole = Window.partitionBy()
    held = cap * F.sum("weight").over(after) < F.col("weight") * (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
    s = sizes.withColumn("cap", cap).withColumn("held", held)
    free = F.sum("source_size").over(whole) - F.sum(F.when(F.col("held"), F.col("cap")).otherwise(0)).over(whole)
    share = (F.col("weight") * free).cast("double") / F.sum(F.when(F.col("held"), 0).otherwise(F.col("weight"))).over(whole).cast("double")
    return s.withColumn("target", F.when(F.col("held"), F.col("cap").cast("double")).otherwise(share)).drop("cap", "held")


ADDED = {"size", "source_size", "target", "copies", "taken", "_bucket", "_k", "_off", "_sk"}


def mixed(docs: DataFrame, weights=(5, 2, 1), *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies times size).

    ``weights`` go to the sources by code point, a null source last, repeating.  Sizes are
    words (null or blank text: 0).  A source without words has target 0 and no copies.
    Rows with a null key stand before the others of their bucket; equal rows are rows like
    any other.  Columns of ``docs`` named like the added ones are replaced.
    """
    docs = without(docs, *ADDED)
    bits = min(32, (max(docs.select(F.lit(1)).count() - 1, 0) // BUCKET_ROWS).bit_length())
    id_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    sk = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))
    sized = docs.withColumns({"size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"), "_bucket": hash_bits(id_text, bits), "_sk": sk})
    counts = cut(sized.groupBy("_bucket", "_sk", F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size")))
    sources = counts.groupBy("_sk", "source").agg(F.sum("_size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    targets = level_targets(sources.withColumn("weight", weight), max_repeat)
    start = F.sum("_n").over(Window.partitionBy("_sk").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("_bucket", "_sk", F.coalesce(start, F.lit(0)).alias("_off")).join(targets.drop("weight", "source"), "_sk")
    up = F.when(F.col("_bucket") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    order = Window.partitionBy("_bucket", "_sk").orderBy(up, F.md5(id_text), F.col(key).asc_nulls_first())
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"offset {seed} "), F.col("_sk"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    k = F.col("_k").cast("double")
    steps = F.floor(k * rate + offset) - F.floor((k - 1) * rate + offset)
    out = (
        sized.join(places, ["_bucket", "_sk"])
        .withColumn("_k", F.row_number().over(order) + F.col("_off"))
        .withColumn("copies", F.least(steps, F.ceil(rate)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
    return out.select(*docs.columns, "size", "source_size", "target", "copies", "taken")


def repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it; columns stay as they are, whatever their names."""
    if {c.lower() for c in docs.columns} & ADDED:
        own = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("_doc"))
        return repeated(own).select("_doc.*")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed(docs).where("copies > 0").withColumn("copies", copies).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH n AS (SELECT CASE WHEN count(*) <= {BUCKET_ROWS} THEN 0 ELSE length(bin((count(*) - 1) // {BUCKET_ROWS})) END AS bits FROM documents),
d AS (SELECT doc_id, source, coalesce('s' || source, 'null') AS sk, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
b AS (SELECT d.*, CASE WHEN bits = 0 THEN 0 ELSE CAST('0x' || substr(h, 1, 8) AS BIGINT) >> (32 - bits) END AS bucket FROM d, n),
s AS (SELECT sk, source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY sk, source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
r AS (SELECT *, source_size * 3 * sum(weight) OVER (ORDER BY source_size / weight, source_size, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        < weight * (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY source_size / weight, source_size, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS held FROM w),
t AS (SELECT sk, source_size, CASE WHEN held THEN CAST(source_size * 3 AS DOUBLE)
        ELSE CAST(weight * (sum(source_size) OVER () - coalesce(sum(source_size * 3) FILTER (held) OVER (), 0)) AS DOUBLE) / CAST(sum(weight) FILTER (NOT held) OVER () AS DOUBLE) END AS target FROM r),
k AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END AS rate,
        (CAST(CAST('0x' || substr(md5('offset 0 ' || b.sk), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE AS u,
        CAST(row_number() OVER (PARTITION BY b.sk ORDER BY bucket, CASE WHEN bucket % 2 = 0 THEN size ELSE -size END, h, doc_id NULLS FIRST) AS DOUBLE) AS k FROM b JOIN t ON b.sk = t.sk)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), ceil(rate)) AS BIGINT) * size AS taken FROM k
"""
QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {"op1_mixing": SQL}
