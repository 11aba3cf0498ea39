"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges`` but the smallest of its component.

    Each round links every node's larger neighbours, then its smaller ones, to the least
    node known nearby; rounds grow with the logarithm of the longest path.  The table of
    least neighbours is materialised, so that a node with very many links is a skewed join,
    which adaptive execution splits.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        low = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.min("u")).alias("m")))
        large = e.join(low, F.col("v") == F.col("n")).select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
