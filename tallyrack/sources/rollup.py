"""An aggregate table by day that only new rows' days are folded into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import exists
from .store import scratch


def fold_days(new: DataFrame, path: str, keys: list[str], batch: int, value: str = "value", day: str = "day") -> None:
    """Folds sums, counts and maxima of ``new`` rows into the stored partitions of their days.

    Other days' files stay as they are.  Each day tells the last batch that it holds: a batch
    that is folded again, after a run that ended half-way, changes only days that lack it.
    Batches are numbered upwards.
    """
    spark = new.sparkSession
    part = new.groupBy(day, *keys).agg(F.sum(value).alias("s"), F.max(value).alias("m"), F.count(value).alias("n"))
    if exists(spark, path):
        stored = spark.read.parquet(path).withColumn(day, F.col(day).cast(new.schema[day].dataType))
        old = stored.join(part.select(day).distinct(), day, "left_semi")
        done = old.where(F.col("upto") >= batch).select(day).distinct()
        part = part.unionByName(old.drop("upto")).join(done, day, "left_anti")
        part = part.groupBy(day, *keys).agg(F.sum("s").alias("s"), F.max("m").alias("m"), F.sum("n").alias("n"))
    draft = scratch(spark, "rollup")  # what is read is not what is written over
    part.withColumn("upto", F.lit(batch).cast("long")).write.parquet(draft)
    rows = spark.read.parquet(draft)
    rows.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys, total, vmax, cnt, mean) over all days, or those that a filter on the partition leaves."""
    d = spark.read.parquet(path).groupBy(*keys).agg(F.sum("s").alias("total"), F.max("m").alias("vmax"), F.sum("n").alias("cnt"))
    return d.withColumn("mean", F.col("total") / F.col("cnt"))
