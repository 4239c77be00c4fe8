"""Bars kept up to date: a batch of ticks, however late, rewrites the folders of its days and no others.

Stored bars can be merged: beside open and close they hold when these were, so two parts of a bar give the bar. The table is
partitioned by day; a batch is first made to bars itself, then joined with the stored ones of the days it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.functions.tables import materialize, scratch

#: Days whose folders are named in the filter on the stored table; a batch with more reads the whole table.
MOST_DAYS = 1000


def partial_bars(ticks: DataFrame, seconds: int, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """ticks -> (symbol, bar_time, first and last as (at, price), high, low, tick_volume); order must order a bar's ticks totally."""
    at = F.struct(*order).alias("at")
    edge = F.struct(at, "price")
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    return ticks.groupBy("symbol", bucket.alias("bar_time")).agg(F.min(edge).alias("first"), F.max(edge).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("tick_volume"))


def merged(parts: DataFrame) -> DataFrame:
    """Parts of bars -> whole ones."""
    return parts.groupBy("symbol", "bar_time").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("tick_volume").alias("tick_volume"))


def shown(parts: DataFrame) -> DataFrame:
    """Bars as bars_from_ticks() gives them."""
    return parts.select("symbol", "bar_time", F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "tick_volume")


def _day(at: Column | str) -> Column:
    return F.date_format(F.to_date(at), "yyyy-MM-dd")


def update(ticks: DataFrame, path: str, seconds: int, order: Sequence[str] = ("ts", "event_id")) -> list[str]:
    """Bring the stored bars up to date with new ticks, each of which must come once; the days that were rewritten.

    What is written is whole before a folder is replaced. One writer per table. A batch without ticks changes nothing.
    """
    spark = ticks.sparkSession
    with scratch(spark):
        new = materialize(partial_bars(ticks, seconds, order).withColumn("day", _day("bar_time")))
        days = sorted(r.day for r in new.select("day").distinct().limit(MOST_DAYS + 1).collect())
        if not days:
            return []
        stored = read(spark, path, new.schema)
        if stored is not None:
            touched = stored.where(F.col("day").isin(days)) if len(days) <= MOST_DAYS else stored.join(new.select("day").distinct(), "day", "left_semi")
            new = new.unionByName(touched)
        whole = materialize(merged(new).withColumn("day", _day("bar_time")))
        # a shuffle by day, so that a day is one file
        whole.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return days


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The stored parts of bars with their day, null if there are none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
