"""Structured Streaming forms of the ingest, the bars and the liveness of terminals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tradelake.operators.ingest import idempotent_insert


#: Folders that a sink deals its keys out to, by a hash.
SINK_BUCKETS = 256


def idempotent_sink(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], arrival: Sequence[Column]) -> StreamingQuery:
    """Append the new events of each micro-batch to a table: the first of each key, unless the table has it. Exact for ever, with
    no state but the table. It is partitioned by a hash of the key, so a batch reads only the keys of the folders that it writes
    to. One writer per table; a batch that is replayed after a failed commit is dropped by its keys."""
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(SINK_BUCKETS)).cast("int")

    def write(batch: DataFrame, _: int) -> None:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        stored = None
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # SINK_BUCKETS at most
            schema = T.StructType([*batch.schema.fields, T.StructField("_bucket", T.IntegerType())])
            stored = spark.read.schema(schema).parquet(path).where(F.col("_bucket").isin(touched)).drop("_bucket")
        new = idempotent_insert(batch, stored, key, arrival).withColumn("_bucket", bucket)
        new.repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bounded_dedup(stream: DataFrame, key: Sequence[str], at: str, delay: str) -> DataFrame:
    """State-based deduplication within a watermark: weaker, as a key may come again after the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(key))


def live_bars(ticks: DataFrame, width: str, delay: str) -> DataFrame:
    """Closed bars of a stream of ticks (symbol, ts, price, event_id): a bar leaves when the watermark passes its end."""
    at = F.struct("ts", "event_id")
    bars = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("tick_volume")
    )
    return bars.select("symbol", F.col("w.start").alias("bar_time"), "open", "high", "low", "close", "tick_volume")


def live_sessions(beats: DataFrame, key: str, at: str, gap: str, delay: str) -> DataFrame:
    out = beats.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("alive_from"), F.col("w.end").alias("alive_until"), "n")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, spark: SparkSession) -> DataFrame:
    """Run an append-mode stream over what is there, into a Parquet table, and read it."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
