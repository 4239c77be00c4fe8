"""Price bars: from ticks or from finer bars, and gaps in their series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelake.operators.series import numbered, over_pieces


def bars_from_ticks(ticks: DataFrame, seconds: int, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """ticks (symbol, ts, price, and the columns of order) -> (symbol, bar_time, open, high, low, close, tick_volume).

    Buckets are aligned to the epoch in UTC; order must order the ticks of a bucket totally.
    """
    at = F.struct(*order)
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / seconds) * seconds)
    return ticks.groupBy("symbol", bucket.alias("bar_time")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.count("*").alias("tick_volume"),
    )


def resample(bars: DataFrame, seconds: int, closed_until: Column | None = None) -> DataFrame:
    """Coarser bars; with closed_until (a timestamp), only those that end by then."""
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp("bar_time") / seconds) * seconds)
    out = bars.groupBy("symbol", bucket.alias("bar_time")).agg(
        F.min_by("open", "bar_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bar_time").alias("close"),
        F.sum("tick_volume").alias("tick_volume"),
    )
    if closed_until is not None:
        out = out.where(F.unix_timestamp("bar_time") + seconds <= F.unix_timestamp(closed_until))
    return out


def gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """Runs of missing bars within a symbol's series: symbol, gap_start, gap_end (the next bar), missing."""
    out = over_pieces(numbered(bars.select("symbol", "bar_time")), {"_before": lambda w: F.lag("bar_time").over(w)}, back=1)
    step = F.unix_timestamp("bar_time") - F.unix_timestamp("_before")
    out = out.where(step > seconds)
    return out.select("symbol", F.timestamp_seconds(F.unix_timestamp("_before") + seconds).alias("gap_start"), F.col("bar_time").alias("gap_end"), (F.floor(step / seconds) - 1).cast("long").alias("missing"))
