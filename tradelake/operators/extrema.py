"""Highest and lowest prices over long spans of time, with lookups instead of a join of each span with each bar.

Bars are held by day, in one row each: its bars in order, how many come before it, and tables of extrema over 1, 2, 4, ... days from it on. A
span needs the bars of its first and its last day, and for the days between them two entries of such a table, which may overlap;
so it is four rows at most, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelake.functions.tables import materialize

DAY = 86_400


def day_of(at: Column) -> Column:
    return F.floor(F.unix_timestamp(at) / DAY)


def _days(bars: DataFrame, first: int, last: int, levels: int) -> DataFrame:
    """A row for each symbol and each day from first to last: symbol, day, bars (in order), before (their number on earlier days), and
    highs and lows over 2 ** i days by i."""
    bar = F.struct("bar_time", "high", "low")
    held = bars.groupBy("symbol", day_of(F.col("bar_time")).alias("day")).agg(F.array_sort(F.collect_list(bar)).alias("bars"), F.max("high").alias("h0"), F.min("low").alias("l0"))
    every = bars.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    # one row for each day; the windows below share its order
    w = Window.partitionBy("symbol").orderBy("day")
    days = every.join(held, ["symbol", "day"], "left")
    days = days.withColumn("before", F.coalesce(F.sum(F.coalesce(F.array_size("bars"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for i in range(1, levels):
        half = 1 << (i - 1)
        days = days.withColumns({f"h{i}": F.greatest(f"h{i - 1}", F.lead(f"h{i - 1}", half).over(w)), f"l{i}": F.least(f"l{i - 1}", F.lead(f"l{i - 1}", half).over(w))})
    return days.select("symbol", "day", "bars", "before", *[F.array(*[f"{c}{i}" for i in range(levels)]).alias(name) for c, name in (("h", "highs"), ("l", "lows"))])


def span_extrema(spans: DataFrame, bars: DataFrame) -> DataFrame:
    """spans (id, symbol, start, end) and bars (symbol, bar_time, high, low) -> id, highest, lowest, n_bars over bars with bar_time in
    [start, end). Spans without a bar are left out, as are those with a null or without a length.

    The days of all symbols are laid out from the first to the last day of the bars, so a day's bars (1,440 of a minute) are the most that
    one row holds, and a symbol's days the most that one window holds. Two numbers reach the driver for each of bars and spans.
    """
    bars = materialize(bars.select("symbol", "bar_time", "high", "low"))
    first, last = bars.agg(F.min(day_of(F.col("bar_time"))), F.max(day_of(F.col("bar_time")))).first()
    if first is None:
        return spans.select("id", *[F.lit(None).cast(bars.schema[c].dataType).alias(n) for c, n in (("high", "highest"), ("low", "lowest"))], F.lit(0).cast("long").alias("n_bars")).limit(0)
    ends = spans.where(F.col("end") > F.col("start")).withColumns({"_from": day_of(F.col("start")), "_until": day_of(F.expr("end - INTERVAL 1 MICROSECOND"))})
    ends = ends.withColumns({"_low": F.greatest(F.col("_from") + 1, F.lit(first)), "_high": F.least(F.col("_until") - 1, F.lit(last))})
    ends = materialize(ends.select("id", "symbol", "start", "end", "_from", "_until", "_low", "_high"))
    longest = ends.agg(F.max(F.col("_high") - F.col("_low") + 1)).first()[0] or 1
    levels = max(1, int(longest)).bit_length()
    size = F.col("_high") - F.col("_low") + 1
    level = F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) + F.lit(1e-9)).cast("int")
    ends = ends.withColumns({"_size": size, "_level": level})

    def look(day: Column, kind: int) -> Column:
        return F.struct(day.cast("long").alias("day"), F.lit(kind).alias("kind"))

    between = F.col("_size") > 0
    wanted = F.array_compact(F.array(
        look(F.col("_from"), 0),
        F.when(F.col("_until") > F.col("_from"), look(F.col("_until"), 0)),
        F.when(between, look(F.col("_low"), 1)),
        F.when(between, look(F.col("_high") + 1 - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level")), 2)),
        F.when(between, look(F.col("_high"), 3)),
    ))
    asked = ends.select("id", "symbol", "start", "end", "_level", F.explode(wanted).alias("_look")).select("*", "_look.*").drop("_look")
    met = asked.join(_days(bars, first, last, levels), ["symbol", "day"])
    inside = F.when(F.col("kind") == 0, F.filter("bars", lambda b: (b["bar_time"] >= F.col("start")) & (b["bar_time"] < F.col("end"))))
    table = F.col("kind").isin(1, 2)
    found = met.withColumn("_in", inside).select(
        "id",
        F.when(table, F.get("highs", F.col("_level"))).otherwise(F.array_max(F.transform("_in", lambda b: b["high"]))).alias("highest"),
        F.when(table, F.get("lows", F.col("_level"))).otherwise(F.array_min(F.transform("_in", lambda b: b["low"]))).alias("lowest"),
        # the bars between: those before the last day's end less those before the first
        F.when(F.col("kind") == 0, F.coalesce(F.array_size("_in"), F.lit(0))).when(F.col("kind") == 1, -F.col("before")).when(F.col("kind") == 3, F.col("before") + F.coalesce(F.array_size("bars"), F.lit(0))).otherwise(0).alias("n"),
    )
    return found.groupBy("id").agg(F.max("highest").alias("highest"), F.min("lowest").alias("lowest"), F.sum("n").cast("long").alias("n_bars")).where("n_bars > 0")
