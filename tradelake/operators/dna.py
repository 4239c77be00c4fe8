"""Conditions of the market at a trade's entry, one row per trade, from bars closed before it.

Each feature comes with the bar that is the last one closed strictly before the entry; data_cutoff is its end. Where a
feature is null, null_reasons has why.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelake.functions.common import null_reasons, ratio
from tradelake.functions.tables import materialize
from tradelake.operators import features
from tradelake.operators.asof import asof, nearest
from tradelake.operators.series import last_known, numbered

#: Seconds of the timeframes of trends.
TIMEFRAMES = {"m1": 60, "m5": 300, "m15": 900, "h1": 3600, "h4": 14_400, "d1": 86_400}
#: Bars in which a break, a gap or an order block counts as recent.
RECENT = 10
#: Bars that an indicator needs before it is told.
WARM_UP = {"ema20": 20, "ema50": 50, "ema200": 200, "rsi": 14, "atr": 14, "roc": 11, "adx": 28}
NEWS_SECONDS = 3600


def bar_features(bars: DataFrame, tolerance: float) -> DataFrame:
    """bars with every feature that a bar and the ones before it have, in units of price."""
    keys = ["symbol", "bar_time"]
    bars = materialize(numbered(bars))
    told = materialize(features.indicators(bars))
    frames = features.liquidity_frames() | features.range_frames() | features.roc_frames() | features.swing_frames() | features.gap_frames() | features.block_frames()
    out = features.framed(bars, frames, 10)
    out = features.known(out, {"last_swing_high": F.col("_swing_up"), "last_swing_low": F.col("_swing_down"), **{n: F.col(c) for n, c in features.BLOCK_VALUES.items()}})
    out = out.withColumn("_gap", features.gap()).withColumn("_block", features.block())
    out = out.withColumn("_block", F.when(F.col("_block.block_time").isNotNull(), F.col("_block")))
    out = features.structure(features.swings(features.roc(features.recent_range(features.liquidity(out, tolerance)))))
    out = materialize(out.join(told, keys))

    def recent(column: Column) -> features.Frame:
        return lambda w: F.last(column, ignorenulls=True).over(w.rowsBetween(1 - RECENT, 0))

    def any_of(column: Column) -> features.Frame:
        return lambda w: F.max(column).over(w.rowsBetween(1 - RECENT, 0))

    frames = {"gap": recent(F.col("_gap")), "block": recent(F.col("_block")), "bos_recent": any_of(F.col("bos") != 0), "choch_recent": any_of(F.col("choch"))}
    out = features.relative_volatility(features.framed(out, frames | features.volatility_frames(), 19))
    warm = {n: F.when(F.col("_n") + 1 >= k, F.col(n)) for n, k in WARM_UP.items()}
    out = out.withColumns(warm).withColumn("is_range", F.col("market_structure") == "RANGE")
    return out.drop("_n", *[c for c in out.columns if c.startswith("_")])


def trends(bars_by_frame: Mapping[str, DataFrame], band: float) -> DataFrame:
    """(symbol, closed_at, trend_m1, ...): at each time at which a bar of any timeframe closes, the trend of each timeframe's last closed
    bar, as a struct, null before its first one; bars have symbol, bar_time, close. Entries look this up once for all timeframes."""
    series = None
    for name, bars in bars_by_frame.items():
        b = bars.select(F.concat_ws("|", "symbol", F.lit(name)).alias("symbol"), F.col("symbol").alias("of"), F.lit(name).alias("frame"), "bar_time", "close", F.lit(TIMEFRAMES[name]).alias("width"))
        series = b if series is None else series.unionByName(b)
    series = materialize(series)
    close = F.col("close").cast("double")
    both = features.smoothed(series, {"ema": close, "slow": close}, {"ema": 2.0 / 21, "slow": 2.0 / 51}).join(series, ["symbol", "bar_time"])
    told = F.struct(features.trend(F.col("ema"), F.col("slow"), band).alias("trend"))
    known = both.select(F.col("of").alias("symbol"), F.timestamp_seconds(F.unix_timestamp("bar_time") + F.col("width")).alias("closed_at"), "frame", told.alias("told"))
    return known.groupBy("symbol", "closed_at").agg(*[F.max(F.when(F.col("frame") == n, F.col("told"))).alias(f"trend_{n}") for n in bars_by_frame])


def trade_dna(trades: DataFrame, bars: DataFrame, seconds: int, bars_by_frame: Mapping[str, DataFrame], news: DataFrame | None = None, tolerance: float = 2.0, band: float = 0.001) -> DataFrame:
    """trades (trade_id, symbol, entry_time, entry_price, point) -> one row per trade that has a closed bar before its entry.

    bars are those of the main timeframe, `seconds` wide. news has time_utc, impact, type and currency beside the symbols'
    currencies that they move, as symbol; without a calendar all its features are null. Bars state no spread, so
    spread_points is null.
    """
    known = materialize(bar_features(bars, tolerance)).withColumn("closed_at", F.timestamp_seconds(F.unix_timestamp("bar_time") + seconds))
    # what an entry looks up is narrow: the trends, and which bar of the main timeframe has the features
    shown = [f"trend_{n}" for n in bars_by_frame]
    closings = trends(bars_by_frame, band).join(known.select("symbol", "closed_at", F.col("closed_at").alias("_main")), ["symbol", "closed_at"], "full")
    closings = numbered(materialize(closings), time="closed_at")
    closings = materialize(last_known(closings, {f"_{c}": F.col(c) for c in [*shown, "_main"]}).select("symbol", "closed_at", *[F.col(f"_{c}").alias(c) for c in [*shown, "_main"]]))
    out = trades.select("trade_id", "symbol", "entry_time", "entry_price", "point")
    if news is not None:
        out = nearest(out, "entry_time", news, "time_utc", NEWS_SECONDS, keys=["symbol"], values=["impact", "type"]).withColumnRenamed("seconds_off", "_off")
    else:
        none = F.lit(None).cast("string")
        out = out.withColumns({"_off": F.lit(None).cast("long"), "impact": none, "type": none})
    out = asof(out, closings, ["symbol"], "entry_time", "closed_at").drop("r_closed_at")
    out = out.withColumns({c: F.col(f"r_{c}.trend") for c in shown})
    bar = known.select(F.col("symbol").alias("_symbol"), *[F.col(c).alias(f"r_{c}") for c in known.columns if c != "symbol"])
    out = out.join(bar, (F.col("symbol") == F.col("_symbol")) & (F.col("r__main") == F.col("r_closed_at")))
    out = features.time_features(out, "entry_time")

    def points(price: Column) -> Column:
        return ratio(price, F.col("point"))

    entry, gap, block = F.col("entry_price"), F.col("r_gap"), F.col("r_block")
    beside = F.when(entry < gap["bottom"], gap["bottom"] - entry).when(entry > gap["top"], entry - gap["top"]).when(gap.isNotNull(), entry - entry)
    columns = {
        **{f"trend_{n}": F.col(f"trend_{n}") for n in bars_by_frame},
        **{n: F.col(f"r_{n}").cast("double") for n in ("ema20", "ema50", "ema200", "rsi", "atr", "roc", "adx")},
        "market_structure": F.col("r_market_structure"),
        "last_swing_high": F.col("r_last_swing_high").cast("double"),
        "last_swing_low": F.col("r_last_swing_low").cast("double"),
        **{n: F.col(f"r_{n}") for n in ("bos_recent", "choch_recent", "is_range")},
        "liquidity_sweep": F.col("r_sweep"),
        **{n: F.col(f"r_{n}") for n in ("equal_highs", "equal_lows")},
        "dist_prev_high_points": points(F.col("r_dist_prev_high")),
        "dist_prev_low_points": points(F.col("r_dist_prev_low")),
        "fvg_present": gap.isNotNull(),
        "fvg_direction": gap["direction"],
        "fvg_size_points": points(gap["size"]),
        "fvg_distance_points": points(beside),
        "ob_present": block.isNotNull(),
        "ob_direction": block["direction"],
        "ob_distance_points": points(F.abs(entry - block["block_close"])),
        "spread_points": F.lit(None).cast("double"),
        "recent_range_points": points(F.col("r_recent_range")),
        "relative_volatility": F.col("r_relative_volatility"),
        **{n: F.col(n) for n in ("weekday", "hour_utc", *features.SESSIONS)},
        "news_nearby": F.lit(None).cast("boolean") if news is None else F.col("_off").isNotNull(),
        "minutes_to_news": F.round(F.col("_off") / 60).cast("int"),
        "news_impact": F.col("impact"),
        "news_type": F.col("type"),
    }
    why = {
        **{f"trend_{n}": "no_closed_bar" for n in bars_by_frame},
        **{n: "short_history" for n in (*WARM_UP, "last_swing_high", "last_swing_low", "liquidity_sweep", "equal_highs", "equal_lows", "dist_prev_high_points", "dist_prev_low_points")},
        **{n: "not_present" for n in ("fvg_direction", "fvg_size_points", "fvg_distance_points", "ob_direction", "ob_distance_points")},
        "spread_points": "no_source",
        "news_nearby": "no_calendar",
        **{n: "no_calendar" if news is None else "no_news_nearby" for n in ("minutes_to_news", "news_impact", "news_type")},
    }
    reasons = null_reasons({n: F.when(columns[n].isNull(), r) for n, r in why.items()})
    return out.select("trade_id", F.col("r_closed_at").alias("data_cutoff"), *[c.alias(n) for n, c in columns.items()], reasons.alias("null_reasons"))
