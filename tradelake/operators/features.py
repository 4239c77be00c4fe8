"""Market features of bar series (symbol, bar_time, open, high, low, close), each from closed bars only.

Formulas are this engine's choices. Recursive smoothing runs over pieces of a series in double precision; frames run over
pieces of a series by rows (series.py), so no task holds a symbol's whole history.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tradelake.functions.tables import materialize
from tradelake.operators.series import last_known, numbered, over_pieces

#: Length in time of the pieces in which a series is smoothed.
PIECE_SECONDS = 7 * 86_400


#: A column over a series in order.
Frame = Callable[[WindowSpec], Column]


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _done(out: DataFrame, bars: DataFrame) -> DataFrame:
    """Without the bars' numbers, unless they came with the bars."""
    return out if "_n" in bars.columns else out.drop("_n")


def _lags(n: int, **columns: Column) -> dict[str, Frame]:
    """For each name a column's value n bars before."""
    return {name: lambda w, c=c: F.lag(c, n).over(w) for name, c in columns.items()}


def framed(bars: DataFrame, frames: Mapping[str, Frame], back: int) -> DataFrame:
    """bars with the columns of frames that they lack, and _n. Frames of several features can so be made at once, before them."""
    missing = {n: f for n, f in frames.items() if n not in bars.columns}
    return over_pieces(numbered(bars), missing, back=back) if missing else numbered(bars)


def _with_lags(bars: DataFrame, n: int, **columns: Column) -> DataFrame:
    """bars with, for each name, a column's value n bars before."""
    return _done(framed(bars, _lags(n, **columns), n), bars)


def smoothed(bars: DataFrame, values: Mapping[str, Column], k: float | Mapping[str, float]) -> DataFrame:
    """(symbol, bar_time, a column per value): y[i] = y[i - 1] + k * (x[i] - y[i - 1]) along a symbol's bars, y[0] = x[0]; k may
    differ from value to value.

    The recurrence is linear, so pieces of a series are smoothed apart from each other, each from zero; one row per piece
    is then enough to find what each piece starts from, which is added with the weight it still has. A task holds one
    piece of one symbol, or a symbol's row per piece, never a whole history.
    """
    names = list(values)
    rows = bars.select("symbol", "bar_time", F.floor(F.unix_timestamp("bar_time") / PIECE_SECONDS).alias("piece"), *[v.cast("double").alias(n) for n, v in values.items()])

    rate = {n: k if isinstance(k, float) else k[n] for n in names}

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bar_time").reset_index(drop=True)
        out = part[["symbol", "bar_time", "piece"]].copy()
        for n in names:
            weight = (1 - rate[n]) ** np.arange(1, len(part) + 1)
            out[n] = part[n].ewm(alpha=rate[n], adjust=False).mean() - weight * part[n].iloc[0]
            out[f"first_{n}"], out[f"weight_{n}"] = part[n].iloc[0], weight
        return out

    def carried(ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("piece").reset_index(drop=True)
        for n in names:
            level, levels = ends[f"first_{n}"].iloc[0], []
            for end, weight in zip(ends[n], ends[f"weight_{n}"], strict=True):
                levels.append(level)
                level = end + weight * level
            ends[f"from_{n}"] = levels
        return ends[["symbol", "piece", *[f"from_{n}" for n in names]]]

    doubles = "".join(f", {n} double, first_{n} double, weight_{n} double" for n in names)
    pieces = rows.groupBy("symbol", "piece").applyInPandas(local, f"symbol string, bar_time timestamp, piece long{doubles}")
    end = F.max_by(F.struct(*[c for n in names for c in (n, f"first_{n}", f"weight_{n}")]), "bar_time").alias("end")
    ends = pieces.groupBy("symbol", "piece").agg(end).select("symbol", "piece", "end.*")
    starts = ends.groupBy("symbol").applyInPandas(carried, "symbol string, piece long" + "".join(f", from_{n} double" for n in names))
    return pieces.join(starts, ["symbol", "piece"]).select("symbol", "bar_time", *[(F.col(n) + F.col(f"weight_{n}") * F.col(f"from_{n}")).alias(n) for n in names])


def ema(bars: DataFrame, n: int, column: str = "close") -> DataFrame:
    """(symbol, bar_time, ema): weight 2 / (n + 1), starting with the first value."""
    return smoothed(bars, {"ema": _d(column)}, 2.0 / (n + 1))


def wilder(bars: DataFrame, n: int, **values: Column) -> DataFrame:
    """Wilder's smoothing: weight 1 / n, starting with the first value."""
    return smoothed(bars, values, 1.0 / n)


def _gain_loss(move: Column) -> dict[str, Column]:
    return {"gain": F.greatest(move, F.lit(0.0)), "loss": F.greatest(-move, F.lit(0.0))}


def _rsi() -> Column:
    return F.coalesce(F.try_divide(F.lit(100.0) * F.col("gain"), F.col("gain") + F.col("loss")), F.lit(50.0))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """(symbol, bar_time, rsi) from Wilder averages of gains and losses; 50 without moves."""
    delta = _with_lags(bars, 1, _before=_d("close")).where("_before IS NOT NULL")
    return wilder(delta, n, **_gain_loss(_d("close") - F.col("_before"))).select("symbol", "bar_time", _rsi().alias("rsi"))


def true_range(before: Column) -> Column:
    """From the close before a bar; without one, its range."""
    return F.greatest(_d("high") - _d("low"), F.abs(_d("high") - before), F.abs(_d("low") - before))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return wilder(_with_lags(bars, 1, _before=_d("close")), n, atr=true_range(F.col("_before")))


def _directions(up: Column, down: Column) -> dict[str, Column]:
    return {"plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus": F.when((down > up) & (down > 0), down).otherwise(0.0)}


def _index() -> Column:
    return F.coalesce(F.try_divide(F.lit(100.0) * F.abs(F.col("plus") - F.col("minus")), F.col("plus") + F.col("minus")), F.lit(0.0))


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    """(symbol, bar_time, adx): Wilder's smoothing of the directional index, over bars that have a predecessor."""
    moves = _with_lags(bars, 1, _h=_d("high"), _l=_d("low")).where("_h IS NOT NULL")
    return wilder(wilder(moves, n, **_directions(_d("high") - F.col("_h"), F.col("_l") - _d("low"))), n, adx=_index())


def indicators(bars: DataFrame, n: int = 14) -> DataFrame:
    """(symbol, bar_time, ema20, ema50, ema200, atr, rsi, adx), smoothed together: rsi and adx are null at the first bar."""
    known = _with_lags(bars, 1, _c=_d("close"), _h=_d("high"), _l=_d("low"))
    emas = {f"ema{k}": 2.0 / (k + 1) for k in (20, 50, 200)}
    every = smoothed(known, {**{e: _d("close") for e in emas}, "atr": true_range(F.col("_c"))}, {**emas, "atr": 1.0 / n})
    moves = wilder(known.where("_c IS NOT NULL"), n, **_gain_loss(_d("close") - F.col("_c")), **_directions(_d("high") - F.col("_h"), F.col("_l") - _d("low")))
    moves = materialize(moves)
    both = moves.select("symbol", "bar_time", _rsi().alias("rsi")).join(wilder(moves, n, adx=_index()), ["symbol", "bar_time"])
    return every.join(both, ["symbol", "bar_time"], "left")


def roc_frames(n: int = 10) -> dict[str, Frame]:
    return _lags(n, _roc_before=_d("close"))


def roc(bars: DataFrame, n: int = 10) -> DataFrame:
    """bars with roc, the change of the close against n bars before, in percent."""
    out = framed(bars, roc_frames(n), n)
    return _done(out.withColumn("roc", F.try_divide(F.lit(100.0) * (_d("close") - F.col("_roc_before")), F.col("_roc_before"))).drop("_roc_before"), bars)


def trend(fast: Column, slow: Column, band: float = 0.0) -> Column:
    """-1, 0 or 1: the sign of fast - slow outside a dead band, a share of slow."""
    gap = fast - slow
    return F.when(gap > F.abs(slow) * band, 1).when(gap < -F.abs(slow) * band, -1).when(gap.isNotNull(), 0)


def swing_frames(k: int = 2) -> dict[str, Frame]:
    """A fractal's high (low) at the bar that confirms it: the bar k before has k lower (higher) ones on each side."""

    def fractal(column: str, extreme: Callable) -> Frame:
        def at(w: WindowSpec) -> Column:
            around = w.rowsBetween(-2 * k, 0)
            middle = F.lag(column, k).over(w)
            return F.when((F.count("*").over(around) == 2 * k + 1) & (middle == extreme(column).over(around)), middle)

        return at

    return {"_swing_up": fractal("high", F.max), "_swing_down": fractal("low", F.min)}


def swings(bars: DataFrame, k: int = 2) -> DataFrame:
    """bars with last_swing_high and last_swing_low as known at each bar: a fractal with k lower (higher) bars on each side is
    confirmed k bars later, so nothing looks ahead; and with bos, a close beyond the last swing."""
    out = known(framed(bars, swing_frames(k), 2 * k), {"last_swing_high": F.col("_swing_up"), "last_swing_low": F.col("_swing_down")})
    bos = F.when(F.col("close") > F.col("last_swing_high"), 1).when(F.col("close") < F.col("last_swing_low"), -1).otherwise(0)
    return _done(out.withColumn("bos", bos).drop("_swing_up", "_swing_down"), bars)


def known(bars: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """numbered bars with the last value up to each bar that is not null, for those of values that they lack."""
    missing = {n: v for n, v in values.items() if n not in bars.columns}
    return last_known(bars, missing) if missing else bars


def structure(swung: DataFrame) -> DataFrame:
    """swings() with choch (a break against the direction of the last break) and market_structure UP, DOWN or RANGE."""
    out = last_known(numbered(swung), {"_before": F.when(F.col("bos") != 0, F.col("bos"))}, inclusive=False)
    out = out.withColumn("choch", F.coalesce((F.col("bos") != 0) & (F.col("bos") != F.col("_before")), F.lit(False)))
    now = F.when(F.col("bos") != 0, F.col("bos")).otherwise(F.col("_before"))
    out = out.withColumn("market_structure", F.when(now == 1, "UP").when(now == -1, "DOWN").otherwise("RANGE")).drop("_before")
    return _done(out, swung)


def liquidity_frames(lookback: int = 10) -> dict[str, Frame]:
    return {"_top": lambda w: F.max("high").over(w.rowsBetween(-lookback, -1)), "_bottom": lambda w: F.min("low").over(w.rowsBetween(-lookback, -1))}


def liquidity(bars: DataFrame, tolerance: float, lookback: int = 10) -> DataFrame:
    """bars with equal_highs and equal_lows (within tolerance of the extreme of the bars before), sweep (beyond that extreme,
    closed back inside), and dist_prev_high and dist_prev_low, from the close to the extremes of the last day before that has
    bars (a Monday looks at the Friday)."""
    out = _done(framed(bars, liquidity_frames(lookback), lookback), bars)
    out = out.withColumn("equal_highs", F.abs(_d("high") - F.col("_top").cast("double")) <= tolerance)
    out = out.withColumn("equal_lows", F.abs(_d("low") - F.col("_bottom").cast("double")) <= tolerance)
    out = out.withColumn("sweep", ((F.col("high") > F.col("_top")) & (F.col("close") < F.col("_top"))) | ((F.col("low") < F.col("_bottom")) & (F.col("close") > F.col("_bottom"))))
    days = bars.groupBy("symbol", F.to_date("bar_time").alias("_day")).agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    w = Window.partitionBy("symbol").orderBy("_day")  # a row a day
    days = days.select("symbol", "_day", F.lag("_h").over(w).alias("_ph"), F.lag("_l").over(w).alias("_pl"))
    out = out.withColumn("_day", F.to_date("bar_time")).join(days, ["symbol", "_day"])
    return out.withColumn("dist_prev_high", (F.col("_ph") - F.col("close")).cast("double")).withColumn("dist_prev_low", (F.col("close") - F.col("_pl")).cast("double")).drop("_top", "_bottom", "_day", "_ph", "_pl")


def gap_frames() -> dict[str, Frame]:
    return _lags(2, _high_2=F.col("high"), _low_2=F.col("low"))


def gap() -> Column:
    """direction, size and edges of the gap that a bar with gap_frames() leaves to the one two before; null without one."""
    direction = F.when(F.col("low") > F.col("_high_2"), 1).when(F.col("high") < F.col("_low_2"), -1)
    bottom, top = F.when(direction == 1, F.col("_high_2")).otherwise(F.col("high")), F.when(direction == 1, F.col("low")).otherwise(F.col("_low_2"))
    return F.when(direction.isNotNull(), F.struct(direction.alias("direction"), (top - bottom).alias("size"), bottom.alias("bottom"), top.alias("top")))


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Bars that leave a gap to the one two before: symbol, bar_time, direction, size, and its edges, bottom and top."""
    return framed(bars, gap_frames(), 2).select("symbol", "bar_time", gap().alias("gap")).where("gap IS NOT NULL").select("symbol", "bar_time", "gap.*")


def block_frames(lookback: int = 10) -> dict[str, Frame]:
    """The mean range of the bars before, and the bar before if it fell or rose."""
    bar = F.struct("bar_time", "close")
    fell, rose = F.when(F.col("close") < F.col("open"), bar), F.when(F.col("close") > F.col("open"), bar)
    return {"_mean_range": lambda w: F.avg(_d("high") - _d("low")).over(w.rowsBetween(-lookback, -1)), **_lags(1, _fell=fell, _rose=rose)}


#: The last bar that fell (rose) before each bar, from block_frames().
BLOCK_VALUES = {"_last_fell": "_fell", "_last_rose": "_rose"}


def block(factor: float = 1.5) -> Column:
    """direction, block_time and block_close at a bar whose body exceeds factor times the mean range before; null at others."""
    body = _d("close") - _d("open")
    last = F.when(body > 0, F.col("_last_fell")).otherwise(F.col("_last_rose"))
    told = F.struct(F.signum(body).cast("int").alias("direction"), last["bar_time"].alias("block_time"), last["close"].alias("block_close"))
    return F.when(F.abs(body) > F.col("_mean_range") * factor, told)


def order_blocks(bars: DataFrame, factor: float = 1.5, lookback: int = 10) -> DataFrame:
    """Bars whose body exceeds factor times the mean range of the bars before, with the last opposite bar before them:
    symbol, bar_time, direction, block_time, block_close."""
    out = known(framed(bars, block_frames(lookback), lookback), {n: F.col(c) for n, c in BLOCK_VALUES.items()})
    return out.select("symbol", "bar_time", block(factor).alias("block")).where("block IS NOT NULL").select("symbol", "bar_time", "block.*")


def range_frames(n: int = 10) -> dict[str, Frame]:
    return {"recent_range": lambda w: F.max("high").over(w.rowsBetween(1 - n, 0)) - F.min("low").over(w.rowsBetween(1 - n, 0))}


def recent_range(bars: DataFrame, n: int = 10) -> DataFrame:
    """bars with recent_range, the span of the last n bars."""
    return _done(framed(bars, range_frames(n), n - 1), bars)


def volatility_frames(n: int = 20) -> dict[str, Frame]:
    return {"_mean_atr": lambda w: F.avg("atr").over(w.rowsBetween(1 - n, 0))}


def relative_volatility(atr_rows: DataFrame, n: int = 20) -> DataFrame:
    """atr() rows with the ATR over its mean of the last n bars."""
    out = framed(atr_rows, volatility_frames(n), n - 1).withColumn("relative_volatility", F.try_divide(F.col("atr"), F.col("_mean_atr"))).drop("_mean_atr")
    return _done(out, atr_rows)


#: Fixed values of this engine: session hours in UTC, start included, end excluded.
SESSIONS = {"session_asia": (0, 8), "session_london": (7, 16), "session_newyork": (12, 21)}


def time_features(df: DataFrame, at: str) -> DataFrame:
    """df with weekday (Monday 0), hour_utc and the session flags of a timestamp."""
    hour = F.hour(at)
    out = df.withColumn("weekday", F.weekday(at)).withColumn("hour_utc", hour)
    for name, (start, end) in SESSIONS.items():
        out = out.withColumn(name, (hour >= start) & (hour < end))
    return out


def catalogue(long: DataFrame, definitions: DataFrame) -> DataFrame:
    """Features in long form (name, version, ...) with their definitions; a catalogue is small, Spark broadcasts it by size."""
    return long.join(definitions, ["name", "version"], "left")


def to_long(wide: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    return wide.unpivot(ids, [F.col(c).cast("double").alias(c) for c in features], "name", "value")


def to_wide(long: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    return long.groupBy(*ids).pivot("name", features).agg(F.first("value"))
