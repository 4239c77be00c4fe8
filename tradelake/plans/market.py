"""Queries of bars and features, each with its oracle. Values that smoothing makes are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelake.functions.common import null_reasons as reasons_json
from tradelake.functions.tables import materialize
from tradelake.operators import asof as asof_ops
from tradelake.operators import bars as bar_ops
from tradelake.operators import dna, features
from tradelake.operators.series import numbered, over_pieces
from tradelake.plans.integrity import query, sec
from tradelake.plans.trading import BARS
from tradelake.sources import driver
from tradelake.sources.driver import with_

OHLC = "open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close"
W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_time)"


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return bar_ops.bars_from_ticks(driver.ticks(spark, d), 3600)


def _shown(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", sec("bar_time").alias("bar_time"), *[F.col(c).cast("double") for c in ("open", "high", "low", "close")], "tick_volume")


@query(with_("ticks") + BARS + f" SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, {OHLC}, tick_volume FROM bars")
def bars_base(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars from events as ticks, after dropping resent ones: the flagship query."""
    from tradelake.operators.ingest import idempotent_insert

    ticks = driver.ticks(spark, d)
    sent = ticks.unionByName(ticks)
    return _shown(bar_ops.bars_from_ticks(idempotent_insert(sent, None, ["event_id"], [F.col("ts")]), 3600))


@query(
    with_("ticks")
    + " SELECT symbol, epoch(time_bucket(INTERVAL 4 HOUR, ts))::BIGINT AS bar_time, min_by(price, event_id)::DOUBLE AS open, max(price)::DOUBLE AS high, min(price)::DOUBLE AS low, max_by(price, event_id)::DOUBLE AS close, count(*) AS tick_volume FROM ticks GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts) HAVING time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM ticks)"
)
def bars_resample(spark: SparkSession, d: str) -> DataFrame:
    """Four-hour bars from hourly ones, those that the last tick of all shows to be closed."""
    last = driver.ticks(spark, d).agg(F.max(F.unix_micros("ts")).alias("t")).first().t
    return _shown(bar_ops.resample(_bars(spark, d), 4 * 3600, F.timestamp_micros(F.lit(last))))


@query(
    with_("ticks")
    + BARS
    + ", g AS (SELECT symbol, epoch(bar_time)::BIGINT AS t, epoch(lead(bar_time) OVER w)::BIGINT AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_time)) SELECT symbol, t + 3600 AS gap_start, n AS gap_end, (n - t) // 3600 - 1 AS missing FROM g WHERE n - t > 3600"
)
def bars_gaps(spark: SparkSession, d: str) -> DataFrame:
    return bar_ops.gaps(_bars(spark, d), 3600).select("symbol", sec("gap_start").alias("gap_start"), sec("gap_end").alias("gap_end"), "missing")


@query(
    with_("ticks")
    + BARS
    + ", e AS (SELECT event_id, symbol, ts FROM ticks), b AS (SELECT symbol, bar_time, bar_time + INTERVAL 1 HOUR AS closed_at, close FROM bars)"
    + " SELECT e.event_id, epoch(b.closed_at)::BIGINT AS data_cutoff, epoch(b.bar_time)::BIGINT AS bar_time, b.close::DOUBLE AS close FROM e ASOF LEFT JOIN b ON e.symbol = b.symbol AND e.ts > b.closed_at"
)
def asof_features(spark: SparkSession, d: str) -> DataFrame:
    """The last bar that is closed before each entry: its end, the data cutoff, is before the entry, so nothing looks ahead."""
    entries = driver.ticks(spark, d).select("event_id", "symbol", "ts")
    closed = _bars(spark, d).select("symbol", F.timestamp_seconds(sec("bar_time") + 3600).alias("closed_at"), "bar_time", "close")
    out = asof_ops.asof(entries, closed, ["symbol"], "ts", "closed_at", strict=True)
    return out.select("event_id", sec("r_closed_at").alias("data_cutoff"), sec("r_bar_time").alias("bar_time"), F.col("r_close").cast("double").alias("close"))


@query(
    with_("ticks")
    + ", e AS (SELECT event_id, ts FROM ticks WHERE symbol = 'purchase'), n AS (SELECT event_id AS news_id, ts FROM ticks WHERE symbol = 'error'),"
    + " b AS (SELECT e.event_id, e.ts, n.ts AS bt FROM e ASOF LEFT JOIN n ON e.ts > n.ts), f AS (SELECT b.*, n.ts AS ft FROM b ASOF LEFT JOIN n ON b.ts <= n.ts),"
    + " s AS (SELECT event_id, epoch(bt)::BIGINT - epoch(ts)::BIGINT AS before, epoch(ft)::BIGINT - epoch(ts)::BIGINT AS after FROM f),"
    + " k AS (SELECT event_id, CASE WHEN before IS NULL THEN after WHEN after IS NULL OR -before <= after THEN before ELSE after END AS s FROM s)"
    + " SELECT event_id, CASE WHEN abs(s) <= 3600 THEN s END AS seconds_to_news, coalesce(abs(s) <= 3600, FALSE) AS news_nearby FROM k"
)
def news_proximity(spark: SparkSession, d: str) -> DataFrame:
    """Signed seconds to the nearest error event within an hour, looking back and ahead, for each purchase."""
    t = driver.ticks(spark, d)
    e = t.where("symbol = 'purchase'").select("event_id", "ts")
    n = t.where("symbol = 'error'").select(F.col("ts").alias("nt"))
    out = asof_ops.nearest(e, "ts", n, "nt", 3600)
    return out.select("event_id", F.col("seconds_off").alias("seconds_to_news"), F.col("seconds_off").isNotNull().alias("news_nearby"))


NEWS = ", news AS (SELECT ['view','signup','click','error','purchase'][(user_id % 5 + 1)::INT] AS symbol, ts AS time_utc, ['LOW','MEDIUM','HIGH'][(event_id % 3 + 1)::INT] AS impact, 'type ' || (event_id % 4)::VARCHAR AS type FROM events WHERE event_type = 'error')"


def _news(spark: SparkSession, d: str) -> DataFrame:
    """The errors as a calendar; the user decides which symbol an item moves, as its currency would."""
    e = driver.read(spark, d, "events").where("event_type = 'error'")
    symbol = F.element_at(F.array(*map(F.lit, ("view", "signup", "click", "error", "purchase"))), (F.col("user_id") % 5).cast("int") + 1)
    impact = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH"))), (F.col("event_id") % 3).cast("int") + 1)
    return e.select(symbol.alias("symbol"), F.col("ts").alias("time_utc"), impact.alias("impact"), F.concat(F.lit("type "), (F.col("event_id") % 4).cast("string")).alias("type"))


@query(
    with_("ticks")
    + ""
    + " SELECT e.event_id, n.event_id AS next_id FROM ticks e ASOF LEFT JOIN (SELECT max(event_id) AS event_id, symbol, ts FROM ticks GROUP BY symbol, ts) n ON e.symbol = n.symbol AND e.ts < n.ts"
)
def asof_next(spark: SparkSession, d: str) -> DataFrame:
    """The next later tick of the same symbol."""
    t = driver.ticks(spark, d)
    n = t.groupBy("symbol", F.col("ts").alias("at")).agg(F.max("event_id").alias("id"))
    out = asof_ops.asof(t.select("symbol", "event_id", "ts"), n, ["symbol"], "ts", "at", prefix="next_", strict=True, forward=True)
    return out.select("event_id", "next_id")


EMA = (
    " r AS (SELECT symbol, bar_time, close::DOUBLE AS x, row_number() OVER (PARTITION BY symbol ORDER BY bar_time) AS n FROM bars),"
    " e AS (SELECT symbol, bar_time, n, x AS y20, x AS y50, x AS y200 FROM r WHERE n = 1 UNION ALL SELECT r.symbol, r.bar_time, r.n, e.y20 + (r.x - e.y20) * (2.0::DOUBLE / 21), e.y50 + (r.x - e.y50) * (2.0::DOUBLE / 51), e.y200 + (r.x - e.y200) * (2.0::DOUBLE / 201) FROM e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1)"
)
RECURSIVE = with_("ticks").replace("WITH ", "WITH RECURSIVE ", 1) + BARS + ","


@query(RECURSIVE + EMA + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, round(y20, 6) AS ema FROM e")
def ema20(spark: SparkSession, d: str) -> DataFrame:
    return features.ema(_bars(spark, d), 20).select("symbol", sec("bar_time").alias("bar_time"), F.round("ema", 6).alias("ema"))


@query(RECURSIVE + EMA + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, round(y200, 6) AS ema FROM e")
def ema200(spark: SparkSession, d: str) -> DataFrame:
    return features.ema(_bars(spark, d), 200).select("symbol", sec("bar_time").alias("bar_time"), F.round("ema", 6).alias("ema"))


@query(RECURSIVE + EMA + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, CASE WHEN y20 - y50 > y50 * 0.001 THEN 1 WHEN y20 - y50 < -y50 * 0.001 THEN -1 ELSE 0 END AS trend FROM e")
def trend(spark: SparkSession, d: str) -> DataFrame:
    """Sign of EMA 20 less EMA 50 outside a band of a thousandth."""
    b = _bars(spark, d)
    both = features.ema(b, 20).join(features.ema(b, 50).withColumnRenamed("ema", "slow"), ["symbol", "bar_time"])
    return both.select("symbol", sec("bar_time").alias("bar_time"), features.trend(F.col("ema"), F.col("slow"), 0.001).alias("trend"))


FRAMES = {"H1": 3600, "H4": 4 * 3600, "D1": 86400}
FRAME_SQL = " UNION ALL ".join(f"SELECT symbol || '|{n}' AS symbol, '{n}' AS frame, time_bucket(INTERVAL {s} SECOND, ts) AS bar_time, {s} AS width, max_by(price, event_id) AS close FROM ticks GROUP BY symbol, time_bucket(INTERVAL {s} SECOND, ts)" for n, s in FRAMES.items())


@query(
    with_("ticks").replace("WITH ", "WITH RECURSIVE ", 1)
    + f", bars AS ({FRAME_SQL}),"
    + EMA
    + ", t AS (SELECT e.symbol, e.bar_time + to_seconds(b.width) AS closed_at, CASE WHEN y20 > y50 THEN 1 WHEN y20 < y50 THEN -1 ELSE 0 END AS trend FROM e JOIN bars b ON e.symbol = b.symbol AND e.bar_time = b.bar_time),"
    + " n AS (SELECT event_id, ts, symbol || '|' || f AS symbol, f FROM ticks, (VALUES ('H1'), ('H4'), ('D1')) v(f))"
    + " SELECT n.event_id, n.f AS frame, t.trend FROM n ASOF LEFT JOIN t ON n.symbol = t.symbol AND n.ts > t.closed_at"
)
def trend_by_timeframe(spark: SparkSession, d: str) -> DataFrame:
    """The trend in each timeframe as the last closed bar before an entry has it."""
    ticks = driver.ticks(spark, d)
    base = bar_ops.bars_from_ticks(ticks, 3600)
    series = None
    for name, seconds in FRAMES.items():
        b = bar_ops.resample(base, seconds).select(F.concat("symbol", F.lit(f"|{name}")).alias("symbol"), "bar_time", "close", F.lit(seconds).alias("width"))
        series = b if series is None else series.unionByName(b)
    both = features.ema(series, 20).join(features.ema(series, 50).withColumnRenamed("ema", "slow"), ["symbol", "bar_time"]).join(series, ["symbol", "bar_time"])
    known = both.select("symbol", F.timestamp_seconds(sec("bar_time") + F.col("width")).alias("closed_at"), features.trend(F.col("ema"), F.col("slow")).alias("trend"))
    entries = ticks.withColumn("frame", F.explode(F.array(*map(F.lit, FRAMES))))
    entries = entries.select("event_id", "ts", F.concat_ws("|", "symbol", "frame").alias("symbol"), "frame")
    return asof_ops.asof(entries, known, ["symbol"], "ts", "closed_at", strict=True).select("event_id", "frame", F.col("r_trend").alias("trend"))


RSI = (
    " g AS (SELECT symbol, bar_time, close::DOUBLE - lag(close::DOUBLE) OVER (PARTITION BY symbol ORDER BY bar_time) AS x FROM bars),"
    " r AS (SELECT symbol, bar_time, greatest(x, 0.0) AS up, greatest(-x, 0.0) AS dn, row_number() OVER (PARTITION BY symbol ORDER BY bar_time) AS n FROM g WHERE x IS NOT NULL),"
    " e AS (SELECT symbol, bar_time, n, up AS u, dn AS v FROM r WHERE n = 1 UNION ALL SELECT r.symbol, r.bar_time, r.n, e.u + (r.up - e.u) / 14, e.v + (r.dn - e.v) / 14 FROM e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1)"
)


@query(RECURSIVE + RSI + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, round(CASE WHEN u + v = 0 THEN 50.0 ELSE 100.0 * u / (u + v) END, 6) AS rsi FROM e")
def rsi14(spark: SparkSession, d: str) -> DataFrame:
    return features.rsi(_bars(spark, d)).select("symbol", sec("bar_time").alias("bar_time"), F.round("rsi", 6).alias("rsi"))


ATR = (
    " g AS (SELECT symbol, bar_time, high::DOUBLE AS h, low::DOUBLE AS l, lag(close::DOUBLE) OVER (PARTITION BY symbol ORDER BY bar_time) AS pc FROM bars),"
    " r AS (SELECT symbol, bar_time, greatest(h - l, abs(h - pc), abs(l - pc)) AS x, row_number() OVER (PARTITION BY symbol ORDER BY bar_time) AS n FROM g),"
    " e AS (SELECT symbol, bar_time, n, x AS y FROM r WHERE n = 1 UNION ALL SELECT r.symbol, r.bar_time, r.n, e.y + (r.x - e.y) / 14 FROM e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1)"
)


@query(RECURSIVE + ATR + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, round(y, 6) AS atr FROM e")
def atr14(spark: SparkSession, d: str) -> DataFrame:
    return features.atr(_bars(spark, d)).select("symbol", sec("bar_time").alias("bar_time"), F.round("atr", 6).alias("atr"))


@query(
    RECURSIVE
    + ATR
    + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, round(y / nullif(avg(y) OVER (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0), 6) AS relative_volatility FROM e"
)
def relative_volatility(spark: SparkSession, d: str) -> DataFrame:
    out = features.relative_volatility(features.atr(_bars(spark, d)))
    return out.select("symbol", sec("bar_time").alias("bar_time"), F.round("relative_volatility", 6).alias("relative_volatility"))


ADX = (
    " g AS (SELECT symbol, bar_time, high::DOUBLE - lag(high::DOUBLE) OVER w AS up, lag(low::DOUBLE) OVER w - low::DOUBLE AS dn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_time)),"
    " r AS (SELECT symbol, bar_time, CASE WHEN up > dn AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0.0 END AS m, row_number() OVER (PARTITION BY symbol ORDER BY bar_time) AS n FROM g WHERE up IS NOT NULL),"
    " e AS (SELECT symbol, bar_time, n, p AS a, m AS b, CASE WHEN p + m = 0 THEN 0.0 ELSE 100.0 * abs(p - m) / (p + m) END AS y FROM r WHERE n = 1 UNION ALL"
    " SELECT symbol, bar_time, n, a, b, y + (CASE WHEN a + b = 0 THEN 0.0 ELSE 100.0 * abs(a - b) / (a + b) END - y) / 14 FROM (SELECT r.symbol, r.bar_time, r.n, e.a + (r.p - e.a) / 14 AS a, e.b + (r.m - e.b) / 14 AS b, e.y FROM e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1))"
)


@query(RECURSIVE + ADX + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, round(y, 6) AS adx FROM e")
def adx14(spark: SparkSession, d: str) -> DataFrame:
    return features.adx(_bars(spark, d)).select("symbol", sec("bar_time").alias("bar_time"), F.round("adx", 6).alias("adx"))


@query(
    with_("ticks")
    + BARS
    + ", r AS (SELECT symbol, bar_time, close::DOUBLE AS c, lag(close::DOUBLE, 10) OVER w AS p FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_time)) SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, 100.0 * (c - p) / p AS roc FROM r WHERE p <> 0"
)
def roc10(spark: SparkSession, d: str) -> DataFrame:
    return features.roc(_bars(spark, d)).where("roc IS NOT NULL").select("symbol", sec("bar_time").alias("bar_time"), "roc")


SWINGS = (
    ", a AS (SELECT *, count(*) OVER f AS n, max(high) OVER f AS mh, min(low) OVER f AS ml FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),"
    " c AS (SELECT *, lag(CASE WHEN n = 5 AND high = mh THEN high END, 2) OVER w AS cu, lag(CASE WHEN n = 5 AND low = ml THEN low END, 2) OVER w AS cd FROM a WINDOW w AS (PARTITION BY symbol ORDER BY bar_time)),"
    " s AS (SELECT *, last_value(cu IGNORE NULLS) OVER w AS sh, last_value(cd IGNORE NULLS) OVER w AS sl FROM c WINDOW w AS (PARTITION BY symbol ORDER BY bar_time ROWS UNBOUNDED PRECEDING)),"
    " b AS (SELECT *, CASE WHEN close > sh THEN 1 WHEN close < sl THEN -1 ELSE 0 END AS bos FROM s)"
)


@query(with_("ticks") + BARS + SWINGS + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, sh::DOUBLE AS last_swing_high, sl::DOUBLE AS last_swing_low, bos FROM b")
def swings(spark: SparkSession, d: str) -> DataFrame:
    out = features.swings(_bars(spark, d))
    return out.select("symbol", sec("bar_time").alias("bar_time"), F.col("last_swing_high").cast("double"), F.col("last_swing_low").cast("double"), "bos")


@query(
    with_("ticks")
    + BARS
    + SWINGS
    + ", p AS (SELECT *, last_value(CASE WHEN bos <> 0 THEN bos END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)"
    + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, coalesce(bos <> 0 AND bos <> before, FALSE) AS choch, CASE CASE WHEN bos <> 0 THEN bos ELSE before END WHEN 1 THEN 'UP' WHEN -1 THEN 'DOWN' ELSE 'RANGE' END AS market_structure FROM p"
)
def market_structure(spark: SparkSession, d: str) -> DataFrame:
    return features.structure(features.swings(_bars(spark, d))).select("symbol", sec("bar_time").alias("bar_time"), "choch", "market_structure")


@query(
    with_("ticks")
    + BARS
    + ", x AS (SELECT *, max(high) OVER f AS top, min(low) OVER f AS bottom FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),"
    + " dd AS (SELECT symbol, bar_time::DATE AS day, max(high) AS h, min(low) AS l FROM bars GROUP BY ALL), dp AS (SELECT symbol, day, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY day))"
    + " SELECT x.symbol, epoch(bar_time)::BIGINT AS bar_time, abs(high::DOUBLE - top::DOUBLE) <= 2 AS equal_highs, abs(low::DOUBLE - bottom::DOUBLE) <= 2 AS equal_lows, (high > top AND close < top) OR (low < bottom AND close > bottom) AS sweep, (ph - close)::DOUBLE AS dist_prev_high, (close - pl)::DOUBLE AS dist_prev_low FROM x JOIN dp ON x.symbol = dp.symbol AND x.bar_time::DATE = dp.day"
)
def liquidity(spark: SparkSession, d: str) -> DataFrame:
    out = features.liquidity(_bars(spark, d), 2.0)
    return out.select("symbol", sec("bar_time").alias("bar_time"), "equal_highs", "equal_lows", "sweep", "dist_prev_high", "dist_prev_low")


@query(
    with_("ticks")
    + BARS
    + f", g AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM bars {W}) SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, CASE WHEN low > h2 THEN 1 ELSE -1 END AS direction, (CASE WHEN low > h2 THEN low - h2 ELSE l2 - high END)::DOUBLE AS size FROM g WHERE low > h2 OR high < l2"
)
def fvg(spark: SparkSession, d: str) -> DataFrame:
    return features.fair_value_gaps(_bars(spark, d)).select("symbol", sec("bar_time").alias("bar_time"), "direction", F.col("size").cast("double"))


@query(
    with_("ticks")
    + BARS
    + ", o AS (SELECT *, close::DOUBLE - open::DOUBLE AS body, sum(high - low) OVER f AS sm, count(*) OVER f AS n, last_value(CASE WHEN close < open THEN bar_time END IGNORE NULLS) OVER p AS dn, last_value(CASE WHEN close > open THEN bar_time END IGNORE NULLS) OVER p AS up FROM bars"
    + " WINDOW f AS (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, sign(body)::INT AS direction, epoch(CASE WHEN body > 0 THEN dn ELSE up END)::BIGINT AS block_time FROM o WHERE n > 0 AND abs(body) > sm::DOUBLE / n * 1.5"
)
def order_blocks(spark: SparkSession, d: str) -> DataFrame:
    return features.order_blocks(_bars(spark, d)).select("symbol", sec("bar_time").alias("bar_time"), "direction", sec("block_time").alias("block_time"))


@query(
    with_("ticks")
    + BARS
    + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, (max(high) OVER f - min(low) OVER f)::DOUBLE AS recent_range FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
)
def recent_range(spark: SparkSession, d: str) -> DataFrame:
    return features.recent_range(_bars(spark, d)).select("symbol", sec("bar_time").alias("bar_time"), F.col("recent_range").cast("double"))


@query(
    "SELECT event_id, (isodow(ts) - 1)::INT AS weekday, hour(ts)::INT AS hour_utc, hour(ts) < 8 AS session_asia, hour(ts) BETWEEN 7 AND 15 AS session_london, hour(ts) BETWEEN 12 AND 20 AS session_newyork FROM events"
)
def time_features(spark: SparkSession, d: str) -> DataFrame:
    out = features.time_features(driver.read(spark, d, "events"), "ts")
    return out.select("event_id", "weekday", "hour_utc", *features.SESSIONS)


FEATURES = f", x AS (SELECT symbol, bar_time, 100.0 * (close::DOUBLE - lag(close::DOUBLE, 10) OVER w) / nullif(lag(close::DOUBLE, 10) OVER w, 0) AS roc, (lag(high, 2) OVER w)::DOUBLE AS high2 FROM bars {W})"


def _features(spark: SparkSession, d: str) -> DataFrame:
    x = over_pieces(numbered(features.roc(_bars(spark, d))), {"high2": lambda w: F.lag("high", 2).over(w)}, back=2)
    return x.select("symbol", sec("bar_time").alias("bar_time"), "roc", F.col("high2").cast("double").alias("high2"))


@query(
    with_("ticks")
    + BARS
    + FEATURES
    + """ SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, '{' || array_to_string([e FOR e IN [CASE WHEN roc IS NULL THEN '"roc":"short_history"' END, CASE WHEN high2 IS NULL THEN '"high2":"short_history"' END] IF e IS NOT NULL], ',') || '}' AS null_reasons FROM x"""
)
def null_reasons(spark: SparkSession, d: str) -> DataFrame:
    x = _features(spark, d)
    why = {c: F.when(F.col(c).isNull(), "short_history") for c in ("roc", "high2")}
    return x.select("symbol", "bar_time", reasons_json(why).alias("null_reasons"))


@query(
    with_("ticks")
    + BARS
    + FEATURES
    + ", l AS (SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, 'roc' AS name, roc AS value FROM x UNION ALL SELECT symbol, epoch(bar_time)::BIGINT, 'high2', high2 FROM x) SELECT l.symbol, l.bar_time, l.name, l.value, CASE name WHEN 'roc' THEN 'momentum' END AS \"group\" FROM l"
)
def feature_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Features in long form with their group from a catalogue; a feature that is not listed has none."""
    definitions = spark.createDataFrame([("roc", 1, "momentum")], "name string, version int, group string")
    long = features.to_long(_features(spark, d), ["symbol", "bar_time"], ["roc", "high2"]).withColumn("version", F.lit(1))
    return features.catalogue(long, definitions).select("symbol", "bar_time", "name", "value", "group")


@query(with_("ticks") + BARS + FEATURES + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, roc, high2 FROM x")
def feature_pivot(spark: SparkSession, d: str) -> DataFrame:
    long = features.to_long(_features(spark, d), ["symbol", "bar_time"], ["roc", "high2"])
    return features.to_wide(long, ["symbol", "bar_time"], ["roc", "high2"])


FRAME_BARS = ", ".join(f"('{n}', {s})" for n, s in dna.TIMEFRAMES.items())
DNA = (
    with_("ticks")
    + NEWS
    + BARS
    + f", x_ema AS (WITH RECURSIVE {EMA} SELECT symbol, bar_time, n, y20, y50, y200 FROM e)"
    + f", x_rsi AS (WITH RECURSIVE {RSI} SELECT symbol, bar_time, CASE WHEN u + v = 0 THEN 50.0 ELSE 100.0 * u / (u + v) END AS rsi FROM e)"
    + f", x_atr AS (WITH RECURSIVE {ATR} SELECT symbol, bar_time, y AS atr, y / nullif(avg(y) OVER (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS relative_volatility FROM e)"
    + f", x_adx AS (WITH RECURSIVE {ADX} SELECT symbol, bar_time, y AS adx FROM e)"
    + f", x_sw AS (WITH z AS (SELECT 1 AS one){SWINGS}, p AS (SELECT *, last_value(CASE WHEN bos <> 0 THEN bos END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)"
    + " SELECT symbol, bar_time, sh, sl, bos, coalesce(bos <> 0 AND bos <> before, FALSE) AS choch, CASE CASE WHEN bos <> 0 THEN bos ELSE before END WHEN 1 THEN 'UP' WHEN -1 THEN 'DOWN' ELSE 'RANGE' END AS market_structure FROM p)"
    + ", dd AS (SELECT symbol, bar_time::DATE AS day, max(high) AS h, min(low) AS l FROM bars GROUP BY ALL), dp AS (SELECT symbol, day, lag(h) OVER w AS ph, lag(l) OVER w AS pl FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY day))"
    + ", k AS (SELECT *, max(high) OVER f AS top, min(low) OVER f AS bottom, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, sum(high - low) OVER f AS sm, count(*) OVER f AS nb,"
    + " last_value(CASE WHEN close < open THEN close END IGNORE NULLS) OVER p AS dn, last_value(CASE WHEN close > open THEN close END IGNORE NULLS) OVER p AS up, lag(close::DOUBLE, 10) OVER w AS c10, max(high) OVER q - min(low) OVER q AS span"
    + " FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_time), f AS (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"
    + ", m AS (SELECT k.*, CASE WHEN low > h2 THEN {'d': 1, 'b': h2, 't': low} WHEN high < l2 THEN {'d': -1, 'b': high, 't': l2} END AS gap0,"
    + " CASE WHEN nb > 0 AND abs(close::DOUBLE - open::DOUBLE) > sm::DOUBLE / nb * 1.5 AND CASE WHEN close > open THEN dn ELSE up END IS NOT NULL THEN {'d': sign(close - open)::INT, 'c': CASE WHEN close > open THEN dn ELSE up END} END AS block0,"
    + " x_ema.n, y20, y50, y200, rsi, atr, relative_volatility, adx, sh, sl, bos, choch, market_structure, ph, pl"
    + " FROM k JOIN x_ema USING (symbol, bar_time) LEFT JOIN x_rsi USING (symbol, bar_time) JOIN x_atr USING (symbol, bar_time) LEFT JOIN x_adx USING (symbol, bar_time) JOIN x_sw USING (symbol, bar_time) JOIN dp ON dp.symbol = k.symbol AND dp.day = k.bar_time::DATE)"
    + ", v AS (SELECT *, bar_time + INTERVAL 1 HOUR AS closed_at, last_value(gap0 IGNORE NULLS) OVER q AS gap, last_value(block0 IGNORE NULLS) OVER q AS block, bool_or(bos <> 0) OVER q AS bos_recent, bool_or(choch) OVER q AS choch_recent"
    + " FROM m WINDOW q AS (PARTITION BY symbol ORDER BY bar_time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"
    + ", tr AS (SELECT event_id AS trade_id, symbol, ts AS entry_time, price AS entry_price, CASE WHEN event_id % 10 <> 0 THEN 0.01::DOUBLE END AS point FROM ticks)"
    + f", fb AS (SELECT symbol || '|' || f AS symbol, time_bucket(to_seconds(s), ts) AS bar_time, max_by(price, event_id) AS close, any_value(s) AS width FROM ticks, (VALUES {FRAME_BARS}) z(f, s) GROUP BY symbol, f, s, time_bucket(to_seconds(s), ts))"
    + f", fe AS (WITH RECURSIVE {EMA.replace('FROM bars)', 'FROM fb)')} SELECT e.symbol, e.bar_time + to_seconds(width) AS closed_at, CASE WHEN y20 - y50 > y50 * 0.001 THEN 1 WHEN y20 - y50 < -y50 * 0.001 THEN -1 ELSE 0 END AS trend FROM e JOIN fb USING (symbol, bar_time))"
    + f", ft AS (SELECT trade_id, entry_time, symbol || '|' || f AS symbol, f FROM tr, (VALUES {FRAME_BARS}) z(f, s))"
    + ", fa AS (SELECT trade_id, f, trend FROM ft ASOF LEFT JOIN fe ON ft.symbol = fe.symbol AND ft.entry_time > fe.closed_at)"
    + ", fp AS (SELECT trade_id, " + ", ".join(f"max(trend) FILTER (f = '{n}') AS trend_{n}" for n in dna.TIMEFRAMES) + " FROM fa GROUP BY trade_id)"
    + ", nn AS (SELECT t.trade_id, min({'d': abs(epoch(time_utc)::BIGINT - epoch(entry_time)::BIGINT), 'o': epoch(time_utc)::BIGINT - epoch(entry_time)::BIGINT, 'impact': impact, 'type': type}) AS x FROM tr t JOIN news USING (symbol) WHERE abs(epoch(time_utc)::BIGINT - epoch(entry_time)::BIGINT) <= 3600 GROUP BY t.trade_id)"
    + ", j AS (SELECT t.*, v.* EXCLUDE (symbol), fp.* EXCLUDE (trade_id), x FROM tr t ASOF JOIN v ON t.symbol = v.symbol AND t.entry_time > v.closed_at JOIN fp ON fp.trade_id = t.trade_id LEFT JOIN nn ON nn.trade_id = t.trade_id)"
    + ", o AS (SELECT trade_id, epoch(closed_at)::BIGINT AS data_cutoff, " + ", ".join(f"trend_{n}" for n in dna.TIMEFRAMES) + ","
    + " round(CASE WHEN n >= 20 THEN y20 END, 6) AS ema20, round(CASE WHEN n >= 50 THEN y50 END, 6) AS ema50, round(CASE WHEN n >= 200 THEN y200 END, 6) AS ema200, round(CASE WHEN n >= 14 THEN rsi END, 6) AS rsi, round(CASE WHEN n >= 14 THEN atr END, 6) AS atr,"
    + " round(CASE WHEN n >= 11 THEN 100.0 * (close::DOUBLE - c10) / nullif(c10, 0) END, 6) AS roc, round(CASE WHEN n >= 28 THEN adx END, 6) AS adx, market_structure, sh::DOUBLE AS last_swing_high, sl::DOUBLE AS last_swing_low, bos_recent, choch_recent, market_structure = 'RANGE' AS is_range,"
    + " (high > top AND close < top) OR (low < bottom AND close > bottom) AS liquidity_sweep, abs(high::DOUBLE - top::DOUBLE) <= 2 AS equal_highs, abs(low::DOUBLE - bottom::DOUBLE) <= 2 AS equal_lows, (ph - close)::DOUBLE / point AS dist_prev_high_points, (close - pl)::DOUBLE / point AS dist_prev_low_points,"
    + " gap IS NOT NULL AS fvg_present, gap.d AS fvg_direction, (gap.t - gap.b)::DOUBLE / point AS fvg_size_points, (CASE WHEN entry_price < gap.b THEN gap.b - entry_price WHEN entry_price > gap.t THEN entry_price - gap.t WHEN gap IS NOT NULL THEN 0 END)::DOUBLE / point AS fvg_distance_points,"
    + " block IS NOT NULL AS ob_present, block.d AS ob_direction, abs(entry_price - block.c)::DOUBLE / point AS ob_distance_points, NULL::DOUBLE AS spread_points, span::DOUBLE / point AS recent_range_points, round(relative_volatility, 6) AS relative_volatility,"
    + " (isodow(entry_time) - 1)::INT AS weekday, hour(entry_time)::INT AS hour_utc, hour(entry_time) < 8 AS session_asia, hour(entry_time) BETWEEN 7 AND 15 AS session_london, hour(entry_time) BETWEEN 12 AND 20 AS session_newyork,"
    + " x IS NOT NULL AS news_nearby, round(x.o / 60.0::DOUBLE)::INT AS minutes_to_news, x.impact AS news_impact, x.type AS news_type FROM j)"
)
REASONS = {
    **{f"trend_{n}": "no_closed_bar" for n in dna.TIMEFRAMES},
    **{n: "short_history" for n in ("ema20", "ema50", "ema200", "rsi", "atr", "roc", "adx", "last_swing_high", "last_swing_low", "liquidity_sweep", "equal_highs", "equal_lows", "dist_prev_high_points", "dist_prev_low_points")},
    **{n: "not_present" for n in ("fvg_direction", "fvg_size_points", "fvg_distance_points", "ob_direction", "ob_distance_points")},
    "spread_points": "no_source",
    **{n: "no_news_nearby" for n in ("minutes_to_news", "news_impact", "news_type")},
}


@query(DNA + " SELECT *, '{' || array_to_string([e FOR e IN [" + ", ".join(f"""CASE WHEN {n} IS NULL THEN '"{n}":"{r}"' END""" for n, r in REASONS.items()) + "] IF e IS NOT NULL], ',') || '}' AS null_reasons FROM o")
def trade_dna(spark: SparkSession, d: str) -> DataFrame:
    """The conditions at each tick's time as if a trade were entered there: all features, with hourly bars as main timeframe."""
    ticks = driver.ticks(spark, d)
    point = F.when(F.col("event_id") % 10 != 0, F.lit(0.01))
    t = ticks.select(F.col("event_id").alias("trade_id"), "symbol", F.col("ts").alias("entry_time"), F.col("price").alias("entry_price"), point.alias("point"))
    fine = materialize(bar_ops.bars_from_ticks(ticks, min(dna.TIMEFRAMES.values())))  # ticks are sorted once, the others are made of these
    frames = {n: bar_ops.resample(fine, s) for n, s in dna.TIMEFRAMES.items()}
    out = dna.trade_dna(t, frames["h1"], 3600, frames, _news(spark, d))
    rounded = {n: F.round(n, 6) for n in ("ema20", "ema50", "ema200", "rsi", "atr", "roc", "adx", "relative_volatility")}
    return out.withColumns({"data_cutoff": sec("data_cutoff"), **rounded})
