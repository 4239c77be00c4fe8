"""Queries of the trade lifecycle, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelake.functions.tables import materialize
from tradelake.operators import bars as bar_ops
from tradelake.operators import chains, lifecycle, rebuild
from tradelake.plans.integrity import query, sec
from tradelake.sources import driver
from tradelake.sources.driver import with_

NET = "profit + commission + swap"


@query(
    with_("deals")
    + " SELECT trade_id, count(*) AS n_deals, epoch(min(deals.at))::BIGINT AS first_at, epoch(max(deals.at))::BIGINT AS last_at, (sum(volume) FILTER (is_entry))::DOUBLE AS entry_volume, (sum(volume) FILTER (NOT is_entry))::DOUBLE AS exit_volume, min_by(price, seq) AS first_price,"
    + " sum(profit)::DOUBLE AS gross_profit, sum(commission)::DOUBLE AS commission, sum(swap)::DOUBLE AS swap, (sum(profit) + sum(commission) + sum(swap))::DOUBLE AS net_profit FROM deals GROUP BY trade_id"
)
def trade_fold(spark: SparkSession, d: str) -> DataFrame:
    out = lifecycle.fold(driver.deals(spark, d), "order")
    return out.select([F.col(c).cast("double").alias(c) if t.startswith("decimal") else sec(c).alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])


RUNNING = ", r AS (SELECT *, sum(CASE WHEN is_entry THEN volume ELSE -volume END) OVER (PARTITION BY trade_id ORDER BY seq) AS pv FROM deals)"


@query(with_("deals") + RUNNING + " SELECT trade_id, seq, pv::DOUBLE AS position_volume, (max(pv) OVER (PARTITION BY trade_id ORDER BY seq))::DOUBLE AS max_volume FROM r")
def position_running_volume(spark: SparkSession, d: str) -> DataFrame:
    out = lifecycle.running_volume(driver.numbered_deals(spark, d))
    return out.select("trade_id", "seq", F.col("position_volume").cast("double"), F.col("max_volume").cast("double"))


@query(
    with_("deals")
    + RUNNING
    + ", b AS (SELECT *, lag(pv) OVER (PARTITION BY trade_id ORDER BY seq) AS before FROM r)"
    + " SELECT trade_id, seq, CASE WHEN before IS NULL THEN 'TRADE_OPENED' WHEN NOT is_entry AND pv <= 0 THEN 'TRADE_CLOSED' WHEN NOT is_entry THEN 'PARTIAL_CLOSE' WHEN before <= 0 THEN 'REENTRY' ELSE 'POSITION_INCREASED' END AS event_type FROM b"
)
def event_classification(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.classify(driver.numbered_deals(spark, d)).select("trade_id", "seq", "event_type")


@query(
    with_("deals")
    + ", s AS (SELECT trade_id, seq, l_partkey % 3 AS sl, l_suppkey % 4 AS tp FROM deals), b AS (SELECT *, lag(sl) OVER w AS psl, lag(tp) OVER w AS ptp, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY trade_id ORDER BY seq))"
    + " SELECT trade_id, seq, 'SL_MODIFIED' AS event_type FROM b WHERE n > 1 AND sl IS DISTINCT FROM psl UNION ALL SELECT trade_id, seq, 'TP_MODIFIED' FROM b WHERE n > 1 AND tp IS DISTINCT FROM ptp"
)
def stop_changes(spark: SparkSession, d: str) -> DataFrame:
    s = driver.numbered_deals(spark, d).select("trade_id", "seq", (F.col("l_partkey") % 3).alias("sl"), (F.col("l_suppkey") % 4).alias("tp"))
    return lifecycle.stop_events(s).select("trade_id", "seq", "event_type")


@query(
    with_("deals")
    + ", q AS (SELECT trade_id, (sum(amount) * 100)::HUGEINT AS a, (sum(volume) * 10000)::HUGEINT AS v FROM deals WHERE NOT is_entry GROUP BY trade_id)"
    + " SELECT trade_id, ((2 * a * 100000000 + v) // (2 * v))::DOUBLE / 1000000.0::DOUBLE AS close_price FROM q"
)
def exit_vwap(spark: SparkSession, d: str) -> DataFrame:
    """Exit prices as decimal quotients, rounded half up to six decimals; the oracle divides whole numbers."""
    return lifecycle.exit_price(driver.deals(spark, d)).select("trade_id", F.round("close_price", 6).cast("double").alias("close_price"))


PNL = f", p AS (SELECT trade_id, sum({NET}) AS net FROM deals GROUP BY trade_id)"


@query(with_("deals") + PNL + " SELECT trade_id, net::DOUBLE AS net_profit, CASE WHEN net > 0 THEN 'WIN' WHEN net < 0 THEN 'LOSS' ELSE 'BREAKEVEN' END AS outcome FROM p")
def outcome_label(spark: SparkSession, d: str) -> DataFrame:
    net = driver.deals(spark, d).groupBy("trade_id").agg(F.sum(F.expr(NET)).alias("net"))
    return net.select("trade_id", F.col("net").cast("double").alias("net_profit"), lifecycle.outcome(F.col("net")).alias("outcome"))


@query(
    with_("deals", "trades")
    + ", x AS (SELECT trade_id, min_by(price, seq) AS entry, max_by(price, seq) AS leave FROM deals GROUP BY trade_id)"
    + " SELECT t.trade_id, (CASE direction WHEN 'BUY' THEN 1 ELSE -1 END) * (leave - entry) / CASE WHEN t.trade_id % 10 = 0 THEN NULL ELSE 0.01 END AS points, (epoch(close_time) - epoch(entry_time))::BIGINT AS duration_seconds FROM trades t JOIN x ON t.trade_id = x.trade_id"
)
def points_duration(spark: SparkSession, d: str) -> DataFrame:
    """Points between a trade's first and last price, null without a point size, and its duration."""
    x = driver.deals(spark, d).groupBy("trade_id").agg(F.min_by("price", "order").alias("entry"), F.max_by("price", "order").alias("leave"))
    t = driver.trades(spark, d).join(x, "trade_id")
    point = F.when(F.col("trade_id") % 10 != 0, F.lit(0.01))
    return t.select("trade_id", lifecycle.points(F.col("direction"), F.col("entry"), F.col("leave"), point).alias("points"), lifecycle.duration_seconds(F.col("entry_time"), F.col("close_time")).alias("duration_seconds"))


@query(
    with_("trades")
    + ", s AS (SELECT trade_id, entry_price AS e, CASE WHEN trade_id % 6 <> 0 THEN entry_price - (trade_id % 90 + 10) END AS sl, (trade_id % 4)::DOUBLE AS bal FROM trades)"
    + ", a AS (SELECT trade_id, bal, abs(e - sl)::DOUBLE / 0.25::DOUBLE * 2.0::DOUBLE * 3.0::DOUBLE AS amount FROM s)"
    + " SELECT trade_id, amount AS risk_amount, CASE WHEN bal <> 0 THEN 100.0::DOUBLE * amount / bal END AS risk_percent FROM a"
)
def trade_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk at the initial stop; null for trades without one, and no percentage of a zero balance."""
    stop = F.when(F.col("trade_id") % 6 != 0, F.col("entry_price") - (F.col("trade_id") % 90 + 10).cast("int"))
    amount = lifecycle.risk_amount(F.col("entry_price"), stop, F.lit(0.25), F.lit(2.0), F.lit(3.0))
    t = driver.trades(spark, d).select("trade_id", amount.alias("risk_amount"), (F.col("trade_id") % 4).cast("double").alias("balance"))
    return t.select("trade_id", "risk_amount", lifecycle.risk_percent(F.col("risk_amount"), F.col("balance")).alias("risk_percent"))


@query(
    with_("deals")
    + ", e AS (SELECT trade_id, count(DISTINCT reason) FILTER (NOT is_entry) AS n, max(reason) FILTER (NOT is_entry) AS r FROM deals GROUP BY trade_id)"
    + " SELECT trade_id, CASE WHEN n = 0 THEN 'UNKNOWN' WHEN n > 1 THEN 'MIXED' ELSE r END AS exit_reason FROM e"
)
def exit_reason(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.exit_reason(driver.deals(spark, d))


MATCHED = ", m AS (SELECT t.trade_id, d.id, d.started_at FROM trades t JOIN deployments d ON t.account_id = d.account_id AND t.magic_number = d.magic_number AND t.symbol = d.symbol AND t.entry_time >= d.started_at AND (d.ended_at IS NULL OR t.entry_time < d.ended_at))"


@query(
    with_("trades", "deployments")
    + MATCHED
    + ", b AS (SELECT trade_id, first(id ORDER BY started_at DESC, id) AS deployment_id, count(*) AS n FROM m GROUP BY trade_id) SELECT t.trade_id, deployment_id, coalesce(n, 0) AS n_deployments FROM trades t LEFT JOIN b ON t.trade_id = b.trade_id"
)
def deployment_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Each trade's deployment by account, magic number, symbol and validity interval: none, one, or the latest of several."""
    return lifecycle.attribute(driver.trades(spark, d), driver.deployments(spark, d)).select("trade_id", "deployment_id", "n_deployments")


@query(
    with_("deployments")
    + " SELECT a.account_id, a.id AS first_id, b.id AS second_id FROM deployments a JOIN deployments b ON a.account_id = b.account_id AND a.magic_number = b.magic_number AND a.symbol = b.symbol AND a.id < b.id AND (a.ended_at IS NULL OR b.started_at < a.ended_at) AND (b.ended_at IS NULL OR a.started_at < b.ended_at)"
)
def deployment_overlap(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.overlaps(driver.deployments(spark, d)).select("account_id", "first_id", "second_id")


@query(
    with_("deployments")
    + ", more AS (SELECT * FROM deployments UNION ALL SELECT id + 1000000, account_id % 50, 1, 'any', started_at, ended_at FROM deployments),"
    + " ch AS (SELECT account_id, magic_number, symbol, tm, sum(change)::BIGINT AS change FROM (SELECT account_id, magic_number, symbol, started_at AS tm, 1 AS change FROM more UNION ALL SELECT account_id, magic_number, symbol, ended_at, -1 FROM more WHERE ended_at IS NOT NULL) GROUP BY ALL),"
    + " ac AS (SELECT *, sum(change) OVER (PARTITION BY account_id, magic_number, symbol ORDER BY tm) AS n FROM ch WHERE change <> 0),"
    + " st AS (SELECT *, n >= 2 AS on_, n - change >= 2 AS was FROM ac), rn AS (SELECT *, sum((on_ AND NOT was)::INT) OVER (PARTITION BY account_id, magic_number, symbol ORDER BY tm) AS run FROM st)"
    + " SELECT account_id, magic_number::BIGINT AS magic_number, symbol, epoch(min(tm))::BIGINT AS ambiguous_from, epoch(max(tm) FILTER (NOT on_))::BIGINT AS ambiguous_until, max(n)::BIGINT AS most FROM rn WHERE on_ OR was GROUP BY account_id, magic_number, symbol, run"
)
def deployment_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """When two or more deployments of one account, magic number and symbol hold at once; one symbol is traded by very many."""
    base = driver.deployments(spark, d)
    many = base.withColumns({"id": F.col("id") + 1000000, "account_id": F.col("account_id") % 50, "magic_number": F.lit(1).cast("long"), "symbol": F.lit("any")})
    out = lifecycle.exposures(base.unionByName(many))
    return out.withColumns({"ambiguous_from": sec("ambiguous_from"), "ambiguous_until": sec("ambiguous_until"), "magic_number": F.col("magic_number").cast("long")})


BARS = ", bars AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS bar_time, min_by(price, event_id) AS open, max(price) AS high, min(price) AS low, max_by(price, event_id) AS close, count(*) AS tick_volume FROM ticks GROUP BY ALL)"


@query(
    with_("ticks")
    + BARS
    + ", t AS (SELECT event_id AS trade_id, symbol, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS direction, ts AS entry_time, ts + to_hours((event_id % 40)::INT) AS close_time, price AS entry_price FROM ticks)"
    + ", x AS (SELECT t.trade_id, max(CASE direction WHEN 'BUY' THEN high - entry_price ELSE entry_price - low END)::DOUBLE AS mfe, max(CASE direction WHEN 'BUY' THEN entry_price - low ELSE high - entry_price END)::DOUBLE AS mae, count(*) AS n_bars FROM t JOIN bars b ON t.symbol = b.symbol AND b.bar_time >= t.entry_time AND b.bar_time < t.close_time GROUP BY t.trade_id)"
    + ", p AS (SELECT *, CASE WHEN trade_id % 10 <> 0 THEN 0.01::DOUBLE END AS point, (trade_id % 3 + 1)::DOUBLE AS volume FROM x)"
    + " SELECT trade_id, mfe, mae, n_bars, mfe / point AS mfe_points, mae / point AS mae_points, greatest(mfe, 0) / 0.25::DOUBLE * 2.0::DOUBLE * volume AS max_floating_profit, greatest(mae, 0) / 0.25::DOUBLE * 2.0::DOUBLE * volume AS max_floating_drawdown, 'M1_BARS' AS excursion_source FROM p"
)
def excursions(spark: SparkSession, d: str) -> DataFrame:
    """Excursions of trades opened at each tick and held for up to 39 hours, over hourly bars."""
    ticks = driver.ticks(spark, d)
    key = F.col("event_id")
    t = ticks.select(key.alias("trade_id"), "symbol", F.when(key % 2 == 0, "BUY").otherwise("SELL").alias("direction"), F.col("ts").alias("entry_time"), F.expr("ts + make_interval(0, 0, 0, 0, int(event_id % 40))").alias("close_time"), F.col("price").alias("entry_price"))
    t = t.withColumns({"point": F.when(F.col("trade_id") % 10 != 0, F.lit(0.01)), "tick_size": F.lit(0.25), "tick_value": F.lit(2.0), "volume": F.col("trade_id") % 3 + 1})
    out = lifecycle.excursions(t, bar_ops.bars_from_ticks(ticks, 3600))
    return out.withColumns({"mfe": F.col("mfe").cast("double"), "mae": F.col("mae").cast("double")})


REENTRY = (
    ", g AS (SELECT trade_id, account_id % 10 AS account_id, symbol, direction, entry_time, close_time FROM trades), r AS (SELECT *, lag(close_time) OVER w AS pc, lag(trade_id) OVER w AS pt FROM g WINDOW w AS (PARTITION BY account_id, symbol, direction ORDER BY entry_time, trade_id)),"
    " l AS (SELECT *, CASE WHEN epoch(entry_time) - epoch(pc) BETWEEN 0 AND 10080 * 60 THEN pt END AS reentry FROM r)"
)


def _reentries(spark: SparkSession, d: str) -> DataFrame:
    trades = driver.trades(spark, d).withColumn("account_id", F.col("account_id") % 10)
    return lifecycle.reentries(trades.select("trade_id", *lifecycle.GROUP, "entry_time", "close_time"), 10080)


@query(with_("trades") + REENTRY + " SELECT trade_id, reentry AS reentry_of_trade_id, reentry IS NOT NULL AS is_inferred FROM l")
def reentry_link(spark: SparkSession, d: str) -> DataFrame:
    return _reentries(spark, d).select("trade_id", "reentry_of_trade_id", "is_inferred")


@query(
    with_("trades").replace("WITH ", "WITH RECURSIVE ", 1)
    + REENTRY
    + ", c AS (SELECT trade_id, trade_id AS root_trade_id, 0::BIGINT AS depth FROM l WHERE reentry IS NULL UNION ALL SELECT l.trade_id, c.root_trade_id, c.depth + 1 FROM l JOIN c ON l.reentry = c.trade_id) SELECT trade_id, root_trade_id, depth FROM c"
)
def reentry_chain(spark: SparkSession, d: str) -> DataFrame:
    trades = driver.trades(spark, d).withColumn("account_id", F.col("account_id") % 10)
    return lifecycle.inferred_chains(trades.select("trade_id", *lifecycle.GROUP, "entry_time", "close_time"), 10080).select("trade_id", "root_trade_id", "depth")


@query(
    "WITH RECURSIVE k AS (SELECT o_orderkey AS id FROM orders), w AS (SELECT id, CASE WHEN id % 200 < 3 THEN NULL WHEN id % 101 = 0 THEN id + 1 WHEN id % 13 = 0 THEN id - 32 ELSE id - id % 3 - 1 END AS a FROM k),"
    " l AS (SELECT w.id, k.id AS parent FROM w LEFT JOIN k ON w.a = k.id),"
    " c AS (SELECT id, id AS root, 0::BIGINT AS depth FROM l WHERE parent IS NULL UNION ALL SELECT l.id, c.root, c.depth + 1 FROM l JOIN c ON l.parent = c.id),"
    " u AS (SELECT id, parent FROM l WHERE id NOT IN (SELECT id FROM c)), v AS (SELECT id, parent AS up FROM u UNION SELECT v.id, u.parent FROM v JOIN u ON v.up = u.id),"
    " r AS (SELECT a.id, min(b.up) AS cycle_id FROM v a JOIN v b ON a.up = b.id WHERE a.up IN (SELECT id FROM v WHERE id = up) GROUP BY a.id)"
    " SELECT id AS trade_id, root AS root_trade_id, depth, NULL::BIGINT AS cycle_id FROM c UNION ALL SELECT id, NULL, NULL, cycle_id FROM r"
)
def reentry_chain_given(spark: SparkSession, d: str) -> DataFrame:
    """Chains over stored links, which skip trades, cross accounts and symbols, end at missing trades, and at times run in cycles."""
    o = driver.read(spark, d, "orders").select(F.col("o_orderkey").alias("trade_id"))
    key = F.col("trade_id")
    above = F.when(key % 200 < 3, None).when(key % 101 == 0, key + 1).when(key % 13 == 0, key - 32).otherwise(key - key % 3 - 1)
    return chains.chains(o.withColumn("reentry_of_trade_id", above))


@query(
    with_("trades", "deployments")
    + MATCHED
    + ", n AS (SELECT trade_id, count(*) AS n FROM m GROUP BY trade_id), f AS (SELECT t.trade_id, t.trade_id % 6 = 0 AS a, n.n IS NULL AS b, coalesce(t.close_time < t.entry_time, FALSE) AS c FROM trades t LEFT JOIN n ON t.trade_id = n.trade_id)"
    + """ SELECT trade_id, '{' || array_to_string([e FOR e IN [CASE WHEN a THEN '"no_stop":true' END, CASE WHEN b THEN '"unassigned":true' END, CASE WHEN c THEN '"close_before_entry":true' END] IF e IS NOT NULL], ',') || '}' AS data_quality FROM f"""
)
def data_quality(spark: SparkSession, d: str) -> DataFrame:
    t = lifecycle.attribute(driver.trades(spark, d), driver.deployments(spark, d)).withColumn("initial_sl", F.when(F.col("trade_id") % 6 != 0, F.col("entry_price")))
    return t.select("trade_id", lifecycle.data_quality(t).alias("data_quality"))


@query(
    with_("deals", "trades")
    + " SELECT t.trade_id, t.direction, count(*) AS n_deals, string_agg(d.seq || ':' || epoch(d.at)::BIGINT, ',' ORDER BY d.seq) AS deals FROM trades t JOIN deals d ON t.trade_id = d.trade_id GROUP BY ALL"
)
def trade_navigation(spark: SparkSession, d: str) -> DataFrame:
    """From trades to their deals, in order; a trade has few of them."""
    listed = driver.numbered_deals(spark, d).groupBy("trade_id").agg(F.sort_array(F.collect_list(F.struct("seq", sec("at").alias("at")))).alias("deals"))
    shown = F.array_join(F.transform("deals", lambda x: F.concat_ws(":", x["seq"], x["at"])), ",")
    return driver.trades(spark, d).join(listed, "trade_id").select("trade_id", "direction", F.size("deals").cast("long").alias("n_deals"), shown.alias("deals"))


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 120 WHEN 1 THEN -300 ELSE (floor((event_id % 7 * 900 + event_id % 300 - 150 + 450) / 900) * 15)::BIGINT END AS offset_minutes FROM events"
)
def server_offset(spark: SparkSession, d: str) -> DataFrame:
    """Offset of a server clock from UTC: fixed by the broker, or from paired times that differ by up to some minutes."""
    e = driver.read(spark, d, "events")
    server = F.timestamp_seconds(sec("ts") + F.col("event_id") % 7 * 900 + F.col("event_id") % 300 - 150).cast("timestamp_ntz")
    policy = F.when(F.col("event_id") % 4 == 0, "FIXED:120").when(F.col("event_id") % 4 == 1, "FIXED:-300").when(F.col("event_id") % 4 == 2, "EA_REPORTED")
    return e.select("event_id", lifecycle.server_offset_minutes(server, F.col("ts"), policy).alias("offset_minutes"))


@query(
    "WITH r AS (SELECT event_id, user_id % 7 AS server, ts, date_trunc('day', ts) AS day, CASE WHEN event_id % 37 = 0 THEN 300 WHEN user_id % 7 = 6 THEN 120 WHEN ts >= TIMESTAMP '2024-01-20 02:00:00' THEN 120 WHEN ts >= TIMESTAMP '2024-01-10 01:00:00' THEN 180 ELSE 120 END AS o FROM events),"
    " k AS (SELECT server, o, min(ts) AS began FROM r WHERE event_id % 37 <> 0 AND (o = 180 OR ts < TIMESTAMP '2024-01-10 01:00:00' OR server = 6) GROUP BY ALL"
    " UNION ALL SELECT server, o, min(ts) FROM r WHERE event_id % 37 <> 0 AND server <> 6 AND ts >= TIMESTAMP '2024-01-20 02:00:00' GROUP BY ALL)"
    " SELECT server, o AS offset_minutes, row_number() OVER w AS change, epoch(date_trunc('day', began))::BIGINT AS from_day, epoch(date_trunc('day', lead(began) OVER w))::BIGINT AS until_day FROM k WINDOW w AS (PARTITION BY server ORDER BY began)"
)
def clock_changes(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of servers' clocks from paired times: two changes on six servers, none on the seventh, and one reading in 37 off by hours.
    The times of change are those of the first reading after them, told by the day."""
    e = driver.read(spark, d, "events")
    ts, server = F.col("ts"), F.col("user_id") % 7
    true = F.when(server == 6, 120).when(ts >= F.lit("2024-01-20 02:00:00").cast("timestamp"), 120).when(ts >= F.lit("2024-01-10 01:00:00").cast("timestamp"), 180).otherwise(120)
    offset = F.when(F.col("event_id") % 37 == 0, 300).otherwise(true)
    readings = e.select(server.alias("server"), ts.alias("utc_time"), F.timestamp_seconds(sec("ts") + offset * 60 + F.col("event_id") % 300 - 150).cast("timestamp_ntz").alias("server_time"))
    out = lifecycle.clock_offsets(readings)
    w = Window.partitionBy("server").orderBy("valid_from")
    day = lambda c: sec(F.date_trunc("DAY", c))
    return out.select("server", "offset_minutes", F.row_number().over(w).cast("long").alias("change"), day("valid_from").alias("from_day"), day("valid_until").alias("until_day"))


PARTS = (
    with_("msgs")
    + ", s AS (SELECT *, CASE WHEN NOT is_deal THEN 0 WHEN side = 'BUY' THEN volume ELSE -volume END AS signed FROM msgs),"
    + " b AS (SELECT *, coalesce(sum(signed) OVER (PARTITION BY account_id, symbol ORDER BY sent_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),"
    + " c AS (SELECT *, abs(before) AS held, CASE WHEN before * signed < 0 THEN least(abs(before), volume) ELSE 0 END AS closed FROM b),"
    + " p AS (SELECT *, 0 AS part, FALSE AS is_entry, FALSE AS starts, closed AS v, held - closed AS after FROM c WHERE closed > 0"
    + " UNION ALL SELECT *, 1, TRUE, closed = held, volume - closed, CASE WHEN closed = held THEN volume - closed ELSE held + volume END FROM c WHERE is_deal AND volume > closed"
    + " UNION ALL SELECT *, 0, FALSE, FALSE, 0, held FROM c WHERE NOT is_deal AND held > 0),"
    + " n AS (SELECT *, account_id || ':' || symbol || ':' || (sum(starts::INT) OVER (PARTITION BY account_id, symbol ORDER BY sent_at, id, part))::BIGINT AS trade_id, is_deal AND (NOT is_entry OR closed = 0) AS owner, is_deal AND NOT is_entry AS leaves FROM p),"
    + " f AS (SELECT trade_id, account_id, symbol, max(side) FILTER (starts) AS direction, max(sent_at) FILTER (starts) AS entry_time, (max(price) FILTER (starts))::DOUBLE AS entry_price, (max(sl) FILTER (starts))::DOUBLE AS initial_sl, (max(tp) FILTER (starts))::DOUBLE AS initial_tp,"
    + " (max(v) FILTER (starts))::DOUBLE AS initial_volume, max(after)::DOUBLE AS max_volume, max(sent_at) FILTER (leaves AND after = 0) AS close_time, (sum(price * v) FILTER (leaves) * 100)::HUGEINT AS am, (sum(v) FILTER (leaves))::HUGEINT AS vol,"
    + " coalesce(sum(profit) FILTER (owner), 0)::DOUBLE AS gross_profit, coalesce(sum(commission) FILTER (owner), 0)::DOUBLE AS commission, 0.0::DOUBLE AS swap, coalesce(sum(profit + commission) FILTER (owner), 0)::DOUBLE AS net_profit,"
    + " CASE WHEN count(*) FILTER (leaves) = 0 THEN NULL WHEN count(reason) FILTER (leaves) = 0 THEN 'UNKNOWN' WHEN count(DISTINCT reason) FILTER (leaves) > 1 THEN 'MIXED' ELSE max(reason) FILTER (leaves) END AS exit_reason FROM n GROUP BY ALL)"
)
REENTRY_MINUTES = 24 * 60


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return rebuild.parts(rebuild.parse(driver.messages(spark, d)))


@query(
    PARTS
    + " SELECT trade_id, account_id, symbol, direction, epoch(entry_time)::BIGINT AS entry_time, entry_price, initial_sl, initial_tp, initial_volume, max_volume, epoch(close_time)::BIGINT AS close_time, ((2 * am * 10000 + vol) // (2 * vol))::DOUBLE / 1000000.0::DOUBLE AS close_price,"
    + " gross_profit, commission, swap, net_profit, exit_reason, CASE WHEN close_time IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status, epoch(close_time)::BIGINT - epoch(entry_time)::BIGINT AS duration_seconds FROM f"
)
def trade_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """Trades from raw messages, some of which came twice or cannot be read."""
    out = rebuild.trades(_parts(spark, d)).withColumn("close_price", F.round("close_price", 6))
    return out.select([F.col(c).cast("double").alias(c) if t.startswith("decimal") else sec(c).alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])


@query(
    PARTS
    + ", l AS (SELECT trade_id, sent_at, is_deal, sl IS DISTINCT FROM lag(sl) OVER w AS s, tp IS DISTINCT FROM lag(tp) OVER w AS t FROM n WHERE starts OR NOT is_deal WINDOW w AS (PARTITION BY trade_id ORDER BY sent_at, id, part)),"
    + " q AS (SELECT trade_id, entry_time, lag(close_time) OVER (PARTITION BY account_id, symbol, direction ORDER BY entry_time, trade_id) AS pc FROM f),"
    + " e AS (SELECT trade_id, CASE WHEN starts THEN 'TRADE_OPENED' WHEN is_entry THEN 'POSITION_INCREASED' WHEN after = 0 THEN 'TRADE_CLOSED' WHEN entry = 'OUT' THEN 'PARTIAL_CLOSE' ELSE 'POSITION_DECREASED' END AS event_type, sent_at, ticket AS deal_ticket, v::DOUBLE AS volume, FALSE AS is_inferred FROM n WHERE is_deal"
    + " UNION ALL SELECT trade_id, 'SL_MODIFIED', sent_at, NULL, NULL, FALSE FROM l WHERE s AND NOT is_deal UNION ALL SELECT trade_id, 'TP_MODIFIED', sent_at, NULL, NULL, FALSE FROM l WHERE t AND NOT is_deal"
    + f" UNION ALL SELECT trade_id, 'REENTRY', entry_time, NULL, NULL, TRUE FROM q WHERE epoch(entry_time)::BIGINT - epoch(pc)::BIGINT BETWEEN 0 AND {REENTRY_MINUTES * 60})"
    + " SELECT trade_id, event_type, epoch(sent_at)::BIGINT AS event_time, deal_ticket, volume, is_inferred FROM e"
)
def trade_events_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The events of the rebuilt trades, of all eight types."""
    cut = materialize(_parts(spark, d))
    out = rebuild.events(cut, rebuild.trades(cut), REENTRY_MINUTES)
    return out.select("trade_id", "event_type", sec("event_time").alias("event_time"), "deal_ticket", F.col("volume").cast("double"), "is_inferred")


@query("SELECT event_id AS id, 'unreadable payload' AS error FROM events WHERE event_id % 97 = 0")
def unreadable_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages that cannot be used, for the queue to mark as failed."""
    return rebuild.parse(driver.messages(spark, d)).where("error IS NOT NULL").select("id", "error")


@query(
    "WITH m AS (SELECT event_id AS id, CASE WHEN event_id % 89 = 0 THEN 'no account' WHEN event_id % 83 = 0 THEN 'no time' WHEN event_id % 97 = 0 THEN 'unreadable payload' END AS error FROM events)"
    " SELECT id, error FROM m WHERE error IS NOT NULL UNION ALL SELECT id + 1000000000, error FROM m WHERE error = 'no account' AND id % 10 = 0"
)
def unplaced_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages some of which lack the account or the time: none of them vanishes. Without an account, each sending counts."""
    m = driver.messages(spark, d)
    key = F.col("id") % 10**9
    m = m.withColumns({"account_id": F.when(key % 89 != 0, F.col("account_id")), "sent_at": F.when(key % 83 != 0, F.col("sent_at"))})
    parsed = rebuild.parse(m)
    placed = rebuild.parts(parsed).select("id").distinct()
    stops = parsed.where("kind = 'STOPS' AND error IS NULL").select("id")  # without an open trade these do nothing
    lost = parsed.where("error IS NULL").join(placed, "id", "left_anti").join(stops, "id", "left_anti").select("id", F.lit("lost").alias("error"))
    return parsed.where("error IS NOT NULL").select("id", "error").unionByName(lost)
