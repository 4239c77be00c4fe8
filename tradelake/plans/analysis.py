"""Queries of research, monitoring and streaming, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelake.functions.common import json_hash
from tradelake.functions.tables import stream_folder
from tradelake.operators import lifecycle, monitor, research
from tradelake.plans.integrity import query, sec
from tradelake.plans.market import _shown
from tradelake.plans.trading import BARS, NET, PNL
from tradelake.sources import driver
from tradelake.sources.driver import with_
from tradelake.streaming import pipelines


def _net(spark: SparkSession, d: str) -> DataFrame:
    """Trades with their net profit, bot (supplier of the first deal) and version."""
    first = F.min_by("l_suppkey", "order").alias("bot_id")
    return driver.deals(spark, d).groupBy("trade_id").agg(F.sum(F.expr(NET)).alias("net_profit"), first, F.min("at").alias("entry_time"))


NETS = f", nets AS (SELECT trade_id, sum({NET}) AS net_profit, min_by(l_suppkey, seq) AS bot_id, min(deals.at) AS entry_time FROM deals GROUP BY trade_id)"
SEG = ", seg AS (SELECT *, CASE WHEN entry_time <= TIMESTAMP '1995-01-01' THEN 'TRAIN' WHEN entry_time <= TIMESTAMP '1996-06-01' THEN 'VALIDATION' WHEN entry_time <= TIMESTAMP '1997-06-01' THEN 'OOS' ELSE 'FORWARD' END AS segment FROM nets)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    cuts = [F.lit(x).cast("timestamp") for x in ("1995-01-01", "1996-06-01", "1997-06-01")]
    return _net(spark, d).withColumn("segment", research.segment(F.col("entry_time"), *cuts))


@query(with_("deals") + NETS + SEG + " SELECT trade_id, segment FROM seg")
def split_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).select("trade_id", "segment")


CONDITION = {"or": [{"and": [{"field": "direction", "op": "=", "value": "BUY"}, {"field": "magic_number", "op": "in", "value": [1, 3]}]}, {"not": {"field": "entry_price", "op": ">=", "value": 1000}}]}


@query(with_("trades") + " SELECT trade_id FROM trades WHERE symbol = '1-URGENT' AND ((direction = 'BUY' AND magic_number IN (1, 3)) OR NOT entry_price >= 1000)")
def condition_filter(spark: SparkSession, d: str) -> DataFrame:
    """A compiled condition within a scope."""
    fields = ["direction", "magic_number", "entry_price", "symbol"]
    keep = research.condition(CONDITION, fields) & research.scope({"symbol": "1-URGENT"}, fields)
    return driver.trades(spark, d).where(keep).select("trade_id")


STATS = ", st AS (SELECT {keys}, count(net_profit) AS n, (count(*) FILTER (net_profit > 0))::BIGINT AS wins, sum(net_profit)::DOUBLE AS total, coalesce(sum(net_profit) FILTER (net_profit > 0), 0)::DOUBLE AS won, (sum(-net_profit) FILTER (net_profit < 0))::DOUBLE AS lost, sum((net_profit * net_profit)::DECIMAL(38,8))::DOUBLE AS sq FROM {rows} GROUP BY {keys})"
STATS_OUT = "n, wins, wins / n::DOUBLE AS win_rate, total / n::DOUBLE AS expectancy, won / nullif(lost, 0) AS profit_factor"


@query(with_("deals") + NETS + SEG + STATS.format(keys="segment", rows="seg") + f" SELECT segment, {STATS_OUT} FROM st")
def segment_stats(spark: SparkSession, d: str) -> DataFrame:
    return research.statistics(_segments(spark, d), ["segment"]).select("segment", "n", "wins", "win_rate", "expectancy", "profit_factor")


@query(
    with_("deals")
    + NETS
    + SEG
    + STATS.format(keys="segment, bot_id", rows="seg")
    + ", w AS (SELECT *, wins / n::DOUBLE AS p, 1.959963984540054::DOUBLE AS z, n::DOUBLE AS m FROM st)"
    + " SELECT segment, bot_id, round((p + z * z / (2 * m) - z * sqrt((p * (1 - p) + z * z / (4 * m)) / m)) / (1 + z * z / m), 9) AS ci_low, round((p + z * z / (2 * m) + z * sqrt((p * (1 - p) + z * z / (4 * m)) / m)) / (1 + z * z / m), 9) AS ci_high FROM w"
)
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the win rate per segment and bot."""
    s = research.statistics(_segments(spark, d), ["segment", "bot_id"])
    low, high = research.wilson(F.col("wins"), F.col("n"))
    return s.select("segment", "bot_id", F.round(low, 9).alias("ci_low"), F.round(high, 9).alias("ci_high"))


@query(
    with_("deals")
    + NETS
    + SEG
    + STATS.format(keys="segment, bot_id", rows="seg")
    + ", v AS (SELECT segment, bot_id, total / n AS m, 1.959963984540054::DOUBLE * sqrt(CASE WHEN n > 1 THEN (sq - total * total / n) / (n - 1) END / n) AS h FROM st) SELECT segment, bot_id, round(m - h, 4) AS ci_low, round(m + h, 4) AS ci_high FROM v"
)
def mean_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the mean result per segment and bot."""
    s = research.statistics(_segments(spark, d), ["segment", "bot_id"])
    low, high = research.mean_interval(F.col("expectancy"), research.variance(), F.col("n"))
    return s.select("segment", "bot_id", F.round(low, 4).alias("ci_low"), F.round(high, 4).alias("ci_high"))


ZED = ", z AS (SELECT bot_id, n, CASE WHEN n > 1 THEN (sq - total * total / n) / (n - 1) END AS var, total / n AS mean FROM st), zz AS (SELECT bot_id, n, mean / nullif(sqrt(var / n), 0) AS z FROM z)"


def _tests(spark: SparkSession, d: str) -> DataFrame:
    s = research.statistics(_segments(spark, d), ["bot_id"])
    return s.select("bot_id", "n", research.z_statistic(F.col("expectancy"), research.variance(), F.col("n")).alias("z"))


@query(with_("deals") + NETS + SEG + STATS.format(keys="bot_id", rows="seg") + ZED + " SELECT bot_id, n, round(z, 6) AS z FROM zz WHERE z IS NOT NULL")
def z_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Test statistic of each bot's mean result."""
    return _tests(spark, d).where("z IS NOT NULL").select("bot_id", "n", F.round("z", 6).alias("z"))


POLY = "0.3989422804014327::DOUBLE * exp(-z * z / 2) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE))))"
PS = f", pv AS (SELECT bot_id, bot_id % 4 AS family, 2 * {POLY} AS p FROM (SELECT bot_id, abs(z) AS z, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM zz WHERE z IS NOT NULL))"


def _p(spark: SparkSession, d: str) -> DataFrame:
    t = _tests(spark, d).where("z IS NOT NULL")
    return t.select("bot_id", (F.col("bot_id") % 4).alias("family"), research.p_value(F.col("z")).alias("p"))


@query(with_("deals") + NETS + SEG + STATS.format(keys="bot_id", rows="seg") + ZED + PS + " SELECT bot_id, round(p, 6) AS p_value, round(least(1, p * count(*) OVER (PARTITION BY family)), 6) AS p_adjusted FROM pv")
def bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided p-values and their adjustment by the size of the family."""
    size = F.count("*").over(Window.partitionBy("family"))
    return _p(spark, d).select("bot_id", F.round("p", 6).alias("p_value"), F.round(research.bonferroni(F.col("p"), size), 6).alias("p_adjusted"))


@query(
    with_("deals")
    + NETS
    + SEG
    + STATS.format(keys="bot_id", rows="seg")
    + ZED
    + PS
    + ", hs AS (SELECT *, least(1, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, bot_id) + 1)) AS s FROM pv) SELECT bot_id, round(max(s) OVER (PARTITION BY family ORDER BY p, bot_id ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM hs"
)
def holm(spark: SparkSession, d: str) -> DataFrame:
    return research.holm(_p(spark, d), ["family"], "p", "bot_id").select("bot_id", F.round("p_holm", 6).alias("p_holm"))


@query(
    with_("deals")
    + NETS
    + ", x AS (SELECT bot_id % 5 AS family, trade_id, net_profit AS net FROM nets), b AS (SELECT *, unnest(range(0, 5)) AS block FROM x), g AS (SELECT *, md5('5:' || trade_id || ':' || block) AS h FROM b),"
    + " e AS (SELECT family, net, h, block, unnest(range(0, 8)) AS i FROM g), r AS (SELECT family, net, block * 8 + i AS rep, ('0x' || substr(h, (1 + i * 4)::INT, 4))::INT AS d FROM e),"
    + " w AS (SELECT family, rep, net, (d >= 24109)::INT + (d >= 48219)::INT + (d >= 60273)::INT + (d >= 64292)::INT + (d >= 65296)::INT + (d >= 65497)::INT + (d >= 65531)::INT + (d >= 65535)::INT AS w FROM r),"
    + " s AS (SELECT family, rep, count(*) AS n, sum(w * net)::DOUBLE / nullif(sum(w), 0)::DOUBLE AS e, coalesce(sum(w * net) FILTER (net > 0), 0)::DOUBLE / nullif(sum(-w * net) FILTER (net < 0), 0)::DOUBLE AS f FROM w GROUP BY ALL),"
    + " l AS (SELECT family, max(n) AS n, list_sort(list(e) FILTER (e IS NOT NULL)) AS e, list_sort(list(f) FILTER (f IS NOT NULL)) AS f FROM s GROUP BY family)"
    + " SELECT family, n, round(e[greatest(ceil(len(e) * 0.025), 1)::INT], 6) AS expectancy_low, round(e[greatest(ceil(len(e) * 0.975), 1)::INT], 6) AS expectancy_high, round(f[greatest(ceil(len(f) * 0.025), 1)::INT], 6) AS factor_low, round(f[greatest(ceil(len(f) * 0.975), 1)::INT], 6) AS factor_high FROM l"
)
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap intervals of expectancy and profit factor of five families of bots, by 40 replicates."""
    out = research.bootstrap(_net(spark, d).withColumn("family", F.col("bot_id") % 5), ["family"], "trade_id", replicates=40)
    return out.select("family", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


#: Student's t of whole degrees of freedom by its finite sum over cosines; the binomial by its terms.
EXACT = (
    ", x AS (SELECT bot_id, trade_id % 40 AS slot, count(*) AS n, count(*) FILTER (net_profit > 0) AS wins, avg(net_profit::DOUBLE) AS mean, var_samp(net_profit::DOUBLE) AS var FROM nets GROUP BY ALL),"
    " y AS (SELECT *, n - 1 AS v, mean / nullif(sqrt(var / n), 0) AS t FROM x), a AS (SELECT *, atan(abs(t) / sqrt(v)) AS th FROM y WHERE v > 0 AND t IS NOT NULL),"
    " s AS (SELECT bot_id, slot, th, v, CASE WHEN v % 2 = 1 THEN 2 / pi() * (th + CASE WHEN v > 1 THEN sin(th) * list_sum([exp((2 * j + 1) * ln(cos(th)) + 2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) FOR j IN range(((v - 1) // 2)::BIGINT)]) ELSE 0 END)"
    " ELSE sin(th) * list_sum([exp(2 * j * ln(cos(th)) + lgamma(2 * j + 1) - 2 * j * ln(2) - 2 * lgamma(j + 1)) FOR j IN range((v // 2)::BIGINT)]) END AS within FROM a),"
    " b AS (SELECT bot_id, slot, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.4) + (n - i) * ln(0.6)) FOR i IN range(wins, n + 1)]) AS up, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.4) + (n - i) * ln(0.6)) FOR i IN range(0, wins + 1)]) AS down FROM x)"
)


@query(
    with_("deals")
    + NETS
    + EXACT
    + " SELECT x.bot_id, x.slot, x.n, x.wins, round(1 - within, 7) AS mean_p, CASE WHEN within IS NOT NULL THEN 'student_t' END AS mean_method, round(least(1, 2 * least(up, down)), 7) AS share_p, 'exact_binomial' AS share_method"
    + " FROM x JOIN b ON x.bot_id = b.bot_id AND x.slot = b.slot LEFT JOIN s ON x.bot_id = s.bot_id AND x.slot = s.slot"
)
def small_sample_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests of the mean result against 0 and of the win rate against 0.4, for small groups of a bot's trades."""
    s = research.statistics(_net(spark, d).withColumn("slot", F.col("trade_id") % 40), ["bot_id", "slot"])
    mean, mean_method = research.mean_test(F.col("expectancy"), research.variance(), F.col("n"))
    share, share_method = research.share_test(F.col("wins"), F.col("n"), F.lit(0.4))
    return s.select("bot_id", "slot", "n", "wins", F.round(mean, 7).alias("mean_p"), mean_method.alias("mean_method"), F.round(share, 7).alias("share_p"), share_method.alias("share_method"))


@query(
    with_("deals")
    + NETS
    + " SELECT bot_id, trade_id % 3 AS version, count(net_profit) AS n, (count(*) FILTER (net_profit > 0))::DOUBLE / count(net_profit) AS win_rate, sum(net_profit)::DOUBLE / count(net_profit) AS expectancy, grouping(bot_id, trade_id % 3)::BIGINT AS level FROM nets GROUP BY ROLLUP (bot_id, trade_id % 3)"
)
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = _net(spark, d).withColumn("version", F.col("trade_id") % 3)
    return research.compare_versions(rows).select("bot_id", "version", "n", "win_rate", "expectancy", "level")


@query(
    with_("deals")
    + NETS
    + ", v AS (SELECT bot_id AS version_id, count(*) AS n, sum(net_profit)::DOUBLE / count(*) AS e FROM nets GROUP BY bot_id), x AS (SELECT 'EXP-' || s_suppkey AS code, s_suppkey AS base, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey + 1 END AS candidate FROM supplier)"
    + " SELECT code, b.n AS base_n, c.n AS candidate_n, c.e - b.e AS delta FROM x JOIN v b ON b.version_id = base LEFT JOIN v c ON c.version_id = candidate"
)
def experiment_delta(spark: SparkSession, d: str) -> DataFrame:
    """Base against candidate; experiments without a candidate stay."""
    stats = research.statistics(_net(spark, d), ["bot_id"]).withColumnRenamed("bot_id", "version_id")
    k = F.col("s_suppkey")
    x = driver.read(spark, d, "supplier").select(F.concat(F.lit("EXP-"), k.cast("string")).alias("code"), k.alias("base"), F.when(k % 3 != 0, k + 1).alias("candidate"))
    return research.experiment_delta(x, stats).select("code", "base_n", "candidate_n", "delta")


@query(
    with_("deals")
    + NETS
    + " SELECT trade_id, kind, code, evidence FROM (SELECT trade_id, 'FACT' AS kind, 'large_loss' AS code, '{\"trade_id\":' || trade_id || '}' AS evidence FROM nets WHERE net_profit < -1000 UNION ALL SELECT trade_id, 'HYPOTHESIS', 'late_entry', '{\"bot_id\":' || bot_id || '}' FROM nets WHERE entry_time >= TIMESTAMP '1996-01-01')"
)
def findings(spark: SparkSession, d: str) -> DataFrame:
    """Facts and hypotheses found in trades, with their evidence."""
    rules = {
        "large_loss": ("FACT", F.col("net_profit") < -1000, F.to_json(F.struct("trade_id"))),
        "late_entry": ("HYPOTHESIS", F.col("entry_time") >= F.lit("1996-01-01").cast("timestamp"), F.to_json(F.struct("bot_id"))),
    }
    return research.findings(_net(spark, d), rules).select("trade_id", "kind", "code", "evidence")


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events")
def payload_extract(spark: SparkSession, d: str) -> DataFrame:
    return driver.read(spark, d, "events").select("event_id", research.metric(F.col("props"), "k").alias("k"))


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","size":' || p_size || '}') AS params_hash FROM part""")
def params_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of parameters that are written with other spacing and key order."""
    params = F.concat(F.lit('{ "size" : '), F.col("p_size").cast("string"), F.lit(', "brand":"'), F.col("p_brand"), F.lit('"}'))
    return driver.read(spark, d, "part").select("p_partkey", json_hash(params).alias("params_hash"))


@query(
    with_("deals", "trades")
    + PNL
    + ", e AS (SELECT t.account_id, t.trade_id, t.entry_time, (10000 + sum(p.net) OVER w)::DECIMAL(20,4) AS equity FROM trades t JOIN p ON t.trade_id = p.trade_id WINDOW w AS (PARTITION BY t.account_id ORDER BY t.entry_time, t.trade_id ROWS UNBOUNDED PRECEDING)),"
    + " k AS (SELECT *, max(equity) OVER (PARTITION BY account_id ORDER BY entry_time, trade_id ROWS UNBOUNDED PRECEDING) AS peak FROM e) SELECT account_id, trade_id, equity::DOUBLE AS equity, equity::DOUBLE / nullif(peak::DOUBLE, 0) - 1 AS drawdown FROM k"
)
def equity_drawdown(spark: SparkSession, d: str) -> DataFrame:
    net = driver.deals(spark, d).groupBy("trade_id").agg(F.sum(F.expr(NET)).alias("net"))
    t = driver.trades(spark, d).join(net, "trade_id")
    t = monitor.equity(t.select("account_id", "trade_id", "entry_time", "net"), "account_id", ["entry_time", "trade_id"], "net", 10000)
    return monitor.drawdown(t, "account_id", ["entry_time", "trade_id"], "equity").select("account_id", "trade_id", F.col("equity").cast("double"), "drawdown")


@query(
    "WITH g AS (SELECT user_id, epoch(ts)::BIGINT AS a, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT AS b FROM events) SELECT user_id, a AS silent_from, b AS silent_until, (b - a) // 60 AS minutes FROM g WHERE b - a > 720 * 60"
)
def terminal_gaps(spark: SparkSession, d: str) -> DataFrame:
    out = monitor.silences(driver.read(spark, d, "events"), "user_id", "ts", 720)
    return out.select("user_id", sec("silent_from").alias("silent_from"), sec("silent_until").alias("silent_until"), "minutes")


@query("SELECT user_id, epoch(max(ts))::BIGINT AS last_seen_at, count(*) AS n FROM events GROUP BY user_id")
def last_seen(spark: SparkSession, d: str) -> DataFrame:
    return monitor.last_seen(driver.read(spark, d, "events"), "user_id", "ts").select("user_id", sec("last_seen_at").alias("last_seen_at"), "n")


SESSIONS = (
    "WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 3 HOUR, TRUE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),"
    " r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)"
    " SELECT user_id, epoch(min(ts))::BIGINT AS alive_from, epoch(max(ts) + INTERVAL 3 HOUR)::BIGINT AS alive_until, count(*) AS n FROM r GROUP BY user_id, run"
)


@query(SESSIONS)
def alive_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = monitor.alive_sessions(driver.read(spark, d, "events"), "user_id", "ts", "3 hours")
    return out.select("user_id", sec("alive_from").alias("alive_from"), sec("alive_until").alias("alive_until"), "n")


@query(
    with_("trades", "deals")
    + PNL
    + " SELECT 'unassigned_magic' AS rule, 'WARNING' AS severity, trade_id::VARCHAR AS subject, 'magic ' || magic_number AS message FROM trades WHERE status = 'OPEN' AND direction = 'BUY'"
    + " UNION ALL SELECT 'heavy_loss', 'CRITICAL', trade_id::VARCHAR, 'loss' FROM p WHERE net < -5000 AND trade_id % 2 = 0"
)
def open_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of two rules that are not acknowledged."""
    t = driver.trades(spark, d).where("status = 'OPEN'")
    net = driver.deals(spark, d).groupBy("trade_id").agg(F.sum(F.expr(NET)).alias("net")).where("net < -5000")
    rows = monitor.alerts(
        {
            "unassigned_magic": (t, "WARNING", F.col("trade_id"), F.concat(F.lit("magic "), F.col("magic_number").cast("string"))),
            "heavy_loss": (net, "CRITICAL", F.col("trade_id"), F.lit("loss")),
        }
    )
    # alerts of sold (odd) trades have been acknowledged
    acknowledged = F.when(F.col("subject").cast("long") % 2 == 1, F.lit("2024-01-01").cast("timestamp"))
    return monitor.open_alerts(rows.withColumn("acknowledged_at", acknowledged)).drop("acknowledged_at")


@query("SELECT c_custkey AS id FROM customer WHERE c_name[1:16] = (SELECT c_name[1:16] FROM customer WHERE c_custkey = 7) AND c_acctbal >= 0")
def active_client(spark: SparkSession, d: str) -> DataFrame:
    """Clients of a key prefix that are not revoked."""
    c = driver.read(spark, d, "customer")
    prefix = c.where("c_custkey = 7").select(F.substring("c_name", 1, 16).alias("p")).first().p
    clients = c.select(F.col("c_custkey").alias("id"), F.substring("c_name", 1, 16).alias("key_prefix"), F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp")).alias("revoked_at"))
    return monitor.active_clients(clients, prefix).select("id")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    batch = driver.read(spark, d, "events")  # also sets the zone
    raw = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(raw).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.select(*[F.col(c).cast(t).alias(c) for c, t in batch.dtypes])


@query(with_("ticks") + BARS + f" SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, tick_volume FROM bars WHERE bar_time + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)")
def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Closed hourly bars from a stream of ticks with a watermark of no delay."""
    ticks = _stream(spark, d).select("event_id", "ts", F.col("event_type").alias("symbol"), F.col("value").cast("decimal(24,10)").alias("price"))
    at = stream_folder(spark)
    return _shown(pipelines.run_to_end(pipelines.live_bars(ticks, "1 hour", "0 seconds"), f"{at}/bars", f"{at}/checkpoint", spark))


@query(with_("raw") + " SELECT terminal_id, idempotency_key, id FROM raw QUALIFY row_number() OVER (PARTITION BY terminal_id, idempotency_key ORDER BY sent_at, id) = 1")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The idempotent sink over a stream of events, run twice: the second run adds nothing."""
    e = _stream(spark, d)
    raw = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("terminal_id"), F.concat(F.lit("deal:"), (F.col("event_id") % 50).cast("string")).alias("idempotency_key"), F.col("ts").alias("sent_at"))
    at = stream_folder(spark)
    for turn in range(2):
        pipelines.idempotent_sink(raw, f"{at}/events", f"{at}/checkpoint{turn}", ["terminal_id", "idempotency_key"], [F.col("sent_at"), F.col("id")]).awaitTermination()
    return spark.read.parquet(f"{at}/events").select("terminal_id", "idempotency_key", "id")
