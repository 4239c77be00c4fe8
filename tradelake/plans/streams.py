"""Queries of streams with keyed state, each with its oracle. Messages arrive in several batches, out of order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradelake.functions.tables import stream_folder
from tradelake.operators import rebuild
from tradelake.plans.integrity import query, sec
from tradelake.plans.market import _shown
from tradelake.plans.trading import BARS, PARTS, REENTRY_MINUTES
from tradelake.sources import driver
from tradelake.sources.driver import with_
from tradelake.streaming import bar_store, state

#: Batches that messages arrive in, and days by which they are late at most.
BATCHES, LATE_DAYS = 4, 12


def _arrive(rows: DataFrame, at: str, folder: str, last: DataFrame, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Write rows batch by batch, every third row a batch later than its time says, the row `last` with the last ones; after each batch, `run`
    goes on with the stream of what has arrived."""
    spark = rows.sparkSession
    low, high = rows.agg(F.min(F.unix_timestamp(at)), F.max(F.unix_timestamp(at))).first()
    span = F.lit(max(1, high - low + 1))
    batch = F.floor((F.unix_timestamp(at) - low) * BATCHES / span) + F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    for b in range(BATCHES + 1):
        rows.where(batch == b).write.mode("append").parquet(folder)
        if b == BATCHES:
            last.select([F.col(c).cast(t) for c, t in rows.dtypes]).write.mode("append").parquet(folder)
        run(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


def _later(rows: DataFrame, at: str, days: int = 1000) -> DataFrame:
    """A row without anything but a time far behind all others, which ends the waiting."""
    end = rows.agg(F.timestamp_seconds(F.max(F.unix_timestamp(at)) + days * 86400).alias(at))
    return end.select([F.col(c) if c == at else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])


TURNS = (
    with_("raw")
    + ", x AS (SELECT terminal_id, idempotency_key, id, (id % 3)::INT AS run, sent_at, terminal_id::BIGINT + id % 50 AS seed FROM raw),"
    + " k AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY terminal_id, idempotency_key ORDER BY run, sent_at, id) = 1),"
    + " t AS (SELECT k.*, r.r::INT AS r, (seed + r.r) % 5 AS outcome FROM k JOIN (SELECT unnest([1, 2, 3]) AS r) r ON r.r > run),"
    + " f AS (SELECT terminal_id, idempotency_key, min(r) FILTER (outcome NOT IN (1, 2)) AS done, min_by(outcome, r) FILTER (outcome NOT IN (1, 2)) AS how FROM t GROUP BY ALL)"
    + " SELECT k.terminal_id, k.idempotency_key, k.id, CASE WHEN how = 0 THEN 'IGNORED' WHEN how IS NOT NULL THEN 'PROCESSED' WHEN 3 - run >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status,"
    + " coalesce(done, 3) - run AS attempts, CASE WHEN how IS NULL THEN 'bad payload' END AS error FROM k JOIN f ON k.terminal_id = f.terminal_id AND k.idempotency_key = f.idempotency_key"
)


@query(TURNS)
def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """Exactly-once ingest with a queue in the state: four runs of one stream, in which a third of the events arrives anew and others come again,
    with a result for each event of the runs before."""
    e = driver.raw_events(spark, d)
    base = e.select("terminal_id", "idempotency_key", "id", F.col("sent_at").alias("at"), F.lit(False).alias("is_result"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("string").alias("error"))
    folder = stream_folder(spark)
    for run in range(4):
        sent = base.where(F.col("id") % 3 == run)
        again = base.where(F.col("id") % 3 < run).withColumn("id", F.col("id") + 10**9)
        outcome = (F.col("terminal_id").cast("long") + F.col("id") % 10**9 % 50 + run) % 5
        known = again.withColumns({"is_result": F.lit(True), "outcome": outcome}).dropDuplicates(["terminal_id", "idempotency_key"])
        results = known.withColumns({"ok": F.when(F.col("outcome") != 0, ~F.col("outcome").isin(1, 2)), "error": F.when(F.col("outcome").isin(1, 2), "bad payload")}).drop("outcome")
        sent.unionByName(again).unionByName(results).coalesce(4).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(base.schema).parquet(f"{folder}/in")
        state.run_keyed(state.ingest_changes(source), f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    return state.queue_now(spark.read.parquet(f"{folder}/changes"))


def _live(spark: SparkSession, d: str) -> DataFrame:
    m = driver.messages(spark, d)
    folder = stream_folder(spark)

    def run(arriving: DataFrame) -> StreamingQuery:
        live = state.live_trades(rebuild.read_payload(arriving), f"{LATE_DAYS} days", REENTRY_MINUTES)
        return state.run_keyed(live, f"{folder}/live", f"{folder}/checkpoint")

    _arrive(m, "sent_at", f"{folder}/in", _later(m, "sent_at"), run)
    return spark.read.parquet(f"{folder}/live")


@query(
    PARTS
    + " SELECT trade_id, account_id, symbol, direction, epoch(entry_time)::BIGINT AS entry_time, entry_price, initial_sl, initial_tp, initial_volume, max_volume, epoch(close_time)::BIGINT AS close_time, ((2 * am * 10000 + vol) // (2 * vol))::DOUBLE / 1000000.0::DOUBLE AS close_price,"
    + " gross_profit, commission, swap, net_profit, exit_reason, epoch(close_time)::BIGINT - epoch(entry_time)::BIGINT AS duration_seconds FROM f WHERE close_time IS NOT NULL"
)
def stream_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades as they close, from messages that arrive out of order: those that trade_rebuild finds in the whole table."""
    out = _live(spark, d).where("event_type = 'TRADE_CLOSED'").drop("event_type", "event_time", "deal_ticket", "volume", "is_inferred").withColumn("close_price", F.round("close_price", 6))
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
def stream_trade_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of trades, open ones too, as the stream tells them."""
    return _live(spark, d).select("trade_id", "event_type", sec("event_time").alias("event_time"), "deal_ticket", F.col("volume").cast("double"), "is_inferred")


@query(with_("ticks") + BARS + " SELECT symbol, epoch(bar_time)::BIGINT AS bar_time, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, tick_volume FROM bars")
def bars_updated(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars brought up to date by four batches of ticks, in each of which some are late by a batch or more."""
    ticks, folder = driver.ticks(spark, d), stream_folder(spark)
    low, high = ticks.agg(F.min(sec("ts")), F.max(sec("ts"))).first()
    batch = F.floor((sec("ts") - low) * 3 / max(1, high - low + 1)) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    for b in range(4):
        bar_store.update(ticks.where(batch == b), f"{folder}/bars", 3600)
    return _shown(bar_store.shown(bar_store.read(spark, f"{folder}/bars")))


SILENT_MINUTES = 720


@query(
    "WITH g AS (SELECT user_id::VARCHAR AS terminal_id, epoch(ts)::BIGINT AS a, epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS b FROM events)"
    f" SELECT terminal_id, a AS silent_from, a + {SILENT_MINUTES * 60} AS opened_at, b AS closed_at FROM g WHERE b IS NULL OR b - a > {SILENT_MINUTES * 60}"
)
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """One alert for each silence of a terminal, opened by a timer and closed by its next sign of life; at the end all are silent."""
    beats = driver.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("terminal_id"), F.col("ts").alias("at"))
    folder = stream_folder(spark)

    def run(arriving: DataFrame) -> StreamingQuery:
        return state.run_keyed(state.silence_alerts(arriving, SILENT_MINUTES, f"{LATE_DAYS} days"), f"{folder}/alerts", f"{folder}/checkpoint")

    _arrive(beats, "at", f"{folder}/in", _later(beats, "at", LATE_DAYS + 30).withColumn("terminal_id", F.lit("end of the stream")), run)
    out = state.alerts_now(spark.read.parquet(f"{folder}/alerts"))
    return out.select("terminal_id", sec("silent_from").alias("silent_from"), sec("opened_at").alias("opened_at"), sec("closed_at").alias("closed_at"))
