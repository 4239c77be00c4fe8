"""Trades and their events from terminal messages, whatever their order of arrival: parse, net, cut into positions, fold.

A message has id, account_id, idempotency_key, sent_at and a JSON payload. Per account and symbol the signed volume is summed in
order; a position, which is a trade, lasts from a net volume of zero to the next one. A deal that turns the net volume over
closes one trade and opens the next. Sums run over pieces of an account's messages (series.py), so no task holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelake.functions.common import weighted_price
from tradelake.functions.tables import materialize
from tradelake.operators import lifecycle
from tradelake.operators.ingest import idempotent_insert
from tradelake.operators.series import numbered, running_sum

#: The fields of a payload.
PAYLOAD = (
    "kind string, symbol string, side string, entry string, ticket long, volume decimal(16,4), price decimal(24,10), profit decimal(20,4), "
    "commission decimal(20,4), swap decimal(20,4), sl decimal(24,10), tp decimal(24,10), reason string"
)
KEYS = ("account_id", "symbol")


def read_payload(messages: DataFrame) -> DataFrame:
    """messages (id, account_id, sent_at, payload) -> with the payload's fields and error, null if the message can be used: a deal
    with side, volume and price, or a change of stops, with account, symbol and time."""
    out = messages.withColumn("_p", F.from_json("payload", PAYLOAD)).drop("payload").select("*", "_p.*").drop("_p")
    whole = F.col("side").isin("BUY", "SELL") & (F.col("volume") > 0) & F.col("price").isNotNull()
    error = (
        F.when(F.col("account_id").isNull(), "no account")
        .when(F.col("sent_at").isNull(), "no time")
        .when(F.col("kind").isNull() | F.col("symbol").isNull(), "unreadable payload")
        .when(~F.col("kind").isin("DEAL", "STOPS"), "unknown kind")
        .when((F.col("kind") == "DEAL") & ~F.coalesce(whole, F.lit(False)), "incomplete deal")
    )
    return out.withColumn("error", error)


def parse(messages: DataFrame) -> DataFrame:
    """messages (id, account_id, idempotency_key, sent_at, payload), each key once -> read_payload() of them, written once. A message is
    either one without error, which parts() places, or it has an error."""
    first = idempotent_insert(messages, None, ["account_id", "idempotency_key"], [F.col("sent_at"), F.col("id")])
    return materialize(read_payload(first).drop("idempotency_key"))


def parts(parsed: DataFrame) -> DataFrame:
    """parse() rows without error -> a row for what each message does to a trade: trade_id, the message's fields, part, is_deal,
    is_entry, starts (opens the trade), volume, and position_volume after it. Changes of stops without an open trade go."""
    signed = F.when(F.col("kind") == "DEAL", lifecycle.sign(F.col("side")) * F.col("volume")).otherwise(0).cast("decimal(20,4)")
    rows = numbered(parsed.where("error IS NULL").withColumn("_signed", signed), KEYS, "sent_at", ["id"])
    rows = materialize(rows)  # the sums below read them twice
    net = running_sum(rows, {"_net": F.col("_signed")}, KEYS).withColumn("_before", (F.col("_net") - F.col("_signed")).cast("decimal(20,4)"))
    held, against = F.abs("_before"), F.col("_before") * F.col("_signed") < 0
    closed = F.when(against, F.least(held, F.col("volume"))).otherwise(0).cast("decimal(20,4)")
    net = net.withColumn("_held", held).withColumn("_closed", closed).withColumn("_rest", (F.col("volume") - F.col("_closed")).cast("decimal(20,4)"))

    def part(number: int, deal: bool, entry: bool, starts: Column, volume: Column, after: Column) -> Column:
        return F.struct(F.lit(number).alias("part"), F.lit(deal).alias("is_deal"), F.lit(entry).alias("is_entry"), starts.alias("starts"), volume.cast("decimal(20,4)").alias("v"), after.cast("decimal(20,4)").alias("position_volume"))

    no, opens = F.lit(False), F.col("_closed") == F.col("_held")
    leave = F.when(F.col("_closed") > 0, part(0, True, False, no, F.col("_closed"), F.col("_held") - F.col("_closed")))
    enter = F.when((F.col("kind") == "DEAL") & (F.col("_rest") > 0), part(1, True, True, opens, F.col("_rest"), F.when(opens, F.col("_rest")).otherwise(F.col("_held") + F.col("_rest"))))
    stops = F.when((F.col("kind") == "STOPS") & (F.col("_held") > 0), part(0, False, False, no, F.lit(0), F.col("_held")))
    cut = net.withColumn("_part", F.explode(F.array_compact(F.array(leave, enter, stops))))
    cut = cut.drop("volume").select("*", "_part.*").withColumn("_n", F.col("_n") * 2 + F.col("part"))
    cut = running_sum(materialize(cut), {"_trade": F.col("starts").cast("long")}, KEYS)
    trade_id = F.concat_ws(":", F.col("account_id").cast("string"), "symbol", F.col("_trade").cast("string"))
    # what a deal earned belongs to the trade that it closes, if there is one
    owner = F.col("is_deal") & (~F.col("is_entry") | (F.col("_closed") == 0))
    money = {c: F.when(owner, F.coalesce(c, F.lit(0))).otherwise(0).cast("decimal(20,4)") for c in ("profit", "commission", "swap")}
    cut = cut.withColumn("trade_id", trade_id).withColumns(money).withColumnRenamed("v", "volume")
    return cut.drop("_signed", "_net", "_before", "_held", "_closed", "_rest", "_part", "_trade", "error").withColumnRenamed("_n", "seq")


def trades(cut: DataFrame) -> DataFrame:
    """parts() -> a row per trade, open or closed, by one aggregation that starts before the shuffle."""

    def opening(c: str) -> Column:
        return F.max(F.when(F.col("starts"), F.col(c)))

    out_ = F.col("is_deal") & ~F.col("is_entry")
    closing = out_ & (F.col("position_volume") == 0)
    first_reason, last_reason = F.min(F.when(out_, F.col("reason"))), F.max(F.when(out_, F.col("reason")))
    folded = cut.groupBy("trade_id", *KEYS).agg(
        opening("side").alias("direction"),
        opening("sent_at").alias("entry_time"),
        opening("price").alias("entry_price"),
        opening("sl").alias("initial_sl"),
        opening("tp").alias("initial_tp"),
        opening("volume").alias("initial_volume"),
        F.max("position_volume").alias("max_volume"),
        F.max(F.when(closing, F.col("sent_at"))).alias("close_time"),
        weighted_price(F.when(out_, F.col("price") * F.col("volume")), F.when(out_, F.col("volume"))).alias("close_price"),
        F.sum("profit").alias("gross_profit"),
        F.sum("commission").alias("commission"),
        F.sum("swap").alias("swap"),
        (F.sum("profit") + F.sum("commission") + F.sum("swap")).alias("net_profit"),
        F.when(F.max(F.when(out_, True)).isNull(), None).when(first_reason.isNull(), "UNKNOWN").when(first_reason != last_reason, "MIXED").otherwise(first_reason).alias("exit_reason"),
    )
    status = F.when(F.col("close_time").isNotNull(), "CLOSED").otherwise("OPEN")
    return folded.withColumn("status", status).withColumn("duration_seconds", lifecycle.duration_seconds(F.col("entry_time"), F.col("close_time")))


def events(cut: DataFrame, folded: DataFrame, reentry_minutes: int) -> DataFrame:
    """parts() and their trades() -> trade_id, event_type, event_time, deal_ticket, volume, is_inferred, of all eight types.

    The deal that starts a trade opens it, further entries increase it; the exit to zero closes it; other exits are partial
    closes if the deal says that it leaves (entry OUT), else the position is decreased by a deal of the other side. A change of
    stops is told for each level that differs from the one before. A reentry is inferred from the trades' times.
    """
    kind = (
        F.when(F.col("starts"), "TRADE_OPENED")
        .when(F.col("is_entry"), "POSITION_INCREASED")
        .when(F.col("position_volume") == 0, "TRADE_CLOSED")
        .when(F.col("entry") == "OUT", "PARTIAL_CLOSE")
        .otherwise("POSITION_DECREASED")
    )
    no = F.lit(False)
    deals = cut.where("is_deal").select("trade_id", kind.alias("event_type"), F.col("sent_at").alias("event_time"), F.col("ticket").alias("deal_ticket"), "volume", no.alias("is_inferred"))
    w = Window.partitionBy("trade_id").orderBy("seq")  # a trade has few changes of stops
    levels = cut.where("starts OR NOT is_deal").select("trade_id", "sent_at", "is_deal", *[(~F.col(c).eqNullSafe(F.lag(c).over(w))).alias(f"_{c}") for c in ("sl", "tp")])
    changed = F.array_compact(F.array(F.when(F.col("_sl"), F.lit("SL_MODIFIED")), F.when(F.col("_tp"), F.lit("TP_MODIFIED"))))
    none, long = F.lit(None).cast("decimal(20,4)").alias("volume"), F.lit(None).cast("long").alias("deal_ticket")
    stops = levels.where("NOT is_deal").select("trade_id", F.explode(changed).alias("event_type"), F.col("sent_at").alias("event_time"), long, none, no.alias("is_inferred"))
    again = lifecycle.reentries(folded, reentry_minutes).where("is_inferred").select("trade_id", F.lit("REENTRY").alias("event_type"), F.col("entry_time").alias("event_time"), long, none, "is_inferred")
    return deals.unionByName(stops).unionByName(again)
