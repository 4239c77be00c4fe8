"""Trades from their deals: volume, prices, profit, risk, exit, attribution, excursions and reentries.

deals: trade_id, seq or another column that orders a trade's deals totally, is_entry, direction, volume, amount (price times
volume), price, profit, commission, swap, reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelake.functions.common import ratio, weighted_price
from tradelake.functions.tables import materialize
from tradelake.operators.extrema import span_extrema
from tradelake.operators.series import last_known, numbered, over_pieces, running_sum


def fold(deals: DataFrame, order: str = "seq") -> DataFrame:
    """One row per trade: its span, volumes, prices and profit components, by one aggregation that starts before the shuffle."""
    entry, exit_ = F.col("is_entry"), ~F.col("is_entry")
    return deals.groupBy("trade_id").agg(
        F.count("*").alias("n_deals"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.sum(F.when(entry, F.col("volume"))).alias("entry_volume"),
        F.sum(F.when(exit_, F.col("volume"))).alias("exit_volume"),
        F.min_by("price", order).alias("first_price"),
        F.sum("profit").alias("gross_profit"),
        F.sum("commission").alias("commission"),
        F.sum("swap").alias("swap"),
        (F.sum("profit") + F.sum("commission") + F.sum("swap")).alias("net_profit"),
    )


def exit_price(deals: DataFrame) -> DataFrame:
    """Volume-weighted mean price of each trade's exit deals; trades without one have none."""
    return deals.where(~F.col("is_entry")).groupBy("trade_id").agg(weighted_price(F.col("amount"), F.col("volume")).alias("close_price"))


def running_volume(deals: DataFrame) -> DataFrame:
    """Each deal with the position's volume after it, and the largest volume up to it."""
    w = Window.partitionBy("trade_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    signed = F.when(F.col("is_entry"), F.col("volume")).otherwise(-F.col("volume"))
    out = deals.withColumn("position_volume", F.sum(signed).over(w))
    return out.withColumn("max_volume", F.max("position_volume").over(w))


def classify(deals: DataFrame) -> DataFrame:
    """Each deal with its event_type, from the position's volume before and after it.

    The first deal opens; an exit that leaves nothing closes; an exit that leaves less is a partial close; an entry on a
    flat position is a reentry, on an open one an increase. Exits beyond the position count as closing it.
    """
    before = F.lag("position_volume").over(Window.partitionBy("trade_id").orderBy("seq"))
    held = running_volume(deals).withColumn("before", before)
    kind = (
        F.when(F.col("before").isNull(), "TRADE_OPENED")
        .when(~F.col("is_entry") & (F.col("position_volume") <= 0), "TRADE_CLOSED")
        .when(~F.col("is_entry"), "PARTIAL_CLOSE")
        .when(F.col("before") <= 0, "REENTRY")
        .otherwise("POSITION_INCREASED")
    )
    return held.withColumn("event_type", kind).drop("before")


def stop_events(events: DataFrame) -> DataFrame:
    """events (trade_id, seq, sl, tp) -> a row with event_type SL_MODIFIED or TP_MODIFIED for each level that differs from the one
    before; a trade has few of them."""
    w = Window.partitionBy("trade_id").orderBy("seq")
    later = F.row_number().over(w) > 1
    sl = later & ~F.col("sl").eqNullSafe(F.lag("sl").over(w))
    tp = later & ~F.col("tp").eqNullSafe(F.lag("tp").over(w))
    changed = F.array_compact(F.array(F.when(sl, F.lit("SL_MODIFIED")), F.when(tp, F.lit("TP_MODIFIED"))))
    return events.withColumn("_changed", changed).withColumn("event_type", F.explode("_changed")).drop("_changed")


def sign(direction: Column) -> Column:
    return F.when(direction == "BUY", 1).when(direction == "SELL", -1)


def points(direction: Column, entry: Column, exit_: Column, point: Column) -> Column:
    """Price distance in the trade's favour, in points; null where the point size is null or zero."""
    return ratio(sign(direction) * (exit_ - entry), point)


def duration_seconds(entry_time: Column, close_time: Column) -> Column:
    return F.unix_timestamp(close_time) - F.unix_timestamp(entry_time)


def risk_amount(entry: Column, stop: Column, tick_size: Column, tick_value: Column, volume: Column) -> Column:
    """Loss at the initial stop; null for a trade opened without one."""
    return ratio(F.abs(entry - stop), tick_size) * tick_value.cast("double") * volume.cast("double")


def risk_percent(amount: Column, balance: Column) -> Column:
    return F.try_divide(F.lit(100.0) * amount, balance.cast("double"))


def exit_reason(deals: DataFrame) -> DataFrame:
    """The reason of each trade's exits: MIXED if they differ, UNKNOWN if none is stated."""
    reasons = deals.groupBy("trade_id").agg(F.min(F.when(~F.col("is_entry"), F.col("reason"))).alias("a"), F.max(F.when(~F.col("is_entry"), F.col("reason"))).alias("b"))
    return reasons.select("trade_id", F.when(F.col("a").isNull(), "UNKNOWN").when(F.col("a") != F.col("b"), "MIXED").otherwise(F.col("a")).alias("exit_reason"))


def outcome(net_profit: Column) -> Column:
    return F.when(net_profit > 0, "WIN").when(net_profit < 0, "LOSS").when(net_profit == 0, "BREAKEVEN")


def attribute(trades: DataFrame, deployments: DataFrame) -> DataFrame:
    """trades with deployment_id and n_deployments: the deployment of account, magic number and symbol that holds at entry.

    Validity is half-open, [started_at, ended_at); of several the latest start wins, then the smallest id. A trade without
    one is kept with null and 0.
    """
    keys = ["account_id", "magic_number", "symbol"]
    d = deployments.select(*keys, F.col("id").alias("_d"), "started_at", "ended_at")
    holds = (F.col("entry_time") >= F.col("started_at")) & (F.col("ended_at").isNull() | (F.col("entry_time") < F.col("ended_at")))
    matched = trades.select("trade_id", *keys, "entry_time").join(d, keys).where(holds)
    best = matched.groupBy("trade_id").agg(F.min_by("_d", F.struct(-F.unix_micros("started_at"), "_d")).alias("deployment_id"), F.count("*").alias("n_deployments"))
    return trades.join(best, "trade_id", "left").withColumn("n_deployments", F.coalesce("n_deployments", F.lit(0)))


def overlaps(deployments: DataFrame) -> DataFrame:
    """Pairs of deployments of the same account, magic number and symbol whose validity overlaps."""
    keys = ["account_id", "magic_number", "symbol"]
    a = deployments.select(*keys, F.col("id").alias("first_id"), F.col("started_at").alias("s1"), F.col("ended_at").alias("e1"))
    b = deployments.select(*keys, F.col("id").alias("second_id"), F.col("started_at").alias("s2"), F.col("ended_at").alias("e2"))
    meet = (F.col("first_id") < F.col("second_id")) & (F.col("e1").isNull() | (F.col("s2") < F.col("e1"))) & (F.col("e2").isNull() | (F.col("s1") < F.col("e2")))
    return a.join(b, keys).where(meet).select(*keys, "first_id", "second_id")


def exposures(deployments: DataFrame) -> DataFrame:
    """The times in which two or more deployments of an account, magic number and symbol hold at once, so that a trade's deployment is
    ambiguous: the keys, ambiguous_from, ambiguous_until (null if never) and most, the largest number at once.

    One sweep over starts and ends, summed by time first and then in pieces, so it grows with the deployments and not with their
    pairs. Deployments that hold for no time do not count; one without a start is left out.
    """
    keys = ["account_id", "magic_number", "symbol"]
    starts = deployments.select(*keys, F.col("started_at").alias("at"), F.lit(1).cast("long").alias("change"))
    ends = deployments.where("started_at IS NOT NULL").select(*keys, F.when(F.col("ended_at") > F.col("started_at"), F.col("ended_at")).when(F.col("ended_at").isNotNull(), F.col("started_at")).alias("at"), F.lit(-1).cast("long").alias("change"))
    changes = starts.unionByName(ends).where("at IS NOT NULL").groupBy(*keys, "at").agg(F.sum("change").alias("change")).where("change != 0")
    active = running_sum(numbered(materialize(changes), keys, "at"), {"active": F.col("change")}, keys)
    begins = (F.col("active") >= 2) & (F.col("active") - F.col("change") < 2)
    finishes = (F.col("active") < 2) & (F.col("active") - F.col("change") >= 2)
    runs = running_sum(materialize(active), {"_run": begins.cast("long")}, keys).where((F.col("active") >= 2) | finishes)
    out = runs.groupBy(*keys, "_run").agg(F.min("at").alias("ambiguous_from"), F.max(F.when(F.col("active") < 2, F.col("at"))).alias("ambiguous_until"), F.max("active").alias("most"))
    return out.drop("_run")


def excursions(trades: DataFrame, bars: DataFrame, source: str = "M1_BARS") -> DataFrame:
    """Largest favourable and adverse price distance of each trade, over bars (or ticks as bars of one price) with bar_time in
    [entry_time, close_time): mfe and mae in prices, in points, and as floating profit and drawdown in money, never below zero.

    trades have point, tick_size, tick_value and volume; where the point or tick size is null or zero, so is what needs it.
    source says what was measured, as EA_TICKS or M1_BARS. A trade looks up a few rows, however long it was held (extrema.py).
    """
    spans = trades.select(F.col("trade_id").alias("id"), "symbol", F.col("entry_time").alias("start"), F.col("close_time").alias("end"))
    found = span_extrema(spans, bars).withColumnRenamed("id", "trade_id")
    out = found.join(trades.select("trade_id", "direction", "entry_price", "point", "tick_size", "tick_value", "volume"), "trade_id")
    buy = F.col("direction") == "BUY"
    up, down = F.col("highest") - F.col("entry_price"), F.col("entry_price") - F.col("lowest")
    out = out.withColumns({"mfe": F.when(buy, up).otherwise(down), "mae": F.when(buy, down).otherwise(up)})

    def money(distance: str) -> Column:
        return ratio(F.greatest(F.col(distance), F.lit(0).cast("decimal(24,10)")), F.col("tick_size")) * F.col("tick_value").cast("double") * F.col("volume").cast("double")

    return out.select("trade_id", "mfe", "mae", "n_bars", ratio(F.col("mfe"), F.col("point")).alias("mfe_points"), ratio(F.col("mae"), F.col("point")).alias("mae_points"), money("mfe").alias("max_floating_profit"), money("mae").alias("max_floating_drawdown"), F.lit(source).alias("excursion_source"))


GROUP = ("account_id", "symbol", "direction")


def _linked(rows: DataFrame, minutes: int) -> DataFrame:
    before = over_pieces(rows, {"_close": lambda w: F.lag("close_time").over(w), "_trade": lambda w: F.lag("trade_id").over(w)}, back=1, keys=GROUP)
    wait = F.unix_timestamp("entry_time") - F.unix_timestamp("_close")
    linked = before.withColumn("reentry_of_trade_id", F.when((wait >= 0) & (wait <= minutes * 60), F.col("_trade")))
    return linked.withColumn("is_inferred", F.col("reentry_of_trade_id").isNotNull()).drop("_close", "_trade")


def reentries(trades: DataFrame, minutes: int) -> DataFrame:
    """trades with reentry_of_trade_id, the previous trade of account, symbol and direction, if entered within so many minutes after
    its close, and is_inferred, true where such a link was inferred. Trades with an open predecessor are no reentry. The previous
    trade is found within pieces of a group's history."""
    return _linked(numbered(trades, GROUP, "entry_time", ["trade_id"]), minutes).drop("_n")


def inferred_chains(trades: DataFrame, minutes: int) -> DataFrame:
    """reentries() with root_trade_id and depth: as an inferred link always leads to the previous trade of a group, the root is the last
    trade before without one, and no rounds are needed. Links that are given go to chains.chains()."""
    linked = materialize(_linked(numbered(trades, GROUP, "entry_time", ["trade_id"]), minutes))
    start = F.col("reentry_of_trade_id").isNull()
    found = last_known(linked, {"root_trade_id": F.when(start, F.col("trade_id")), "_first": F.when(start, F.col("_n"))}, keys=GROUP)
    return found.withColumn("depth", F.col("_n") - F.col("_first")).drop("_n", "_first")


def data_quality(trades: DataFrame) -> Column:
    """Flags of a trade as JSON, such as {"no_stop": true, ...}; flags that do not hold are left out."""
    flags = {
        "no_stop": F.col("initial_sl").isNull(),
        "unassigned": F.col("deployment_id").isNull(),
        "close_before_entry": F.col("close_time") < F.col("entry_time"),
    }
    entries = F.array(*[F.when(ok, F.struct(F.lit(n).alias("key"), F.lit(True).alias("value"))) for n, ok in flags.items()])
    return F.to_json(F.map_from_entries(F.array_compact(entries)))


def server_offset_minutes(server_time: Column, utc_time: Column, policy: Column | None = None) -> Column:
    """Offset of a server clock (without zone) from UTC. A broker's policy FIXED:<minutes> states it; under any other, such as
    EA_REPORTED, or without one, it is found from paired times, to the nearest quarter of an hour."""
    if policy is not None:
        fixed = F.regexp_extract(policy, r"^FIXED:(-?[0-9]+)$", 1)
        return F.when(fixed != "", F.try_to_number(fixed, F.lit("S99999")).cast("long")).otherwise(server_offset_minutes(server_time, utc_time))
    seconds = F.unix_timestamp(server_time.cast("timestamp")) - F.unix_timestamp(utc_time)
    return (F.floor((seconds + 450) / 900) * 15).cast("long")


#: Readings of a clock are told by the day; an offset that holds for one such piece only, between two equal ones, is noise.
CLOCK_SECONDS = 86_400


def clock_offsets(readings: DataFrame) -> DataFrame:
    """readings (server, server_time, utc_time) -> the times in which a server's clock was off by the same quarters of an hour, as it
    changes with summer time: server, offset_minutes, valid_from, valid_until (null for the last), n_readings.

    Of each day the offset is the median of its readings, the lower of two, and of a day the median of it and its neighbours, so readings
    and days that are off do not count. A change is dated at the first reading of the new offset on its first day or the day before, after
    which no reading of the same two days has the old one; if there is none such, at the first day's start. Readings with a null
    do not count.
    """
    offset = server_offset_minutes(F.col("server_time"), F.col("utc_time"))
    day = F.timestamp_seconds(F.floor(F.unix_timestamp("utc_time") / CLOCK_SECONDS) * CLOCK_SECONDS)
    told = materialize(readings.select("server", "utc_time", offset.alias("offset"), day.alias("day")).dropna())
    counts = told.groupBy("server", "day", "offset").agg(F.count("*").alias("n"), F.min("utc_time").alias("first_at"), F.max("utc_time").alias("last_at"))
    seen = F.array_sort(F.collect_list(F.struct("offset", "n", "first_at", "last_at")))
    days = counts.groupBy("server", "day").agg(seen.alias("seen"), F.sum("n").alias("n"))
    # the first offset up to which half of the readings lie; a day has few different ones
    half = F.aggregate("seen", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("at")), lambda s, x: F.struct((s["sum"] + x["n"]).alias("sum"), F.coalesce(s["at"], F.when((s["sum"] + x["n"]) * 2 >= F.col("n"), x["offset"])).alias("at")))["at"]
    rows = numbered(materialize(days.withColumn("offset", half)), ("server",), "day")
    near = over_pieces(rows, {"_b": lambda w: F.lag("offset").over(w), "_a": lambda w: F.lead("offset").over(w), "_seen": lambda w: F.lag("seen").over(w)}, back=1, ahead=1, keys=("server",))
    middle = F.when(F.col("_b") == F.col("_a"), F.col("_b")).otherwise(F.col("offset"))
    smooth = materialize(near.select("server", "day", "_n", "n", middle.alias("offset"), F.concat(F.coalesce("_seen", F.array().cast(near.schema["seen"].dataType)), "seen").alias("seen")))
    steps = over_pieces(smooth, {"_was": lambda w: F.lag("offset").over(w)}, back=1, keys=("server",))
    new = F.col("_was").isNull() | (F.col("_was") != F.col("offset"))
    runs = running_sum(materialize(steps.withColumn("_new", new.cast("long"))), {"_run": F.col("_new")}, ("server",))
    old_until = F.array_max(F.transform(F.filter("seen", lambda x: x["offset"] == F.col("_was")), lambda x: x["last_at"]))
    starts = F.array_min(F.transform(F.filter("seen", lambda x: x["offset"] == F.col("offset")), lambda x: F.when(old_until.isNull() | (x["first_at"] > old_until), x["first_at"])))
    dated = runs.withColumn("_from", F.when(F.col("_new") == 1, F.coalesce(F.when(F.col("_was").isNotNull(), starts), F.when(F.col("_was").isNull(), F.array_min(F.transform("seen", lambda x: x["first_at"]))), F.col("day"))))
    out = dated.groupBy("server", "_run").agg(F.min("offset").alias("offset_minutes"), F.min("_from").alias("valid_from"), F.sum("n").alias("n_readings"))
    w = Window.partitionBy("server").orderBy("_run")  # a server changes its clock some times a year
    return out.withColumn("valid_until", F.lead("valid_from").over(w)).select("server", "offset_minutes", "valid_from", "valid_until", "n_readings")
