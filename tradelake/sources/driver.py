"""The driver's tables as the trading domain. Each function reads one table and projects what its query needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with its times as instants in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal events; an idempotency key comes again every 50 events."""
    key = F.concat(F.lit("deal:"), (F.col("event_id") % 50).cast("string"))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("terminal_id"), key.alias("idempotency_key"), "event_type", F.col("ts").alias("sent_at"), F.col("props").alias("payload"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as terminal messages with a JSON payload: deals, and every fifth one a change of stops. Every tenth message is sent
    again later, and one in 97 has a payload that is cut off."""
    return messages_of(read(spark, sf_dir, "events"))


def messages_of(e: DataFrame) -> DataFrame:
    key = F.col("event_id")
    volume = (1 + key % 2).cast("decimal(16,4)")
    fields = {
        "kind": F.when(key % 5 == 4, "STOPS").otherwise("DEAL"),
        "symbol": F.col("event_type"),
        "side": F.when((key + F.col("user_id")) % 2 == 0, "BUY").otherwise("SELL"),
        "entry": F.when(key % 3 != 0, "OUT").otherwise("IN"),
        "ticket": key + 10**6,
        "volume": volume,
        "price": F.col("value").cast("decimal(24,10)"),
        "profit": key % 21 - 10,
        "commission": (volume * F.lit("-0.07").cast("decimal(4,2)")).cast("decimal(20,4)"),
        "swap": F.lit(0),
        "sl": F.nullif(key % 4, F.lit(0)),
        "tp": F.nullif(key % 3, F.lit(0)),
        "reason": F.when(key % 4 == 1, "SL").when(key % 4 == 2, "TP").when(key % 4 == 3, "MANUAL"),
    }
    text = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    text = F.when(key % 97 == 0, F.substring(text, 1, 12)).otherwise(text)
    sent = e.select(key.alias("id"), (F.col("user_id") % 40).alias("account_id"), F.concat(F.lit("deal:"), key.cast("string")).alias("idempotency_key"), F.col("ts").alias("sent_at"), text.alias("payload"))
    again = sent.where("id % 10 = 0").withColumn("id", F.col("id") + 10**9).withColumn("sent_at", F.expr("sent_at + INTERVAL 5 SECONDS"))
    return sent.unionByName(again)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("symbol"), F.col("value").cast("decimal(24,10)").alias("price"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trades: F is closed, some hours after entry; the others are open."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    close = F.when(F.col("o_orderstatus") == "F", F.timestamp_seconds(F.unix_timestamp("o_orderdate") + (key % 72) * 3600))
    return o.select(
        key.alias("trade_id"),
        F.col("o_custkey").alias("account_id"),
        (key % 5).alias("magic_number"),
        F.col("o_orderpriority").alias("symbol"),
        F.when(key % 2 == 0, "BUY").otherwise("SELL").alias("direction"),
        F.when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("status"),
        F.col("o_orderdate").alias("entry_time"),
        close.alias("close_time"),
        F.col("o_totalprice").cast("decimal(24,10)").alias("entry_price"),
    )


DEAL_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as deals: O enters, F leaves. Profit is (discount - 0.05) of the amount, commission the tax on the volume. The struct
    `order` orders the deals of a trade totally, up to equal lines."""
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    vol = F.col("l_quantity").cast("decimal(16,4)")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trade_id"),
        F.struct(*DEAL_ORDER).alias("order"),
        F.col("l_shipdate").alias("at"),
        (F.col("l_linestatus") == "O").alias("is_entry"),
        vol.alias("volume"),
        amount.alias("amount"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        ((F.col("l_discount").cast("decimal(4,2)") - F.lit("0.05").cast("decimal(4,2)")) * amount).cast("decimal(20,4)").alias("profit"),
        (-(F.col("l_tax").cast("decimal(4,2)") * vol.cast("decimal(16,2)"))).cast("decimal(20,4)").alias("commission"),
        F.lit(0).cast("decimal(20,4)").alias("swap"),
        F.when(F.col("l_returnflag") == "R", "SL").when(F.col("l_returnflag") == "A", "TP").alias("reason"),
        "l_suppkey",
        "l_partkey",
    )


def numbered_deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deals() with seq, their places within a trade, which has few of them; this takes a shuffle and a sort."""
    return deals(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("trade_id").orderBy("order")).cast("long"))


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as deployments of one magic number and symbol: from a day of 1995 on; every third never ends, others end after
    three years, and some of those get a second, open one after the first year."""
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    start = F.timestamp_seconds(F.unix_timestamp(F.lit("1995-01-01").cast("timestamp")) + (key % 365) * 86400)
    symbols = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    base = c.select(key.alias("account_id"), (key % 5).alias("magic_number"), F.element_at(symbols, (key % 5).cast("int") + 1).alias("symbol"), start.alias("s"))
    year = 365 * 86400
    first = base.select((F.col("account_id") * 2).alias("id"), "account_id", "magic_number", "symbol", F.col("s").alias("started_at"), F.when(F.col("account_id") % 3 != 0, F.timestamp_seconds(F.unix_timestamp("s") + 3 * year)).alias("ended_at"))
    second = base.where("account_id % 5 = 0 AND account_id % 3 != 0").select((F.col("account_id") * 2 + 1).alias("id"), "account_id", "magic_number", "symbol", F.timestamp_seconds(F.unix_timestamp("s") + year).alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"))
    return first.unionByName(second)


#: The same projections for the oracle, as common table expressions.
SQL = {
    "raw": "raw AS (SELECT event_id AS id, user_id::VARCHAR AS terminal_id, 'deal:' || (event_id % 50)::VARCHAR AS idempotency_key, event_type, ts AS sent_at, props AS payload FROM events)",
    "msgs": "msgs AS (SELECT event_id AS id, user_id % 40 AS account_id, event_type AS symbol, ts AS sent_at, event_id % 5 <> 4 AS is_deal, CASE WHEN (event_id + user_id) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN event_id % 3 <> 0 THEN 'OUT' ELSE 'IN' END AS entry, event_id + 1000000 AS ticket, (1 + event_id % 2)::DECIMAL(16,4) AS volume, value::DECIMAL(24,10) AS price, event_id % 21 - 10 AS profit, (1 + event_id % 2) * -0.07 AS commission, nullif(event_id % 4, 0) AS sl, nullif(event_id % 3, 0) AS tp, ['SL','TP','MANUAL'][(event_id % 4)::INT] AS reason FROM events WHERE event_id % 97 <> 0)",
    "ticks": "ticks AS (SELECT event_id, ts, event_type AS symbol, value::DECIMAL(24,10) AS price FROM events)",
    "trades": "trades AS (SELECT o_orderkey AS trade_id, o_custkey AS account_id, o_orderkey % 5 AS magic_number, o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS direction, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS status, o_orderdate AS entry_time, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours((o_orderkey % 72)::INT) END AS close_time, o_totalprice::DECIMAL(24,10) AS entry_price FROM orders)",
    "deals": "deals AS (SELECT l_orderkey AS trade_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(DEAL_ORDER) + ") AS seq, l_shipdate AS at, l_linestatus = 'O' AS is_entry, l_quantity::DECIMAL(16,4) AS volume, l_extendedprice::DECIMAL(18,2) AS amount, l_extendedprice / l_quantity AS price, ((l_discount::DECIMAL(4,2) - 0.05) * l_extendedprice::DECIMAL(18,2))::DECIMAL(20,4) AS profit, (-(l_tax::DECIMAL(4,2) * l_quantity::DECIMAL(16,2)))::DECIMAL(20,4) AS commission, 0::DECIMAL(20,4) AS swap, CASE l_returnflag WHEN 'R' THEN 'SL' WHEN 'A' THEN 'TP' END AS reason, l_suppkey, l_partkey FROM lineitem)",
    "deployments": "d0 AS (SELECT c_custkey AS account_id, c_custkey % 5 AS magic_number, ['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'][(c_custkey % 5 + 1)::INT] AS symbol, TIMESTAMP '1995-01-01' + to_days((c_custkey % 365)::INT) AS s FROM customer), deployments AS (SELECT account_id * 2 AS id, account_id, magic_number, symbol, s AS started_at, CASE WHEN account_id % 3 <> 0 THEN s + to_days(1095) END AS ended_at FROM d0 UNION ALL SELECT account_id * 2 + 1, account_id, magic_number, symbol, s + to_days(365), NULL FROM d0 WHERE account_id % 5 = 0 AND account_id % 3 <> 0)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
