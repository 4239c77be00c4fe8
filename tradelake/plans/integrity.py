"""Queries of ingest, integrity and history, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelake.operators import history, ingest, rules
from tradelake.sources import driver
from tradelake.sources.driver import with_

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    """Register a query under its name, with its oracle, where epoch() stands for whole seconds since 1970."""
    sql = sql.replace("epoch(", "date_diff('second', TIMESTAMP '1970-01-01', ")

    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def sec(col: Column | str) -> Column:
    return F.unix_timestamp(col)


KEY = ["terminal_id", "idempotency_key"]


@query(
    with_("raw")
    + ", sent AS (SELECT *, sent_at + INTERVAL 1 SECOND AS arrival FROM raw UNION ALL SELECT *, sent_at + INTERVAL 5 MINUTE FROM raw)"
    + " SELECT terminal_id, idempotency_key, id, epoch(arrival)::BIGINT AS arrival FROM sent QUALIFY row_number() OVER (PARTITION BY terminal_id, idempotency_key ORDER BY arrival, id) = 1"
)
def ingest_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Every event is sent again, and keys recur: the first arrival of a key stays."""
    raw = driver.raw_events(spark, d)
    sent = raw.withColumn("arrival", F.timestamp_seconds(sec("sent_at") + 1)).unionByName(raw.withColumn("arrival", F.timestamp_seconds(sec("sent_at") + 300)))
    return ingest.idempotent_insert(sent, None, KEY, [F.col("arrival"), F.col("id")]).select(*KEY, "id", sec("arrival").alias("arrival"))


@query(
    with_("raw")
    + ", stored AS (SELECT DISTINCT terminal_id, idempotency_key FROM raw WHERE sent_at < TIMESTAMP '2024-01-10')"
    + " SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY terminal_id, idempotency_key ORDER BY sent_at, id) AS n FROM raw WHERE sent_at >= TIMESTAMP '2024-01-08') x"
    + " WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.terminal_id = x.terminal_id AND s.idempotency_key = x.idempotency_key)"
)
def ingest_returning(spark: SparkSession, d: str) -> DataFrame:
    """The ids that inserting the events from the 8th on into those before the 10th returns."""
    raw = driver.raw_events(spark, d)
    order = [F.col("sent_at"), F.col("id")]
    stored = ingest.idempotent_insert(raw.where("sent_at < TIMESTAMP '2024-01-10'"), None, KEY, order)
    return ingest.idempotent_insert(raw.where("sent_at >= TIMESTAMP '2024-01-08'"), stored, KEY, order).select("id")


@query(with_("raw") + " SELECT id, terminal_id, 1::SMALLINT AS schema_version, payload, 1727870400::BIGINT AS received, 'PENDING' AS status, 0::SMALLINT AS attempts, NULL::VARCHAR AS error FROM raw")
def ingest_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Events with the defaults of omitted columns, at a fixed time."""
    raw = driver.raw_events(spark, d).withColumn("schema_version", F.lit(1))
    whole = ingest.with_defaults(raw, "raw_events", F.lit("2024-10-02 12:00:00").cast("timestamp"))
    return whole.select("id", "terminal_id", "schema_version", "payload", sec("received_at").alias("received"), "status", "attempts", "error")


@query(with_("raw") + " SELECT id AS event_id, (1000 + row_number() OVER (ORDER BY sent_at, id))::BIGINT AS id FROM raw")
def ingest_ids(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive ids in the order of sending, after 1000."""
    raw = driver.raw_events(spark, d).withColumnRenamed("id", "event_id")
    return ingest.assign_ids(raw, 1000, "sent_at", ["event_id"]).select("event_id", "id")


QUEUE = ", q AS (SELECT id, terminal_id, event_type, sent_at, CASE WHEN event_type = 'click' THEN 'PROCESSED' ELSE 'PENDING' END AS status, (id % 3)::SMALLINT AS attempts FROM raw)"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    raw = driver.raw_events(spark, d)
    return raw.select("id", "terminal_id", "event_type", "sent_at", F.when(F.col("event_type") == "click", "PROCESSED").otherwise("PENDING").alias("status"), (F.col("id") % 3).cast("short").alias("attempts"))


@query(with_("raw") + QUEUE + " SELECT terminal_id, id, epoch(sent_at)::BIGINT AS sent, row_number() OVER (PARTITION BY terminal_id ORDER BY sent_at, id) AS position FROM q WHERE status = 'PENDING'")
def pending_queue(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pending(_queue(spark, d)).select("terminal_id", "id", sec("sent_at").alias("sent"), "position")


@query(
    with_("raw")
    + QUEUE
    + ", r AS (SELECT id, CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS ok, CASE WHEN id % 5 = 1 THEN 'bad payload' END AS error FROM q WHERE event_type <> 'view'),"
    + " j AS (SELECT q.id, q.status AS s, q.attempts AS a, r.ok, r.error AS e, q.status = 'PENDING' AND r.id IS NOT NULL AS turn FROM q LEFT JOIN r ON q.id = r.id),"
    + " k AS (SELECT *, (a + turn::INT)::SMALLINT AS attempts FROM j)"
    + " SELECT id, attempts, CASE WHEN NOT turn THEN s WHEN ok IS NULL THEN 'IGNORED' WHEN ok THEN 'PROCESSED' WHEN attempts >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status, CASE WHEN turn THEN e END AS error FROM k"
)
def queue_transitions(spark: SparkSession, d: str) -> DataFrame:
    """One processing turn over the queue: processed, failed at the third attempt, ignored, or pending again."""
    q = _queue(spark, d).withColumn("processed_at", F.lit(None).cast("timestamp")).withColumn("error", F.lit(None).cast("string"))
    ok = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, False).otherwise(True)
    results = q.where("event_type != 'view'").select("id", ok.alias("ok"), F.when(F.col("id") % 5 == 1, "bad payload").alias("error"))
    return ingest.advance(q, results, F.lit("2024-10-02 12:00:00").cast("timestamp")).select("id", "attempts", "status", "error")


@query(with_("raw") + " SELECT count(*) AS n FROM raw WHERE idempotency_key = 'deal:7'")
def filtered_count(spark: SparkSession, d: str) -> DataFrame:
    return driver.raw_events(spark, d).where("idempotency_key = 'deal:7'").agg(F.count("*").alias("n"))


@query("SELECT event_type AS status FROM events WHERE event_id = 77")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return driver.raw_events(spark, d).where("id = 77").select(F.col("event_type").alias("status"))


@query(with_("raw") + QUEUE + " SELECT id, CASE WHEN event_type = 'error' THEN 'PROCESSED' ELSE status END AS status, (CASE WHEN event_type = 'error' THEN 1 ELSE attempts END)::SMALLINT AS attempts FROM q")
def update_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A guarded update of status and attempts on all events of a type, as a change set applied to the table."""
    q = _queue(spark, d)
    changes = q.where("event_type = 'error'").withColumn("op", F.lit("UPDATE")).withColumn("status", F.lit("PROCESSED")).withColumn("attempts", F.lit(1).cast("short"))
    accepted = history.guard(changes, q, "raw_events").where("rule IS NULL")
    return history.apply_changes(q, accepted, ["id"]).select("id", "status", "attempts")


@query("SELECT 'ck_trades_direction' AS rule, count(*) AS n FROM orders")
def update_all_checked(spark: SparkSession, d: str) -> DataFrame:
    """Setting a direction outside its domain on all trades: every row breaks the rule."""
    changed = driver.trades(spark, d).select("trade_id", F.lit("LONG").alias("direction"))
    return rules.violations(changed, "trades").select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(with_("trades") + " SELECT trade_id, CASE WHEN symbol = '2-HIGH' THEN 'CLOSED' ELSE status END AS status, (CASE WHEN symbol = '2-HIGH' THEN 2 ELSE 1 END)::INT AS version FROM trades")
def update_versioned(spark: SparkSession, d: str) -> DataFrame:
    """An update appends a row version; the latest version of each trade is current."""
    t = driver.trades(spark, d).select("trade_id", "symbol", "status", F.lit(1).alias("version"))
    changed = t.where("symbol = '2-HIGH'").withColumn("status", F.lit("CLOSED")).withColumn("version", F.lit(2))
    return history.latest(t.unionByName(changed), ["trade_id"], [F.col("version")]).drop("symbol")


@query(
    "SELECT rule, count(*) AS n FROM (SELECT 'no_delete_trades' AS rule FROM orders WHERE o_orderpriority = '1-URGENT'"
    " UNION ALL SELECT 'append_only_trade_events_update' FROM lineitem WHERE l_returnflag = 'R'"
    " UNION ALL SELECT 'append_only_trade_events_delete' FROM lineitem WHERE l_returnflag = 'A') GROUP BY rule"
)
def change_guard(spark: SparkSession, d: str) -> DataFrame:
    """Change sets against guarded tables, by the rule that refuses them."""
    t = driver.trades(spark, d)
    refused = history.guard(t.where("symbol = '1-URGENT'").withColumn("op", F.lit("DELETE")), t, "trades").select("rule")
    op = F.when(F.col("l_returnflag") == "R", "UPDATE").when(F.col("l_returnflag") == "A", "DELETE")
    key = F.sha2(F.concat_ws(":", "l_orderkey", "seq"), 256)
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*driver.DEAL_ORDER))
    lines = driver.read(spark, d, "lineitem").withColumn("seq", seq)
    events = lines.select(key.alias("event_id"), F.col("l_quantity").alias("volume"), op.alias("op"))
    changes = events.where("op IS NOT NULL")
    refused = refused.unionByName(history.guard(changes, events.select("event_id", "volume"), "trade_events").select("rule"))
    return refused.where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"))


BROKEN = (
    ", b AS (SELECT trade_id, CASE WHEN trade_id % 17 = 0 THEN 'LONG' ELSE direction END AS direction, status, entry_time, CASE WHEN trade_id % 7 = 0 THEN NULL WHEN trade_id % 11 = 0 THEN entry_time - INTERVAL 1 HOUR ELSE close_time END AS close_time,"
    " (trade_id % 13 - 1)::DECIMAL(16,4) AS initial_volume, CASE WHEN trade_id % 19 = 0 THEN NULL ELSE symbol END AS symbol FROM trades)"
)


@query(
    with_("trades")
    + BROKEN
    + ", v AS (SELECT trade_id, [CASE WHEN NOT coalesce(status = 'OPEN' OR close_time IS NOT NULL, TRUE) THEN 'ck_trades_closed_has_close_time' END, CASE WHEN close_time < entry_time THEN 'ck_trades_time_order' END,"
    + " CASE WHEN initial_volume <= 0 THEN 'ck_trades_positive_volume' END, CASE WHEN symbol IS NULL THEN 'nn_trades_symbol' END, CASE WHEN direction NOT IN ('BUY','SELL') THEN 'ck_trades_direction' END] AS x FROM b)"
    + " SELECT trade_id, array_to_string([e FOR e IN x IF e IS NOT NULL], ',') AS violations FROM v WHERE len([e FOR e IN x IF e IS NOT NULL]) > 0"
)
def check_violations(spark: SparkSession, d: str) -> DataFrame:
    """Trades with planted faults, by the names of the rules they break."""
    t, k = driver.trades(spark, d), F.col("trade_id")
    close = F.when(k % 7 == 0, None).when(k % 11 == 0, F.timestamp_seconds(sec("entry_time") - 3600)).otherwise(F.col("close_time"))
    b = t.select(
        k,
        F.when(k % 19 == 0, None).otherwise(F.col("symbol")).alias("symbol"),
        F.when(k % 17 == 0, "LONG").otherwise(F.col("direction")).alias("direction"),
        "status",
        "entry_time",
        close.alias("close_time"),
        (k % 13 - 1).cast("decimal(16,4)").alias("initial_volume"),
    )
    return rules.violations(b, "trades").where(F.size("violations") > 0).select("trade_id", F.array_join("violations", ",").alias("violations"))


@query(
    "WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '1.2.' || p_size WHEN 1 THEN 'v' || p_size WHEN 2 THEN '1.0.0-rc.' || p_size WHEN 3 THEN '1.' || p_size WHEN 4 THEN '1.0.0' || chr(10) ELSE NULL END AS version FROM part)"
    r" SELECT p_partkey, 'ck_bot_versions_semver' AS rule FROM v WHERE NOT regexp_full_match(version, '[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?')"
)
def check_semver(spark: SparkSession, d: str) -> DataFrame:
    """Versions that are not semantic ones, among them one with a newline at its end."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    version = F.when(k % 6 == 0, F.concat(F.lit("1.2."), size)).when(k % 6 == 1, F.concat(F.lit("v"), size)).when(k % 6 == 2, F.concat(F.lit("1.0.0-rc."), size)).when(k % 6 == 3, F.concat(F.lit("1."), size)).when(k % 6 == 4, F.lit("1.0.0\n"))
    v = driver.read(spark, d, "part").select("p_partkey", version.alias("version"))
    return rules.violations(v, "bot_versions", only=["ck_bot_versions_semver"]).select("p_partkey", F.explode("violations").alias("rule"))


@query(
    with_("ticks")
    + ", b AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS bar_time, min_by(price, event_id) AS o, max(price) AS h, min(price) AS l, max_by(price, event_id) AS c FROM ticks GROUP BY ALL),"
    + " x AS (SELECT symbol, bar_time, o, c, CASE WHEN hour(bar_time) % 5 = 0 THEN l ELSE h END AS h, CASE WHEN hour(bar_time) % 5 = 0 THEN h ELSE l END AS l FROM b),"
    + " v AS (SELECT symbol, bar_time, unnest([CASE WHEN NOT h >= l THEN 'ck_price_bars_high_low' END, CASE WHEN NOT (h >= o AND h >= c) THEN 'ck_price_bars_high_bounds' END, CASE WHEN NOT (l <= o AND l <= c) THEN 'ck_price_bars_low_bounds' END]) AS rule FROM x)"
    + " SELECT symbol, rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY ALL"
)
def check_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars whose high and low are exchanged at some hours, counted by symbol and rule."""
    from tradelake.operators.bars import bars_from_ticks

    b = bars_from_ticks(driver.ticks(spark, d), 3600)
    swap = F.hour("bar_time") % 5 == 0
    b = b.select("symbol", "open", "close", F.when(swap, F.col("low")).otherwise(F.col("high")).alias("high"), F.when(swap, F.col("high")).otherwise(F.col("low")).alias("low"))
    return rules.violations(b, "price_bars").select("symbol", F.explode("violations").alias("rule")).groupBy("symbol", "rule").agg(F.count("*").alias("n"))


@query(
    "WITH c AS (SELECT c_custkey AS k, TIMESTAMP '2024-01-01' AS t FROM customer)"
    " SELECT k, 'ck_deployments_dates' AS rule FROM c WHERE k % 4 = 0 UNION ALL SELECT k, 'ck_data_splits_ordered' FROM c WHERE k % 5 IN (0, 1)"
    " UNION ALL SELECT k, 'ck_pattern_tests_n_non_negative' FROM c WHERE k % 6 - 1 < 0 UNION ALL SELECT k, 'ck_backtest_runs_period' FROM c WHERE k % 7 = 0"
)
def check_periods(spark: SparkSession, d: str) -> DataFrame:
    """Rules over dates and counts: ends not after starts, cut points out of order, negative counts."""
    c = driver.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("2024-01-01").cast("timestamp").alias("t"))
    later = lambda days: F.timestamp_seconds(sec("t") + days * 86400)
    k = F.col("k")
    cases = {
        "deployments": c.select("k", F.col("t").alias("started_at"), F.when(k % 4 == 1, None).otherwise(later(k % 4)).alias("ended_at")),
        "data_splits": c.select("k", F.col("t").alias("train_end"), later(k % 5).alias("validation_end"), later(F.when(k % 5 == 1, 1).otherwise(9)).alias("oos_end")),
        "pattern_tests": c.select("k", (k % 6 - 1).cast("int").alias("n")),
        "backtest_runs": c.select("k", F.to_date("t").alias("period_start"), F.to_date(later(k % 7)).alias("period_end")),
    }
    out = None
    for table, rows in cases.items():
        part = rules.violations(rows, table).select("k", F.explode("violations").alias("rule"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    with_("raw")
    + ", r AS (SELECT id, CASE WHEN id % 9 = 0 THEN repeat('x', 49) ELSE event_type END AS event_type, CASE WHEN id % 8 = 0 THEN NULL ELSE terminal_id END AS terminal_id, CASE WHEN id % 3 = 0 THEN 'DONE' ELSE 'PENDING' END AS status FROM raw)"
    + " SELECT rule, count(*) AS n FROM (SELECT unnest([CASE WHEN length(event_type) > 48 THEN 'len_raw_events_event_type' END, CASE WHEN terminal_id IS NULL THEN 'nn_raw_events_terminal_id' END, CASE WHEN status = 'DONE' THEN 'ck_raw_events_raweventstatus' END]) AS rule FROM r) WHERE rule IS NOT NULL GROUP BY rule"
)
def enum_null_length(spark: SparkSession, d: str) -> DataFrame:
    """Values outside a domain, nulls and lengths, counted by rule."""
    k = F.col("id")
    r = driver.raw_events(spark, d).select(k, F.when(k % 8 == 0, None).otherwise(F.col("terminal_id")).alias("terminal_id"), F.when(k % 9 == 0, F.lit("x" * 49)).otherwise(F.col("event_type")).alias("event_type"), F.when(k % 3 == 0, "DONE").otherwise("PENDING").alias("status"))
    return rules.violations(r, "raw_events").select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS trade_id, 'num_trades_entry_price' AS rule FROM orders WHERE abs((o_totalprice::DECIMAL(20,2)::DECIMAL(38,2) * (CASE WHEN o_orderkey % 3 = 0 THEN 10000000000000 ELSE 1 END)::DECIMAL(18,0))) >= 100000000000000")
def numeric_range(spark: SparkSession, d: str) -> DataFrame:
    """Prices that do not fit numeric(24,10)."""
    big = F.when(F.col("o_orderkey") % 3 == 0, F.lit(10_000_000_000_000)).otherwise(F.lit(1)).cast("decimal(18,0)")
    t = driver.read(spark, d, "orders").select(F.col("o_orderkey").alias("trade_id"), (F.col("o_totalprice").cast("decimal(20,2)") * big).alias("entry_price"))
    return rules.violations(t, "trades", only=["num_trades_entry_price"]).select("trade_id", F.explode("violations").alias("rule"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark: SparkSession, d: str) -> DataFrame:
    return rules.duplicate_keys(driver.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(with_("deployments") + " SELECT account_id, magic_number % 2 AS magic_number, count(*) AS n FROM deployments WHERE ended_at IS NULL GROUP BY ALL HAVING count(*) > 1")
def partial_unique_active(spark: SparkSession, d: str) -> DataFrame:
    """Open deployments of the same account and (coarsened) magic number."""
    deps = driver.deployments(spark, d).withColumn("magic_number", F.col("magic_number") % 2)
    return rules.duplicate_keys(deps, ["account_id", "magic_number"], "ended_at IS NULL")


@query(with_("deployments") + " SELECT account_id % 20 AS account_id, magic_number % 2 AS magic_number, count(*) AS n FROM deployments WHERE ended_at IS NULL GROUP BY ALL HAVING count(*) > 1")
def partial_unique_broken(spark: SparkSession, d: str) -> DataFrame:
    """The same with accounts that have many open deployments, which the key forbids."""
    deps = driver.deployments(spark, d).withColumns({"account_id": F.col("account_id") % 20, "magic_number": F.col("magic_number") % 2})
    return rules.duplicate_keys(deps, ["account_id", "magic_number"], "ended_at IS NULL")


@query("SELECT l_orderkey AS trade_id, l_partkey % 40 AS deal_ticket, count(*) AS n FROM lineitem WHERE l_partkey % 40 <> 0 GROUP BY ALL HAVING count(*) > 1")
def partial_unique_deals(spark: SparkSession, d: str) -> DataFrame:
    """Deal tickets twice in a trade; events without a ticket do not count."""
    ticket = F.nullif(F.col("l_partkey") % 40, F.lit(0))
    return rules.duplicate_keys(driver.deals(spark, d).select("trade_id", ticket.alias("deal_ticket")), ["trade_id", "deal_ticket"], "deal_ticket IS NOT NULL")


@query("SELECT event_id, user_id FROM events WHERE user_id IS NOT NULL AND event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id)")
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Events whose terminal is no supplier; null references are legal."""
    child = driver.read(spark, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id"))
    return rules.orphans(child, "user_id", driver.read(spark, d, "supplier"), "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def fk_blocked_deletes(spark: SparkSession, d: str) -> DataFrame:
    gone = driver.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return rules.blocked_deletes(gone, "c_custkey", driver.read(spark, d, "orders"), "o_custkey")


@query(
    with_("deployments")
    + ", i AS (SELECT id, account_id + 10 AS account_id, magic_number, symbol, started_at, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 6 = 0 THEN started_at ELSE ended_at END AS ended_at FROM deployments)"
    + " SELECT * FROM (SELECT 'ck_deployments_dates' AS \"constraint\", count(*) AS n FROM i WHERE ended_at <= started_at"
    + " UNION ALL SELECT 'uq_deployments_active_magic', count(*) FROM (SELECT account_id FROM (SELECT account_id, magic_number, symbol, 1 AS new FROM i WHERE ended_at IS NULL UNION ALL SELECT account_id, magic_number, symbol, 0 FROM deployments WHERE ended_at IS NULL) GROUP BY account_id, magic_number, symbol HAVING count(*) > 1 AND sum(new) > 0)"
    + " UNION ALL SELECT 'pk_deployments', count(*) FROM (SELECT id FROM i UNION ALL SELECT id FROM deployments) GROUP BY id HAVING FALSE"
    + " UNION ALL SELECT 'pk_deployments', count(*) FROM i"
    + " UNION ALL SELECT 'fk_deployments_account_id_accounts', count(*) FROM i WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = account_id)) WHERE n > 0"
)
def insert_report(spark: SparkSession, d: str) -> DataFrame:
    """All that speaks against inserting shifted copies of the deployments: dates, keys, active duplicates, unknown accounts."""
    deps = driver.deployments(spark, d)
    k = F.col("id")
    ended = F.when(k % 4 == 0, None).when(k % 6 == 0, F.col("started_at")).otherwise(F.col("ended_at"))
    incoming = deps.withColumn("account_id", F.col("account_id") + 10).withColumn("ended_at", ended)
    accounts = driver.read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return rules.insert_report(incoming, "deployments", {"deployments": deps, "accounts": accounts})


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('error', 'signup')")
def append_only_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an old snapshot that the new one has changed or lost."""
    old = driver.read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    new = old.where("event_type != 'error'").withColumn("value", F.when(F.col("event_type") == "signup", F.col("value") + 1).otherwise(F.col("value")))
    return history.audit_append_only(old, new)


@query("SELECT o_orderkey AS trade_id FROM orders WHERE o_orderpriority = '5-LOW'")
def no_delete_audit(spark: SparkSession, d: str) -> DataFrame:
    old = driver.trades(spark, d).select("trade_id", "symbol")
    return history.audit_no_delete(old, old.where("symbol != '5-LOW'"), ["trade_id"]).select("trade_id")


@query(with_("raw") + " SELECT id, CASE WHEN id % 20 = 0 AND id % 30 = 1 THEN 'event_type,payload' WHEN id % 20 = 0 THEN 'payload' ELSE 'event_type' END AS changed FROM raw WHERE id % 20 = 0 OR id % 30 = 1")
def raw_event_guard(spark: SparkSession, d: str) -> DataFrame:
    """Frozen columns that differ between snapshots; status may change, and JSON is compared by content."""
    old = driver.raw_events(spark, d).withColumn("status", F.lit("PENDING"))
    k = F.col("id")
    # {"k":1} and {"k": 1} are equal
    payload = F.when(k % 20 == 0, F.lit('{"k": -1}')).otherwise(F.regexp_replace("payload", ": ", ":"))
    new = old.withColumn("payload", payload).withColumn("event_type", F.when(k % 30 == 1, F.lit("other")).otherwise(F.col("event_type"))).withColumn("status", F.lit("PROCESSED"))
    found = history.audit_frozen(old, new, ["id"], ["terminal_id", "idempotency_key", "event_type", "payload", "sent_at"], json=["payload"])
    return found.select("id", F.array_join("changed", ",").alias("changed"))


@query("SELECT l_orderkey AS trade_id, l_linenumber AS analysis_version, count(*) AS n FROM lineitem l WHERE l_linenumber = (SELECT max(l_linenumber) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey) GROUP BY ALL")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of each trade's analysis, with how often it occurs."""
    counted = driver.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trade_id"), F.col("l_linenumber").alias("analysis_version")).agg(F.count("*").alias("n"))
    return history.latest(counted, ["trade_id"], [F.col("analysis_version")])
