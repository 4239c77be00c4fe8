"""Schemas, rules, immutability, snapshots and streams on small fixtures."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.functions.common import canonical_json, normal_cdf, weighted_price
from tradelake.operators import asof, bars, history, ingest, lifecycle, research, rules
from tradelake.plans.schemas import DOMAINS, TABLES, schema_diff
from tradelake.sources import snapshot

NOW = dt.datetime(2026, 10, 2, 12)
HOUR = dt.timedelta(hours=1)


def rows(spark, table, *values, **common):
    """Rows of a table from partial values, in the table's types."""
    spec = TABLES[table]
    names = [c.name for c in spec.columns if any(c.name in v for v in (*values, common))]
    schema = T.StructType([T.StructField(c.name, c.spark_type()) for c in spec.columns if c.name in names])
    return spark.createDataFrame([tuple((common | v).get(n) for n in names) for v in values], schema)


TRADE = {"trade_id": "t1", "account_id": "a1", "position_id": 5001, "magic_number": 20260903, "symbol": "USTEC_x100", "direction": "BUY", "order_type": "MARKET", "source": "DEMO", "status": "OPEN", "entry_time": NOW, "entry_price": Decimal("20000.5"), "initial_volume": Decimal("0.10"), "max_volume": Decimal("0.10")}
DEPLOYMENT = {"id": "d1", "bot_version_id": "v1", "account_id": "a1", "symbol": "USTEC_x100", "magic_number": 20260903, "started_at": NOW}


def broken(df, table):
    return sorted({v for r in rules.violations(df, table).collect() for v in r.violations})


def reported(incoming, table, **stored):
    return sorted(r.constraint for r in rules.insert_report(incoming, table, stored).collect())


def refused(spark, table, op, current, **change):
    changed = current.withColumns({k: F.lit(v).cast(current.schema[k].dataType) for k, v in change.items()}).withColumn("op", F.lit(op))
    return [r.rule for r in history.guard(changed, current, table).collect()]


def test_registry_sizes():
    assert len(TABLES) == 25 and len(DOMAINS) == 17
    assert sum(len(t.columns) for t in TABLES.values()) == 291
    assert sum(len(t.foreign_keys) for t in TABLES.values()) == 29
    assert sum(t.unique is not None for t in TABLES.values()) == 12
    assert sum(len(t.checks) for t in TABLES.values()) == 11
    assert sum(c.kind == "json" for t in TABLES.values() for c in t.columns) == 13


def test_create_drift_drop(spark, tmp_path):
    spark.sql(f"CREATE DATABASE roundtrip LOCATION '{tmp_path}/db'")
    assert snapshot.create_tables(spark, "roundtrip") == 25
    assert snapshot.drift(spark, "roundtrip") == {}
    spark.sql("DROP TABLE roundtrip.users")
    spark.sql("CREATE TABLE roundtrip.users (id STRING, username INT) USING parquet")
    assert set(snapshot.drift(spark, "roundtrip")) == {"users"}
    assert snapshot.drop_tables(spark, "roundtrip") == 0
    assert snapshot.create_tables(spark, "roundtrip") == 25
    snapshot.drop_tables(spark, "roundtrip")
    spark.sql("DROP DATABASE roundtrip CASCADE")


def test_schema_diff():
    a = TABLES["users"].schema
    assert schema_diff(a, a) == []
    assert schema_diff(a, T.StructType(a.fields[1:])) == ["missing id"]


def test_duplicate_event_is_dropped(spark):
    event = {"terminal_id": "x", "idempotency_key": "deal:1:900", "event_type": "DEAL", "schema_version": 1, "payload": '{"deal": 123}', "sent_at": NOW}
    new = rows(spark, "raw_events", event, event).withColumn("n", F.monotonically_increasing_id())
    first = ingest.idempotent_insert(new, None, ["terminal_id", "idempotency_key"], [F.col("n")])
    assert first.count() == 1
    assert ingest.idempotent_insert(new, first, ["terminal_id", "idempotency_key"], [F.col("n")]).count() == 0
    nulls = new.withColumn("idempotency_key", F.lit(None).cast("string"))
    assert ingest.idempotent_insert(nulls, None, ["terminal_id", "idempotency_key"], [F.col("n")]).count() == 2


def test_duplicate_position(spark):
    stored = rows(spark, "trades", TRADE)
    assert reported(rows(spark, "trades", TRADE | {"trade_id": "t2"}), "trades", trades=stored) == ["uq_trades_account_id_position_id"]


def test_duplicate_deal_and_events_without_deal(spark):
    event = {"event_id": "e1", "trade_id": "t1", "event_type": "TRADE_OPENED", "event_time_utc": NOW, "deal_ticket": 777, "is_inferred": False, "extra": "{}", "created_at": NOW}
    stored = rows(spark, "trade_events", event)
    assert reported(rows(spark, "trade_events", event | {"event_id": "e2"}), "trade_events", trade_events=stored) == ["uq_trade_events_trade_id_deal_ticket"]
    free = [event | {"event_id": f"e{i}", "event_type": "SL_MODIFIED", "deal_ticket": None, "sl": Decimal(19950)} for i in (3, 4)]
    assert reported(rows(spark, "trade_events", *free), "trade_events", trade_events=stored) == []


def test_active_deployments(spark):
    stored = rows(spark, "deployments", DEPLOYMENT, ended_at=None)
    assert reported(rows(spark, "deployments", DEPLOYMENT | {"id": "d2"}, ended_at=None), "deployments", deployments=stored) == ["uq_deployments_active_magic"]
    ended = rows(spark, "deployments", DEPLOYMENT, ended_at=NOW + dt.timedelta(days=1))
    second = rows(spark, "deployments", DEPLOYMENT | {"id": "d2"}, ended_at=None)
    assert reported(second, "deployments", deployments=ended) == []
    # accepted although they overlap, which the detector tells
    assert lifecycle.overlaps(ended.unionByName(second)).count() == 1


@pytest.mark.parametrize(("version", "ok"), [("1.0.0", True), ("1.0.0-rc.1", True), ("v1", False), ("1.0.0\n", False), ("1.0", False), (None, True)])
def test_semver(spark, version, ok):
    df = rules.violations(rows(spark, "bot_versions", {"version": version}), "bot_versions", only=["ck_bot_versions_semver"])
    assert (df.first().violations == []) == ok


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"status": "CLOSED"}, ["ck_trades_closed_has_close_time"]),
        ({"close_time": NOW + HOUR}, []),
        ({"status": "CLOSED", "close_time": NOW}, []),
        ({"status": "CLOSED", "close_time": NOW - HOUR}, ["ck_trades_time_order"]),
        ({"direction": "LONG"}, ["ck_trades_direction"]),
        ({"initial_volume": Decimal(0)}, ["ck_trades_positive_volume"]),
        ({"exit_reason": None}, []),
        ({"symbol": None}, ["nn_trades_symbol"]),
        ({"symbol": "x" * 65}, ["len_trades_symbol"]),
        ({"deployment_id": None}, []),
    ],
)
def test_trade_rules(spark, change, rule):
    assert broken(rows(spark, "trades", {"close_time": None} | TRADE | change), "trades") == rule


def test_other_rules(spark):
    bar = {"symbol": "X", "open": Decimal(10), "high": Decimal(9), "low": Decimal(11), "close": Decimal(10), "tick_volume": 1}
    assert broken(rows(spark, "price_bars", bar), "price_bars") == ["ck_price_bars_high_bounds", "ck_price_bars_high_low", "ck_price_bars_low_bounds"]
    split = {"train_end": NOW, "validation_end": NOW - dt.timedelta(days=1), "oos_end": NOW + HOUR}
    assert broken(rows(spark, "data_splits", split), "data_splits") == ["ck_data_splits_ordered"]
    assert broken(rows(spark, "deployments", DEPLOYMENT | {"ended_at": NOW}), "deployments") == ["ck_deployments_dates"]
    day = dt.date(2026, 1, 1)
    assert broken(rows(spark, "backtest_runs", {"period_start": day, "period_end": day}), "backtest_runs") == ["ck_backtest_runs_period"]
    assert broken(rows(spark, "pattern_tests", {"n": -1}), "pattern_tests") == ["ck_pattern_tests_n_non_negative"]


def test_foreign_keys(spark):
    accounts = spark.createDataFrame([("a1",)], "id string")
    assert reported(rows(spark, "trades", TRADE, TRADE | {"trade_id": "t2", "position_id": 2, "account_id": "a9"}), "trades", accounts=accounts) == ["fk_trades_account_id_accounts"]
    child = rows(spark, "trades", TRADE)
    assert rules.blocked_deletes(accounts, "id", child, "account_id").count() == 1


def test_immutability(spark):
    version = rows(spark, "bot_versions", {"id": "v", "bot_id": "b", "version": "1.0.0", "changelog": None})
    assert refused(spark, "bot_versions", "UPDATE", version, changelog="x") == ["append_only_bot_versions_update"]
    assert refused(spark, "bot_versions", "UPDATE", version) == ["append_only_bot_versions_update"]
    assert refused(spark, "bot_versions", "DELETE", version) == ["append_only_bot_versions_delete"]
    trade = rows(spark, "trades", TRADE, close_time=None, net_profit=None)
    assert refused(spark, "trades", "DELETE", trade) == ["no_delete_trades"]
    assert refused(spark, "trades", "UPDATE", trade, status="CLOSED", net_profit=42.10) == [None]
    event = rows(spark, "raw_events", {"id": 1, "idempotency_key": "deal:1:901", "payload": '{"a": 1, "b": 2}', "status": "PENDING", "attempts": 0})
    assert refused(spark, "raw_events", "UPDATE", event, payload="{}") == ["frozen_columns_raw_events"]
    assert refused(spark, "raw_events", "UPDATE", event, payload='{"b":2,"a":1}') == [None]
    assert refused(spark, "raw_events", "UPDATE", event, status="PROCESSED", attempts=1) == [None]
    assert refused(spark, "raw_events", "DELETE", event) == ["no_delete_raw_events"]
    assert refused(spark, "users", "DELETE", rows(spark, "users", {"id": "u", "username": "n"})) == [None]
    nothing = event.where("id = 99").withColumn("op", F.lit("DELETE"))
    assert history.guard(nothing, event, "raw_events").count() == 0


def test_update_applies(spark):
    event = rows(spark, "raw_events", {"id": 1, "status": "PENDING"}, {"id": 2, "status": "PENDING"})
    change = event.where("id = 1").withColumn("status", F.lit("PROCESSED")).withColumn("op", F.lit("UPDATE"))
    after = history.apply_changes(event, history.guard(change, event, "raw_events"), ["id"])
    assert sorted((r.id, r.status) for r in after.collect()) == [(1, "PROCESSED"), (2, "PENDING")]


def test_asof_ties(spark):
    left = spark.createDataFrame([("k", 5)], "k string, t int")
    right = spark.createDataFrame([("k", 5, None), ("k", 4, 1)], "k string, rt int, v int")
    assert asof.asof(left, right, ["k"], "t", "rt").first().r_v == 1
    inclusive = asof.asof(left, right, ["k"], "t", "rt", strict=False).first()
    assert inclusive.r_rt == 5 and inclusive.r_v is None
    assert asof.asof(left, right, ["k"], "t", "rt", strict=True, forward=True).first().r_rt is None
    assert asof.asof(left, right, ["k"], "t", "rt", strict=False, forward=True).first().r_rt == 5


def test_asof_over_pieces(spark):
    """A piece without right rows, or without an earlier one, takes what the pieces before hand on."""
    left = spark.createDataFrame([("k", t) for t in (3, 15, 47, 90)] + [("z", 1)], "k string, t int")
    right = spark.createDataFrame([("k", 2), ("k", 16), ("k", 17), ("k", 88)], "k string, rt int")
    got = {(r.k, r.t): r.r_rt for r in asof.asof(left, right, ["k"], "t", "rt", piece_seconds=10).collect()}
    assert got == {("k", 3): 2, ("k", 15): 2, ("k", 47): 17, ("k", 90): 88, ("z", 1): None}
    ahead = {(r.k, r.t): r.r_rt for r in asof.asof(left, right, ["k"], "t", "rt", forward=True, piece_seconds=10).collect()}
    assert ahead == {("k", 3): 16, ("k", 15): 16, ("k", 47): 88, ("k", 90): None, ("z", 1): None}


def test_resampling_composes_and_does_not_look_ahead(spark):
    ticks = spark.createDataFrame([("x", NOW + dt.timedelta(minutes=7 * i), Decimal(100 + (i * 37) % 23), i) for i in range(400)], "symbol string, ts timestamp, price decimal(24,10), event_id long")
    fine = bars.bars_from_ticks(ticks, 60)
    assert bars.resample(bars.resample(fine, 3600), 4 * 3600).exceptAll(bars.resample(fine, 4 * 3600)).count() == 0
    from tradelake.operators import features

    hourly = bars.bars_from_ticks(ticks, 3600)
    cut = hourly.where(F.col("bar_time") < F.lit(NOW + 20 * HOUR))
    for f in (lambda b: features.ema(b, 20), features.swings, features.atr):
        assert f(cut).exceptAll(f(hourly)).count() == 0


def test_recursive_smoothing_over_pieces(spark):
    from tradelake.operators import features

    n = 24 * 30
    df = spark.createDataFrame([("x", NOW + i * HOUR, float((i * 7919) % 101)) for i in range(n)], "symbol string, bar_time timestamp, close double")
    got = [r.ema for r in features.ema(df, 20).orderBy("bar_time").collect()]
    want, y = [], None
    for i in range(n):
        x = float((i * 7919) % 101)
        y = x if y is None else y + (x - y) * 2 / 21
        want.append(y)
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


def test_insert_is_idempotent_under_permutation(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "k int, n int")
    a = ingest.idempotent_insert(df, None, ["k"], [F.col("n")])
    b = ingest.idempotent_insert(df.orderBy(F.desc("n")), None, ["k"], [F.col("n")])
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 7


def test_vwap_keeps_ten_decimals(spark):
    df = spark.createDataFrame([(Decimal("20000.1234567892"), Decimal("1.0000"))], "p decimal(24,10), v decimal(16,4)")
    assert df.agg(weighted_price(F.col("p") * F.col("v"), F.col("v")).alias("w")).first().w == Decimal("20000.1234567892")


def test_json_and_cdf(spark):
    one = spark.range(1)
    assert one.select(canonical_json(F.lit('{"b": 1, "a": 2}'))).first()[0] == '{"a":2,"b":1}'
    assert one.select(canonical_json(F.lit("no json"))).first()[0] is None
    assert abs(one.select(normal_cdf(F.lit(1.96))).first()[0] - 0.9750021) < 1e-6
    assert one.select(research.p_value(F.lit(0.0))).first()[0] == pytest.approx(1, abs=1e-6)


def test_conditions_are_whitelisted():
    with pytest.raises(ValueError):
        research.condition({"field": "password", "op": "=", "value": 1}, ["x"])
    with pytest.raises(ValueError):
        research.condition({"field": "x", "op": "; DROP", "value": 1}, ["x"])


def test_snapshot_roundtrip(spark, tmp_path):
    counts = snapshot.backup(spark, {"a": spark.range(5), "b": spark.range(0)}, f"{tmp_path}/snap")
    assert counts == {"a": 5, "b": 0}
    assert snapshot.restore(spark, f"{tmp_path}/snap", "restored_") == ["a", "b"]
    assert spark.table("restored_a").count() == 5
    assert snapshot.expired(spark, str(tmp_path)) == []
    assert snapshot.expired(spark, str(tmp_path), now_ms=10**14) == ["snap"]
    snapshot.backup(spark, {"a": spark.range(1)}, f"{tmp_path}/other")
    assert snapshot.expire(spark, str(tmp_path)) == [] and snapshot.expire(spark, str(tmp_path), now_ms=10**14) == ["other", "snap"]
    assert snapshot.expired(spark, str(tmp_path), now_ms=10**14) == []


def test_snapshot_tells_changed_rows(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "n int, t string"), spark.createDataFrame([(2, None), (1, "x")], "n int, t string")
    assert snapshot._digest(a) == snapshot._digest(b) != snapshot._digest(a.withColumn("t", F.lit("x")))


def test_scopes_within_scopes(spark, tmp_path):
    from tradelake.sources.store import Store

    store, now = Store(spark, f"{tmp_path}/store"), F.lit(NOW).cast("timestamp")

    def broker(i):
        return spark.createDataFrame([(f"b{i}", f"Broker {i}")], "id string, name string")

    with store.scope():
        store.insert("brokers", broker(1), now)
        with store.scope():
            store.insert("brokers", broker(2), now)
        with pytest.raises(ValueError), store.scope():
            store.insert("brokers", broker(3), now)
            assert store.read("brokers").count() == 3
            raise ValueError
        store.insert("brokers", broker(4), now)
        store.change("brokers", store.read("brokers").where("id = 'b2'").withColumn("name", F.lit("second")).withColumn("op", F.lit("UPDATE")), now)
        assert Store(spark, f"{tmp_path}/store").read("brokers").count() == 0  # nothing is written yet
    assert {(r.id, r.name) for r in store.read("brokers").collect()} == {("b1", "Broker 1"), ("b2", "second"), ("b4", "Broker 4")}
    files = {p for p in (tmp_path / "store" / "brokers").iterdir() if p.suffix == ".parquet"}
    store.insert("brokers", broker(5), now)
    left = {p for p in (tmp_path / "store" / "brokers").iterdir() if p.suffix == ".parquet"}
    assert files < left and store.read("brokers").count() == 4  # an append leaves the files that were there


def test_series_in_pieces(spark):
    """Frames, carried values and sums over small pieces equal those over whole series."""
    from pyspark.sql import Window

    from tradelake.operators import series

    rows = [(s, NOW + (i * 7 + (i // 40) * 2000) * HOUR, (i * 31) % 17 if i % 3 else None) for s, n in (("a", 130), ("b", 1), ("c", 33)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, bar_time timestamp, v int")
    n = series.numbered(df)
    w = Window.partitionBy("symbol").orderBy("bar_time")
    whole = df.select("symbol", "bar_time", (F.row_number().over(w) - 1).cast("long").alias("_n"), F.sum("v").over(w.rowsBetween(-5, 3)).alias("s"), F.lag("v", 4).over(w).alias("l"), F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("k"), F.sum("v").over(w).alias("t"))
    got = series.over_pieces(n, {"s": lambda w: F.sum("v").over(w.rowsBetween(-5, 3)), "l": lambda w: F.lag("v", 4).over(w)}, back=5, ahead=3, piece_rows=8)
    got = series.last_known(got, {"k": F.col("v")}, inclusive=False, piece_rows=8)
    got = series.running_sum(got, {"t": F.coalesce("v", F.lit(0))}, piece_rows=8)
    assert sorted(map(tuple, got.select(whole.columns).collect()), key=repr) == sorted(((*r[:-1], r[-1] or 0) for r in whole.collect()), key=repr)


def test_rebuild_turns_a_position_over(spark):
    """Open, increase, both kinds of reduction, changed stops, a turn to the other side, a reentry; sent twice and in disorder."""
    import json

    from tradelake.operators import rebuild

    def deal(i, side, volume, entry="IN", **more):
        return (i, 7, f"k{i}", NOW + i * HOUR, json.dumps({"kind": "DEAL", "symbol": "X", "side": side, "entry": entry, "ticket": 100 + i, "volume": volume, "price": 10 + i, "profit": 1, "sl": 5} | more))

    stops = (4, 7, "k4", NOW + 4 * HOUR, json.dumps({"kind": "STOPS", "symbol": "X", "sl": 5, "tp": 20}))
    rows = [deal(1, "BUY", 3), deal(2, "BUY", 1), deal(3, "SELL", 1, "OUT"), stops, deal(5, "SELL", 1), deal(6, "SELL", 5, "INOUT", reason="SL"), deal(7, "BUY", 3, "OUT", reason="TP"), deal(8, "SELL", 1), (9, 7, "k9", NOW, "{"), (10, 7, "k10", NOW, '{"kind": "DEAL", "symbol": "X"}')]
    sent = spark.createDataFrame([*rows[::-1], *rows], "id long, account_id long, idempotency_key string, sent_at timestamp, payload string").repartition(4)
    parsed = rebuild.parse(sent)
    assert sorted((r.id, r.error) for r in parsed.where("error IS NOT NULL").collect()) == [(9, "unreadable payload"), (10, "incomplete deal")]
    cut = rebuild.parts(parsed)
    folded = rebuild.trades(cut)
    got = {r.trade_id: r for r in folded.collect()}
    assert {(i, r.direction, r.status, int(r.initial_volume), int(r.max_volume), r.exit_reason) for i, r in got.items()} == {("7:X:1", "BUY", "CLOSED", 3, 4, "SL"), ("7:X:2", "SELL", "CLOSED", 3, 3, "TP"), ("7:X:3", "SELL", "OPEN", 1, 1, None)}
    assert got["7:X:1"].close_price == Decimal("15") and got["7:X:1"].gross_profit == 5 and got["7:X:2"].gross_profit == 1
    events = sorted((r.event_time, r.trade_id[-1], r.event_type, r.is_inferred) for r in rebuild.events(cut, folded, 120).collect())
    assert [(t, k, i) for _, t, k, i in events] == [
        ("1", "TRADE_OPENED", False), ("1", "POSITION_INCREASED", False), ("1", "PARTIAL_CLOSE", False), ("1", "TP_MODIFIED", False), ("1", "POSITION_DECREASED", False),
        ("1", "TRADE_CLOSED", False), ("2", "TRADE_OPENED", False), ("2", "TRADE_CLOSED", False), ("3", "REENTRY", True), ("3", "TRADE_OPENED", False),
    ]


def test_nothing_looks_ahead_in_trade_dna(spark):
    """The cutoff is before the entry, also where a bar closes at the entry itself; without a calendar news is null, with a reason."""
    import json

    from tradelake.operators import dna

    ticks = spark.createDataFrame([("x", NOW + dt.timedelta(minutes=13 * i), Decimal(100 + (i * 37) % 23), i) for i in range(300)], "symbol string, ts timestamp, price decimal(24,10), event_id long")
    hourly = bars.bars_from_ticks(ticks, 3600)
    entries = spark.createDataFrame([(k, "x", NOW + k * HOUR, Decimal(110), 0.01) for k in (0, 1, 2, 30)], "trade_id long, symbol string, entry_time timestamp, entry_price decimal(24,10), point double")
    got = {r.trade_id: r for r in dna.trade_dna(entries, hourly, 3600, {"h1": hourly}).collect()}
    assert set(got) == {2, 30} and all(r.data_cutoff < NOW + k * HOUR for k, r in got.items()) and got[30].data_cutoff == NOW + 29 * HOUR
    reasons = json.loads(got[30].null_reasons)
    assert got[30].news_nearby is None and reasons["news_nearby"] == "no_calendar" and reasons["spread_points"] == "no_source" and reasons["ema50"] == "short_history" and "ema20" not in reasons


def test_store_checks_stages_and_publishes(spark, tmp_path):
    from tradelake.sources.store import RuleViolation, Store

    store, now = Store(spark, f"{tmp_path}/store"), F.lit(NOW).cast("timestamp")
    broker = spark.createDataFrame([("b1", "Broker x")], "id string, name string")
    account = spark.createDataFrame([("a1", "b1", 5, "Demo-Server", "USD", "DEMO", "HEDGING")], "id string, broker_id string, login long, server string, currency string, account_type string, margin_mode string")
    with store.scope():
        store.insert("brokers", broker, now)
        added = store.insert("accounts", account, now)
        assert added.first().active is True
    assert store.read("accounts").count() == 1 and store.read("brokers").first().server_utc_offset_policy == "EA_REPORTED"
    with pytest.raises(RuleViolation) as e, store.scope():
        store.insert("brokers", broker.withColumn("id", F.lit("b2")).withColumn("name", F.lit("other")), now)
        store.insert("accounts", account.withColumn("id", F.lit("a2")), now)
    assert e.value.rules == ["uq_accounts_server_login"]
    assert store.read("brokers").count() == 1  # rolled back with the other
    with pytest.raises(RuleViolation) as e, store.scope():
        store.change("brokers", store.read("brokers").withColumn("op", F.lit("DELETE")), now)
    assert e.value.rules == ["fk_accounts_broker_id_brokers"]
    with pytest.raises(RuleViolation) as e, store.scope():
        store.change("accounts", store.read("accounts").withColumn("op", F.lit("DELETE")), now)
    assert e.value.rules == ["no_delete_accounts"]
    with store.scope():
        store.change("accounts", store.read("accounts").withColumn("leverage", F.lit(30)).withColumn("op", F.lit("UPDATE")), now)
    assert store.read("accounts").first().leverage == 30
    with pytest.raises(RuleViolation) as e, store.scope():
        store.change("accounts", store.read("accounts").withColumn("account_type", F.lit("PLAY")).withColumn("op", F.lit("UPDATE")), now)
    assert e.value.rules == ["ck_accounts_accounttype"]
    trade = spark.createDataFrame([{k: v for k, v in TRADE.items() if k != "status"}])
    with store.scope():
        store.insert("trades", trade, now)
    with store.scope():
        later = F.lit(NOW + HOUR).cast("timestamp")
        store.change("trades", store.read("trades").withColumn("status", F.lit("CLOSED")).withColumn("close_time", later).withColumn("op", F.lit("UPDATE")), later)
    closed = store.read("trades").first()
    assert closed.status == "CLOSED" and closed.updated_at == NOW + HOUR and closed.created_at == NOW


def test_guards_can_be_taken_off(spark):
    trade = rows(spark, "trades", TRADE)
    delete = trade.withColumn("op", F.lit("DELETE"))
    assert history.guard(delete, trade, "trades").first().rule == "no_delete_trades"
    assert history.guard(delete, trade, "trades", installed=False).first().rule is None


def test_trade_without_deployment_is_kept(spark):
    t = rows(spark, "trades", TRADE)
    none = rows(spark, "deployments", DEPLOYMENT | {"magic_number": 1}, ended_at=None)
    got = lifecycle.attribute(t.drop("deployment_id"), none).first()
    assert got.deployment_id is None and got.n_deployments == 0


def test_trends_are_told_once_for_all_timeframes(spark):
    """A row for each time at which a bar of some timeframe closes, whatever the number of trades: their rows are not multiplied."""
    from tradelake.operators import dna

    ticks = spark.createDataFrame([("x", NOW + dt.timedelta(minutes=13 * i), Decimal(100 + (i * 37) % 23), i) for i in range(60)], "symbol string, ts timestamp, price decimal(24,10), event_id long")
    frames = {"m15": bars.bars_from_ticks(ticks, 900), "h1": bars.bars_from_ticks(ticks, 3600)}
    got = dna.trends(frames, 0.001).collect()
    ends = {n: {r.bar_time + dt.timedelta(seconds=s) for r in frames[n].collect()} for n, s in (("m15", 900), ("h1", 3600))}
    assert sorted(r.closed_at for r in got) == sorted(ends["m15"] | ends["h1"])
    assert all((r[f"trend_{n}"] is not None) == (r.closed_at in ends[n]) for r in got for n in ends)


def test_nearest_equals_brute_force_and_makes_no_pairs(spark):
    """Distances by the second, ties, edges of pieces, null keys and times; no join of near pairs, so dense times cost no square."""
    import random

    rng = random.Random(3)
    at = lambda: NOW + dt.timedelta(seconds=rng.randrange(4000), microseconds=rng.randrange(10**6))
    left = [(i, rng.choice("ab"), at()) for i in range(150)] + [(900, None, NOW), (901, "a", None), (902, "a", NOW + dt.timedelta(seconds=9000)), (903, "z", NOW)]
    right = [(rng.choice("ab"), at(), rng.choice("pqr")) for _ in range(60)] + [(None, NOW, "p"), ("a", None, "p"), ("b", NOW, "r"), ("b", NOW, "q")]
    out = asof.nearest(spark.createDataFrame(left, "id long, k string, t timestamp"), "t", spark.createDataFrame(right, "k string, rt timestamp, v string"), "rt", 60, ["k"], ["v"])
    second = lambda x: x.replace(microsecond=0)

    def want(k, t):
        offs = [(second(rt) - second(t), v) for rk, rt, v in right if k is not None and rk == k and t is not None and rt is not None]
        near = [(abs(o.total_seconds()), o.total_seconds(), v) for o, v in offs if abs(o.total_seconds()) <= 60]
        return (int(min(near)[1]), min(near)[2]) if near else (None, None)

    assert {r.id: (r.seconds_off, r.v) for r in out.collect()} == {i: want(k, t) for i, k, t in left}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
