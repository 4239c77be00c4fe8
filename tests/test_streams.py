"""Streams with keyed state: order of arrival, resends, what a batch costs, and that nothing is left behind."""

from __future__ import annotations

import datetime as dt
import json
import pickle
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradelake.operators import ingest, rebuild
from tradelake.streaming import state

NOW = dt.datetime(2026, 1, 5, 12)
MINUTE = dt.timedelta(minutes=1)


def arriving(spark, batches, schema, path):
    """A stream that gets the batches one by one."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(stream, tmp_path, name="out"):
    state.run_keyed(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    return stream.sparkSession.read.parquet(str(tmp_path / name))


def test_ingest_and_queue(spark, tmp_path):
    """Keys that come again within a batch and later, null keys, results with and without an event, and the limit of attempts."""
    e = lambda t, k, i, at=0: (t, k, i, NOW + at * MINUTE, False, None, None)
    r = lambda t, k, ok, error=None: (t, k, None, NOW, True, ok, error)
    batches = [
        [e("a", "1", 2, 5), e("a", "1", 1, 3), e("b", "1", 3), e(None, "1", 4), e(None, "1", 4), e("a", "2", 5), r("b", "1", True)],
        [e("a", "1", 0, -9), r("a", "1", False, "bad"), r("a", "2", None), r("x", "y", True), e("b", None, 6)],
        [r("a", "1", False, "worse"), r("b", "1", False, "late")],
        [r("a", "1", False, "worst")],
        [r("a", "1", True), e("a", "2", 9)],
    ]
    changes = run(state.ingest_changes(arriving(spark, batches, state.KEYED, tmp_path / "in")), tmp_path)
    now = sorted(((x.terminal_id, x.idempotency_key, x.id, x.status, x.attempts, x.error) for x in state.queue_now(changes).collect()), key=repr)
    assert changes.where("turn = 0").count() == 6  # of which two are equal, without a key
    assert now == sorted([("a", "1", 1, "FAILED", 3, "worst"), ("a", "2", 5, "IGNORED", 1, None), ("b", "1", 3, "PROCESSED", 1, None), (None, "1", 4, "PENDING", 0, None), ("b", None, 6, "PENDING", 0, None)], key=repr)


def test_ingest_equals_batch_insert(spark, tmp_path):
    """A stream of three runs with resends enters what inserting the runs one after the other does."""
    rng = random.Random(1)
    runs = [[(f"t{rng.randrange(5)}", f"k{rng.randrange(40)}", 1000 * b + i, NOW + rng.randrange(100) * MINUTE, False, None, None) for i in range(120)] for b in range(3)]
    changes = run(state.ingest_changes(arriving(spark, runs, state.KEYED, tmp_path / "in")), tmp_path)
    stored, key = None, ["terminal_id", "idempotency_key"]
    for rows in runs:
        new = ingest.idempotent_insert(spark.createDataFrame(rows, state.KEYED), stored, key, [F.col("at"), F.col("id")])
        stored = new if stored is None else stored.unionByName(new)
    assert sorted(r.id for r in changes.where("turn = 0").collect()) == sorted(r.id for r in stored.collect())


def test_settings_are_put_back(spark):
    before = {k: spark.conf.get(k, None) for k in state.STORE}
    with pytest.raises(ValueError), state.keyed_store(spark):
        assert spark.conf.get(next(iter(state.STORE))).endswith("RocksDBStateStoreProvider")
        raise ValueError
    assert {k: spark.conf.get(k, None) for k in state.STORE} == before


def test_a_batch_reads_no_table(spark, tmp_path):
    """What is stored is never read: the plan of a batch has the stream's new files as its only input."""
    stream = state.ingest_changes(arriving(spark, [[("a", "1", 1, NOW, False, None, None)]], state.KEYED, tmp_path / "in"))
    query = state.run_keyed(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    plan = query._jsq.explainInternal(True) if hasattr(query._jsq, "explainInternal") else ""
    assert "Join" not in plan
    assert [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]] == [1]


MESSAGES = "id long, account_id long, idempotency_key string, sent_at timestamp, payload string"


def messages(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        body = {"kind": rng.choice(["DEAL"] * 4 + ["STOPS", "NOISE"]), "symbol": rng.choice("XY"), "side": rng.choice(["BUY", "SELL"]), "entry": rng.choice(["IN", "OUT"]), "ticket": i, "volume": rng.choice(["0.1", "0.2", "0.5"]), "price": str(rng.randrange(90, 110)), "profit": str(rng.randrange(-9, 9)), "commission": "-0.1", "sl": rng.choice([None, "90", "95"]), "tp": rng.choice([None, "120"]), "reason": rng.choice([None, "SL", "TP"])}
        rows.append((i, rng.randrange(3), f"m{i}", NOW + rng.randrange(n // 2) * MINUTE, json.dumps(body) if rng.random() > 0.03 else "{"))
    again = [(r[0] + 10_000, r[1], r[2], r[3] + MINUTE, r[4]) for r in rows if rng.random() < 0.2]
    return [*rows, *again, (20_000, None, "no account", NOW, rows[0][4]), (20_001, 1, "no time", None, rows[0][4])]


LATER = (99_999, None, None, NOW + dt.timedelta(days=900), None)


def told(df, columns):
    return sorted(map(repr, (tuple(r) for r in df.select(columns).collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_trades_do_not_depend_on_the_order_of_arrival(spark, tmp_path, seed):
    """Shuffled batches, with equal times, resends before their originals and deals that turn a position over, give what the batch gives."""
    rows = messages(seed, 240)
    random.Random(seed).shuffle(rows)
    batches = [rows[i::3] for i in range(3)]
    stream = rebuild.read_payload(arriving(spark, [*batches, [LATER]], MESSAGES, tmp_path / "in"))
    live = run(state.live_trades(stream, "30 days", 60), tmp_path)
    parsed = rebuild.parse(spark.createDataFrame(rows, MESSAGES))
    cut = rebuild.parts(parsed).persist()
    trades = rebuild.trades(cut)
    columns = ["trade_id", "event_type", "event_time", "deal_ticket", "volume", "is_inferred"]
    assert told(live, columns) == told(rebuild.events(cut, trades, 60), columns)
    whole = ["trade_id", "direction", "entry_time", "entry_price", "initial_sl", "initial_tp", "initial_volume", "max_volume", "close_time", "gross_profit", "commission", "swap", "net_profit", "exit_reason", "duration_seconds"]
    assert told(live.where("event_type = 'TRADE_CLOSED'"), whole) == told(trades.where("status = 'CLOSED'"), whole)
    price = [F.round("close_price", 6).alias("p"), "trade_id"]
    assert told(live.where("event_type = 'TRADE_CLOSED'"), price) == told(trades.where("status = 'CLOSED'"), price)
    assert sorted(r.error for r in parsed.where("id >= 20000").collect()) == ["no account", "no time"]


def test_trades_wait_for_the_watermark(spark, tmp_path):
    """A trade is told once the time has passed its deals, not before; the state goes on in the next run."""
    deal = lambda i, side, at: (i, 1, f"m{i}", NOW + at * MINUTE, json.dumps({"kind": "DEAL", "symbol": "X", "side": side, "volume": "1", "price": "10"}))
    stream = arriving(spark, [[deal(1, "BUY", 0), deal(2, "SELL", 5)]], MESSAGES, tmp_path / "in")
    assert run(state.live_trades(rebuild.read_payload(stream), "10 minutes", 60), tmp_path).count() == 0
    stream = arriving(spark, [[deal(3, "BUY", 20)], [deal(3, "BUY", 21)]], MESSAGES, tmp_path / "in")
    assert [r.event_type for r in run(state.live_trades(rebuild.read_payload(stream), "10 minutes", 60), tmp_path).orderBy("event_time").collect()] == ["TRADE_OPENED", "TRADE_CLOSED"]


def test_silence_alerts(spark, tmp_path):
    """A timer opens an alert without a beat, the next beat closes it, late beats fill a gap before it is told, and each silence has one alert."""
    beat = lambda t, at, i=0: (t, i, NOW + at * MINUTE)
    batches = [[beat("a", 0), beat("b", 0), beat("a", 100, 2)], [beat("a", 50, 1), beat("b", 10)], [beat("c", 400)], [beat("a", 420)], [beat("z", 100_000)]]
    stream = arriving(spark, batches, "terminal_id string, id long, at timestamp", tmp_path / "in")
    told_ = run(state.silence_alerts(stream, 60, "120 minutes"), tmp_path)
    at = lambda x: None if x is None else int((x - NOW) / MINUTE)
    got = sorted(((r.terminal_id, at(r.silent_from), at(r.opened_at), at(r.closed_at)) for r in state.alerts_now(told_).collect()), key=repr)
    assert got == sorted([("a", 100, 160, 420), ("a", 420, 480, None), ("b", 10, 70, None), ("c", 400, 460, None)], key=repr)
    assert told_.where("closed_at IS NULL").count() == 4  # each was open first


def test_silences_are_counted_in_whole_seconds(spark, tmp_path):
    """An hour and a fraction of a second is no silence of more than an hour if both clocks show an hour; a second more is one."""
    beat = lambda t, at, i=0: (t, i, NOW + dt.timedelta(seconds=at))
    batches = [[beat("a", 0.2), beat("b", 0.9)], [beat("a", 3600.4, 1), beat("b", 3601.1, 1)], [beat("z", 10_000_000)]]
    stream = arriving(spark, batches, "terminal_id string, id long, at timestamp", tmp_path / "in")
    got = state.alerts_now(run(state.silence_alerts(stream, 60, "5 minutes"), tmp_path)).where("closed_at IS NOT NULL")
    assert [r.terminal_id for r in got.collect()] == ["b"]


def state_rows(stream, tmp_path):
    query = state.run_keyed(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])


def test_keys_of_a_group_share_a_value(spark, tmp_path, monkeypatch):
    """Forty keys in three groups take three values of the state, so a batch calls it by group, not by key; each key has its own queue."""
    monkeypatch.setattr(state, "GROUPS", 3)
    rows = [("a", str(k), k, NOW, False, None, None) for k in range(40)] + [("a", str(k), None, NOW, True, k % 2 == 0, None) for k in range(20)]
    assert state_rows(state.ingest_changes(arriving(spark, [rows[:30], rows[30:]], state.KEYED, tmp_path / "in")), tmp_path) == 3
    now = state.queue_now(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert sorted((r.id, r.status) for r in now) == [(k, "PENDING" if k >= 20 or k % 2 else "PROCESSED") for k in range(40)]


class Held:
    """The state of one key, as a processor sees it; largest has the length of the longest list or set that a value of a map has been."""

    def __init__(self):
        self.values, self.maps, self.timers, self.largest = {}, {}, set(), {}

    def getValueState(self, name, schema):
        return SimpleNamespace(get=lambda: self.values.get(name), update=lambda v: self.values.update({name: v}))

    def getMapState(self, name, *schemas):
        held = self.maps.setdefault(name, {})

        def update(k, v):
            held[k] = v
            self.largest[name] = max(self.largest.get(name, 0), len(pickle.loads(v[0])))

        return SimpleNamespace(getValue=held.get, updateValue=update, removeKey=held.pop)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def fold(rows, batches, every):
    """(what is told, frames, state) of messages (time in s, id, key) that arrive in shuffled batches, with an expiry every so many seconds."""
    held, trades, out, frames = Held(), state.Trades(60), [], 0
    trades.init(held)
    text = lambda at, i, key: json.dumps([key, "DEAL", "BUY" if i % 3 else "SELL", "IN", None, str(i), "1", "10", *[None] * 5])
    table = pd.DataFrame([(at * 10**6, i, text(at, i, key)) for at, i, key in rows], columns=["us", "id", "message"])
    for b in range(batches):
        part = table.iloc[b::batches]
        list(trades.handleInputRows((1, "X"), iter([part.iloc[: len(part) // 2], part.iloc[len(part) // 2 :]]), None))
    last = max(at for at, _, _ in rows)
    for watermark in range(every * 1000, (last + 2 * every) * 1000, every * 1000):
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w)
        for timer in sorted(t for t in held.timers if t <= watermark):
            for frame in trades.handleExpiredTimer((1, "X"), times, None):
                frames += 1
                out.extend(frame["told"])
            held.timers.discard(timer)
    assert not held.timers
    return out, frames, held


def test_a_busy_account_waits_in_pieces(monkeypatch):
    """Values of the state and frames are of bounded size, however many messages an account has, and what is told stays the same."""
    rng = random.Random(4)
    rows = [(rng.randrange(400), i, rng.choice([f"k{i}", f"k{rng.randrange(i + 1)}", None])) for i in range(3000)]
    rng.shuffle(rows)
    whole, frames, held = fold(rows, 1, 1000)
    assert frames == 1 and held.largest["seen"] > 1000
    for name, n in (("PIECE", 50), ("PART", 40), ("TAKEN", 300), ("TOLD", 200)):
        monkeypatch.setattr(state, name, n)
    for every in (1000, 7):
        got, frames, held = fold(rows, 5, every)
        assert got == whole and frames > 10
        assert held.largest["waiting"] <= 100 and not held.maps["waiting"]
        assert held.largest["seen"] < 40 + 200 + 100 and max(len(pickle.loads(v[0])) for v in held.maps["seen"].values()) < 80
        assert len(set().union(*(pickle.loads(v[0]) for v in held.maps["seen"].values()))) == len({k for _, _, k in rows} - {None})
    assert state.STORE["spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"] == "true"


def test_rows_with_an_error_move_the_time_on(spark, tmp_path):
    """They end the waiting of others, of whatever account, and take no state."""
    deal = (1, 1, "m1", NOW, json.dumps({"kind": "DEAL", "symbol": "X", "side": "BUY", "volume": "1", "price": "10"}))
    live = run(state.live_trades(rebuild.read_payload(arriving(spark, [[deal], [(2, 1, None, NOW + 30 * MINUTE, "{")]], MESSAGES, tmp_path / "in")), "10 minutes", 60), tmp_path)
    assert [(r.trade_id, r.event_type, r.event_time, r.volume) for r in live.collect()] == [("1:X:1", "TRADE_OPENED", NOW, 1)]
