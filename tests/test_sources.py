"""A relational database, and bars that are kept up to date."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tradelake.operators import bars
from tradelake.sources import database
from tradelake.streaming import bar_store

NOW = dt.datetime(2026, 3, 2, 10)
MINUTE = dt.timedelta(minutes=1)


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("derby")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(home / "derby.log"))
    return f"jdbc:derby:{home}/db;create=true"


def test_round_trip_of_five_tables(spark, url):
    tables = {
        "bots": spark.range(50).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("bot "), "id").alias("name")),
        "versions": spark.range(0, 3000, 3).select(F.col("id"), (F.col("id") % 50).cast("int").alias("bot_id"), F.when(F.col("id") % 2 == 0, "1.0.0").alias("version")),
        "trades": spark.range(2000).select("id", (F.col("id") * F.lit("1.25").cast("decimal(6,2)")).cast("decimal(20,4)").alias("profit"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("closed_at")),
        "flags": spark.range(20).select("id", (F.col("id") % 3 == 0).alias("active"), F.lit(0.5).alias("ratio")),
        "nothing": spark.range(0).select("id", F.lit("x").alias("text")),
    }
    for name, df in tables.items():
        database.append(df, url, name, connections=2)
        database.append(df.limit(0), url, name)
        back = database.read_table(spark, url, name, key="id")
        assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr), name


def test_ranges_and_pushed_filters(spark, url, monkeypatch):
    monkeypatch.setattr(database, "RANGE_ROWS", 100)
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("kind"), F.lit("padding").alias("text"))
    database.append(df, url, "ranged", connections=3)
    back = database.read_table(spark, url, "ranged", key="id", where="kind = 3", columns=["id", "kind"])
    assert back.rdd.getNumPartitions() == 11
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(KIND,3)" in plan.replace("kind", "KIND").replace("Kind", "KIND") and "text" not in plan.lower().split("readschema")[1]
    assert back.count() == df.where("kind = 3").count()
    assert database.read_table(spark, url, "ranged", key="kind").count() == 1000
    assert database.read_table(spark, url, "ranged").count() == 1000


TICKS = "symbol string, ts timestamp, price decimal(24,10), event_id long"


def ticks(spark, rows):
    return spark.createDataFrame([(s, NOW + at * MINUTE, p, i) for s, at, p, i in rows], TICKS).withColumn("price", F.col("price").cast("decimal(24,10)"))


def files(path):
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_mtime_ns, open(os.path.join(d, f), "rb").read()) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_late_batches_equal_a_full_rebuild(spark, tmp_path):
    """Ticks before, between and behind those that are stored; folders of other days stay byte for byte."""
    from decimal import Decimal as D

    day = 24 * 60
    batches = [
        [("X", 0, D(10), 1), ("X", 5, D(12), 2), ("X", day, D(20), 3), ("Y", 2 * day, D(5), 4)],
        [("X", -1, D(9), 5), ("X", 3, D(30), 6), ("X", 5, D(11), 7), ("Y", 7, D(1), 8)],
        [("X", day + 2, D(2), 9)],
        [],
    ]
    path, done, before = str(tmp_path / "bars"), [], {}
    for rows in batches:
        batch = ticks(spark, rows)
        days = bar_store.update(batch, path, 600)
        done += rows
        got = bar_store.shown(bar_store.read(spark, path))
        want = bars.bars_from_ticks(ticks(spark, done), 600)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
        now = files(path)
        assert all(now[f] == kept for f, kept in before.items() if not any(f"day={d}" in f for d in days))
        before = now
    assert len({f.split("day=")[1][:10] for f in before}) == 3
