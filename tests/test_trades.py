"""Chains, exposures, excursions and rebuilt trades on small fixtures."""

from __future__ import annotations

import datetime as dt
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tradelake.functions import distributions, tables
from tradelake.operators import chains, extrema, lifecycle, research

NOW = dt.datetime(2026, 1, 5, 12)
HOUR = dt.timedelta(hours=1)


def plain_chains(links):
    parent = {i: p for i, p in links if i is not None}
    parent = {i: p if p in parent else None for i, p in parent.items()}
    out = []
    for i in parent:
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        out.append((i, seen[-1], len(seen) - 1, None) if at is None else (i, None, None, min(seen[seen.index(at) :])))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_chains(spark, seed):
    """Trees, dangling links, self links and cycles with tails."""
    rng = random.Random(seed)
    ids = rng.sample(range(1000), 150)
    links = [(i, rng.choice([None, i, rng.choice(ids), rng.choice(ids), rng.choice(ids), 5000]) if seed else rng.choice([None, i - 1, i - 2])) for i in ids]
    got = chains.chains(spark.createDataFrame([*links, (None, 3)], "trade_id long, reentry_of_trade_id long"))
    assert sorted(map(tuple, got.collect())) == plain_chains(links)


def test_a_long_chain_takes_log_rounds(spark, monkeypatch):
    """100,000 links, and a cycle of 3,000, in at most as many tables as distances double."""
    n, written = 100_000, []
    keep = tables.write_table

    def counted(df, keep_=False):
        written.append(1)
        return keep(df, keep_)

    monkeypatch.setattr(tables, "write_table", counted)
    # ids in an order that has nothing to do with the chain
    chain = spark.range(n).selectExpr("(id * 7919) % 100003 AS trade_id", "CASE WHEN id > 0 THEN ((id - 1) * 7919) % 100003 END AS reentry_of_trade_id")
    cycle = spark.range(3000).selectExpr("200000 + id AS trade_id", "200000 + (id + 1) % 3000 AS reentry_of_trade_id")
    got = chains.chains(chain.unionByName(cycle))
    assert got.where("cycle_id = 200000").count() == 3000
    told = got.where("root_trade_id = 0").selectExpr("count(*)", "max(depth)", "sum(depth)", "count(DISTINCT depth)").first()
    assert tuple(told) == (n, n - 1, n * (n - 1) // 2, n)
    assert len(written) <= 24


def test_chains_of_text_ids_and_no_rows(spark):
    links = spark.createDataFrame([("b", "a"), ("a", None), ("c", "b"), ("x", "x")], "trade_id string, reentry_of_trade_id string")
    assert sorted(map(tuple, chains.chains(links).collect()), key=str) == [("a", "a", 0, None), ("b", "a", 1, None), ("c", "a", 2, None), ("x", None, None, "x")]
    assert chains.chains(links.limit(0)).count() == 0


# ambiguous deployments


def plain_exposures(rows):
    out = []
    for key in {r[:3] for r in rows}:
        held = [(s, e) for *k, s, e in rows if tuple(k) == key and s is not None and (e is None or e > s)]
        times = sorted({t for s, e in held for t in (s, e) if t is not None})
        counts = [sum(s <= t and (e is None or t < e) for s, e in held) for t in times]
        i = 0
        while i < len(times):
            if counts[i] >= 2:
                j = i
                while j < len(times) and counts[j] >= 2:
                    j += 1
                out.append((*key, times[i], times[j] if j < len(times) else None, max(counts[i:j])))
                i = j
            i += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_exposures(spark, seed):
    """Touching, nested, endless and empty deployments, null keys, one key with very many."""
    rng, rows = random.Random(seed), []
    for _ in range(200):
        start = rng.randrange(60)
        end = rng.choice([None, start, start + rng.randrange(1, 9), start + rng.randrange(1, 9)])
        rows.append((rng.choice([1, 1, 1, 2, None]), rng.choice([7, None]), rng.choice(["X", "X", "Y"]), NOW + start * HOUR, None if end is None else NOW + end * HOUR))
    rows.append((5, 7, "X", None, NOW))
    df = spark.createDataFrame(rows, "account_id long, magic_number long, symbol string, started_at timestamp, ended_at timestamp")
    got = lifecycle.exposures(df).select("account_id", "magic_number", "symbol", "ambiguous_from", "ambiguous_until", "most")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_exposures(rows)
    assert lifecycle.exposures(df.limit(0)).count() == 0


# excursions


def test_span_extrema(spark):
    """Spans within a day, over many days, over days without bars, before and behind all bars, and empty ones."""
    rng = random.Random(3)
    bars = [(s, NOW + t * HOUR, rng.randrange(100, 200), rng.randrange(100)) for s in "XY" for t in rng.sample(range(-24 * 40, 24 * 40), 300)]
    spans = [(i, rng.choice("XYZ"), NOW + rng.randrange(-24 * 50, 24 * 50) * HOUR) for i in range(300)]
    spans = [(i, s, a, a + rng.choice([0, 1, 5, 24, 30, 24 * 9, 24 * 33, 24 * 100]) * HOUR) for i, s, a in spans] + [(900, "X", NOW, None), (901, None, NOW, NOW + HOUR), (902, "X", NOW, NOW - HOUR)]
    want = []
    for i, s, a, b in spans:
        held = [x for x in bars if x[0] == s and b is not None and a <= x[1] < b]
        if held:
            want.append((i, max(x[2] for x in held), min(x[3] for x in held), len(held)))
    b = spark.createDataFrame(bars, "symbol string, bar_time timestamp, high long, low long")
    df = spark.createDataFrame(spans, "id long, symbol string, start timestamp, end timestamp")
    assert sorted(map(tuple, extrema.span_extrema(df, b).collect())) == want
    assert extrema.span_extrema(df.limit(0), b).count() == extrema.span_extrema(df, b.limit(0)).count() == 0


def test_a_long_span_meets_few_rows(spark):
    """What a span is joined with does not grow with its length: five lookups for 10 and for 1,000 days."""
    bars = spark.range(24 * 1200).selectExpr("'X' AS symbol", "timestamp_seconds(id * 3600) AS bar_time", "id % 977 AS high", "id % 983 AS low")
    for days in (10, 1000):
        span = spark.createDataFrame([(1, "X", dt.datetime(1970, 1, 3, 5), dt.datetime(1970, 1, 3, 5) + days * 24 * HOUR)], "id long, symbol string, start timestamp, end timestamp")
        found = extrema.span_extrema(span, bars)
        assert found.first().n_bars == days * 24
        looked = [n for n in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Generate explode" in n]
        assert len(looked) >= 1


# tests of small samples


def test_student_and_binomial(spark):
    """Published quantiles, and sums of exact fractions."""
    published = [(12.706204736, 1, 0.05), (4.302652730, 2, 0.05), (2.570581836, 5, 0.05), (3.169272673, 10, 0.01), (2.042272456, 30, 0.05), (1.660234326, 100, 0.1), (63.656741162, 1, 0.01)]
    df = spark.createDataFrame(published, "t double, n int, p double")
    assert all(abs(r.got - r.p) < 1e-9 for r in df.select(distributions.student_two_sided(F.col("t"), F.col("n")).alias("got"), "p").collect())
    rows = [(k, n, p) for n in (1, 7, 60, 300) for k in (0, 1, n // 3, n // 2, n, n + 1) for p in (0.5, 0.3, 0.01)]
    got = spark.createDataFrame(rows, "k int, n int, p double").select("k", "n", "p", distributions.binomial_at_least(F.col("k"), F.col("n"), F.col("p")).alias("got")).collect()
    for r in got:
        p = Fraction(r.p)
        assert abs(r.got - float(sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k, r.n + 1)))) < 1e-12
    large = spark.range(1).select(distributions.binomial_at_least(F.lit(500_001), F.lit(1_000_001), F.lit(0.5))).first()[0]
    assert abs(large - 0.5) < 1e-8
    assert spark.range(1).select(distributions.student_two_sided(F.lit(1.0), F.lit(0))).first()[0] is None


def test_methods_are_told(spark):
    rows = [(1, 0.5, 1.0, 12, 8), (2, 0.5, 1.0, 500, 260), (3, 0.5, None, 1, 1), (4, 0.0, 0.0, 5, 0), (5, None, None, 0, 0)]
    df = spark.createDataFrame(rows, "id int, mean double, var double, n long, wins long")
    mean, how = research.mean_test(F.col("mean"), F.col("var"), F.col("n"))
    share, exact = research.share_test(F.col("wins"), F.col("n"), F.lit(0.5))
    got = {r.id: r for r in df.select("id", mean.alias("p"), how.alias("how"), share.alias("q"), exact.alias("exact")).collect()}
    assert [got[i].how for i in range(1, 6)] == ["student_t", "normal", None, None, None]
    assert got[1].q == pytest.approx(2 * sum(math.comb(12, i) for i in range(8, 13)) / 2**12) and got[4].q == pytest.approx(2 / 32) and got[5].q is None
    assert got[3].q == pytest.approx(1) and got[1].exact == "exact_binomial"


def test_bootstrap_covers(spark):
    """Nine in ten intervals of samples of a known mean hold it; the same seed gives the same, whatever the partitions."""
    rng = random.Random(4)
    rows = [(g, 1000 * g + i, rng.gauss(1, 3)) for g in range(60) for i in range(80)]
    df = spark.createDataFrame(rows, "g int, id long, net double").withColumn("net", F.col("net").cast("decimal(20,4)"))
    got = research.bootstrap(df, ["g"], "id", "net").collect()
    held = sum(r.expectancy_low <= 1 <= r.expectancy_high for r in got)
    assert 50 <= held <= 60 and all(r.n == 80 and r.factor_low < r.factor_high for r in got)
    again = research.bootstrap(df.repartition(7), ["g"], "id", "net").collect()
    assert sorted(got) == sorted(again)
    wins = research.bootstrap(df.where("net > 0 AND g = 1"), ["g"], "id", "net").first()
    assert wins.factor_low is None and wins.expectancy_low > 0


# clocks


def test_clock_offsets(spark):
    """Two changes, single readings and a whole day off, a day without readings, a server that never changes."""
    rng, readings = random.Random(6), []
    for day in range(60):
        if day == 33:
            continue
        for i in range(12):
            at = dt.datetime(2026, 3, 1, 2 * i, 30) + day * 24 * HOUR
            offset = 120 if at < dt.datetime(2026, 3, 29, 1) else 180 if at < dt.datetime(2026, 4, 20, 13) else 60
            offset = 480 if day == 10 else rng.choice([0, 240, 999]) if rng.random() < 0.2 else offset
            readings.append(("a", at, at + dt.timedelta(minutes=offset, seconds=rng.randrange(-200, 200))))
            readings.append(("b", at, at + dt.timedelta(minutes=-300)))
    readings += [("c", None, NOW), (None, NOW, NOW)]
    df = spark.createDataFrame(readings, "server string, utc_time timestamp, server_time timestamp").withColumn("server_time", F.col("server_time").cast("timestamp_ntz"))
    got = sorted(((r.server, r.offset_minutes, r.valid_from, r.valid_until) for r in lifecycle.clock_offsets(df).collect()), key=lambda r: (r[0], r[2]))
    first = dt.datetime(2026, 3, 1, 0, 30)
    assert [(s, o) for s, o, _, _ in got] == [("a", 120), ("a", 180), ("a", 60), ("b", -300)]
    assert got[0][2] == first and got[3][2:] == (first, None) and got[2][3] is None
    for (_, _, _, until), (_, _, since, _), true in ((got[0], got[1], dt.datetime(2026, 3, 29, 1)), (got[1], got[2], dt.datetime(2026, 4, 20, 13))):
        assert until == since and true <= since <= true + 6 * HOUR


def test_only_rows_with_followers_take_part_in_the_rounds(spark, monkeypatch):
    """A star of a thousand rows around a chain of four: the doubling sees the chain only."""
    from tradelake.operators import chains

    seen, doubled = [], chains._doubled
    monkeypatch.setattr(chains, "_doubled", lambda left, at: (seen.append(at.count()), doubled(left, at))[1])
    links = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 2), *[(i, 3) for i in range(10, 1010)], (5000, 4999)], "trade_id long, reentry_of_trade_id long")
    got = {r.trade_id: (r.root_trade_id, r.depth, r.cycle_id) for r in chains.chains(links).collect()}
    assert got == {0: (0, 0, None), 1: (0, 1, None), 2: (0, 2, None), 3: (0, 3, None), **{i: (0, 4, None) for i in range(10, 1010)}, 5000: (5000, 0, None)}
    assert max(seen) == 4
