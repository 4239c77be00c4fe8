"""Equity and drawdown, terminal liveness, alerts and credentials."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelake.functions.tables import materialize
from tradelake.operators.series import numbered, over_pieces, running_max, running_sum


def equity(changes: DataFrame, key: str, order: Sequence[str], change: str, start: float = 0) -> DataFrame:
    """changes of an account (the first column of order is a time, all together are total) with equity, start and all changes so far."""
    rows = numbered(changes, [key], order[0], order[1:])
    summed = running_sum(materialize(rows), {"_sum": F.col(change)}, [key])
    return summed.withColumn("equity", (F.lit(start) + F.col("_sum")).cast("decimal(20,4)")).drop("_sum")


def drawdown(series: DataFrame, key: str, order: Sequence[str], equity: str) -> DataFrame:
    """series with peak, the largest equity so far, and drawdown, equity over peak less one (null for a peak of zero).

    Peaks run within pieces of an account's series and carry over from piece to piece, so no task holds a whole account.
    """
    rows = materialize(numbered(series, [key], order[0], order[1:]))
    out = running_max(rows, {"peak": F.col(equity)}, [key])
    return out.withColumn("drawdown", F.try_divide(F.col(equity).cast("double"), F.col("peak").cast("double")) - 1).drop("_n")


def silences(beats: DataFrame, key: str, at: str, minutes: int) -> DataFrame:
    """Times without a sign of life for longer than so many minutes: key, silent_from, silent_until, minutes. Beats without a key or
    a time do not count; equal times are one beat. The next beat is found within pieces of a terminal's beats."""
    ticks = beats.select(key, at).where(F.col(key).isNotNull() & F.col(at).isNotNull()).distinct()
    rows = numbered(ticks, [key], at)
    ahead = over_pieces(rows, {"_next": lambda w: F.lead(at).over(w)}, ahead=1, keys=[key])
    out = ahead.select(key, F.col(at).alias("silent_from"), F.col("_next").alias("silent_until"))
    gap = F.unix_timestamp("silent_until") - F.unix_timestamp("silent_from")
    return out.where(gap > minutes * 60).withColumn("minutes", F.floor(gap / 60).cast("long"))


def last_seen(beats: DataFrame, key: str, at: str) -> DataFrame:
    return beats.groupBy(key).agg(F.max(at).alias("last_seen_at"), F.count("*").alias("n"))


def alive_sessions(beats: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Runs of signs of life with no longer gap between them."""
    out = beats.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("alive_from"), F.col("w.end").alias("alive_until"), "n")


def alerts(sources: Mapping[str, tuple[DataFrame, str, Column, Column]]) -> DataFrame:
    """One table of alerts from rule -> (rows, severity, subject, message)."""
    out: DataFrame | None = None
    for rule, (rows, severity, subject, message) in sources.items():
        part = rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), message.alias("message"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def open_alerts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("acknowledged_at").isNull())


def active_clients(clients: DataFrame, prefix: str) -> DataFrame:
    """The client of a key prefix, unless revoked."""
    return clients.where((F.col("key_prefix") == prefix) & F.col("revoked_at").isNull())
