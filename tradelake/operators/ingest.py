"""Idempotent ingest of terminal events, the pending queue and its states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelake.functions.tables import materialize
from tradelake.operators.series import numbered
from tradelake.plans.schemas import TABLES

RETRY_LIMIT = 3
#: Rows of a range that ids are given in.
RANGE_ROWS = 1_000_000


def idempotent_insert(incoming: DataFrame, stored: DataFrame | None, key: Sequence[str], arrival: Sequence[Column]) -> DataFrame:
    """The rows of incoming that are new: of each key the first by arrival, unless stored has the key.

    Rows with a null in the key are all new, as nulls are distinct. arrival must order the rows of a key totally.
    """
    null_key = F.lit(False)
    for c in key:
        null_key = null_key | F.col(c).isNull()
    # an aggregate, not a window: a key that is resent very often is reduced before the shuffle
    first = incoming.where(~null_key).groupBy(*key).agg(F.min_by(F.struct("*"), F.struct(*arrival)).alias("_first")).select("_first.*")
    if stored is not None:
        first = first.join(stored.select(*key), list(key), "left_anti")
    return first.unionByName(incoming.where(null_key))


def with_defaults(df: DataFrame, table: str, now: Column) -> DataFrame:
    """df with the columns of the table in their order and types: a default for each column that df lacks.

    A null that df states stays null, for the rules to find.
    """
    out = []
    for c in TABLES[table].columns:
        kind = c.spark_type()
        if c.name in df.columns:
            out.append(F.col(f"`{c.name}`").cast(kind).alias(c.name))
        elif c.default == "now()":
            out.append(now.cast(kind).alias(c.name))
        else:
            out.append(F.lit(c.default).cast(kind).alias(c.name))
    return df.select(*out)


def assign_ids(df: DataFrame, after: int, time: str, then: Sequence[str], column: str = "id", ranges: int | None = None) -> DataFrame:
    """df with consecutive ids after `after` in the order of a timestamp and further columns, which must be total.

    Rows are sorted across the cluster by ranges, one for each RANGE_ROWS rows unless `ranges` says how many; a rank within a range and
    the sizes of the ranges before it, one row each, give the id, so no task sorts everything. Rows without a time come first.
    """
    part = fresh_name(df, "_part")
    n = ranges or 1 + df.count() // RANGE_ROWS
    order = [F.col(c) for c in (time, *then)]
    dealt = materialize(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()))
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = sizes.select(part, (F.lit(after) + F.coalesce(before, F.lit(0))).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return dealt.withColumn("_rank", rank).join(starts, part).withColumn(column, F.col("_start") + F.col("_rank")).drop(part, "_start", "_rank")


def fresh_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def pending(events: DataFrame, terminal: str = "terminal_id", sent: str = "sent_at", id_: str = "id") -> DataFrame:
    """Pending events with `position`, their place in their terminal's queue, numbered through pieces of it."""
    waiting = numbered(events.where(F.col("status") == "PENDING"), [terminal], sent, [id_])
    return waiting.withColumn("position", F.col("_n") + 1).drop("_n")


def advance(events: DataFrame, results: DataFrame, now: Column, limit: int = RETRY_LIMIT) -> DataFrame:
    """events after a processing turn; results (id, ok, error), ok null for events to be ignored.

    A pending event with a result counts an attempt and becomes PROCESSED, IGNORED, or at the limit FAILED; below it, it
    stays PENDING with the error.
    """
    joined = events.join(results.select(F.col("id"), F.col("ok").alias("_ok"), F.col("error").alias("_error"), F.lit(True).alias("_hit")), "id", "left")
    turn = (F.col("status") == "PENDING") & F.coalesce("_hit", F.lit(False))
    attempts = F.when(turn, F.col("attempts") + 1).otherwise(F.col("attempts")).cast("short")
    status = F.when(~turn, F.col("status")).when(F.col("_ok").isNull(), "IGNORED").when(F.col("_ok"), "PROCESSED").when(attempts >= limit, "FAILED").otherwise("PENDING")
    done = turn & (status != "PENDING")
    return joined.select(
        *[c for c in events.columns if c not in ("status", "attempts", "processed_at", "error")],
        status.alias("status"),
        attempts.alias("attempts"),
        F.when(done, now).otherwise(F.col("processed_at")).alias("processed_at"),
        F.when(turn, F.col("_error")).otherwise(F.col("error")).alias("error"),
    )
