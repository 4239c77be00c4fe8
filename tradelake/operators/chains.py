"""Chains over a self reference, such as the trade that a trade reenters: roots, depths and cycles by pointer doubling.

Each row points to an ancestor. In a round every row that has not met a root takes over the pointer of the row it points to, so
distances double, and a chain of n links needs about log2(n) rounds. Rows that have met a root are written once and
looked up only. A round in which no row meets a root proves that all rows left lead into cycles, as an unfinished chain has a
row for each depth.

Only rows that others point to take part in the rounds. All rows get their result from their parent's, by one join at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelake.functions.tables import materialize, scratch


def chains(links: DataFrame, id_col: str = "trade_id", parent_col: str = "reentry_of_trade_id") -> DataFrame:
    """links (id_col, parent_col), ids once each -> id_col, root_trade_id, depth, cycle_id.

    A row without a parent, or whose parent is not there (a broken reference, which orphans() tells), is a root of depth 0. A row
    that leads into a cycle has no root and no depth, but the least id on the cycle as cycle_id; a row that is its own parent is a
    cycle. Rows without an id are left out: nothing can point to them. Links may skip rows and lead from any row to any other.
    """
    with scratch(links.sparkSession):
        return materialize(_chains(links, id_col, parent_col), keep=True)


def _chains(links: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    rows = links.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).where("id IS NOT NULL")
    parents = rows.where("parent IS NOT NULL").select(F.col("parent").alias("id")).distinct()
    inner = materialize(rows.join(parents, "id", "left_semi"))
    above = materialize(_met(inner)).select(F.col("id").alias("_id"), "root", "depth", "cycle")
    told = rows.join(above, F.col("parent") == F.col("_id"), "left")
    # a row whose parent is not there is a root
    root = F.when(F.col("_id").isNull(), F.col("id")).otherwise(F.col("root"))
    depth = F.when(F.col("_id").isNull(), F.lit(0).cast("long")).otherwise(F.col("depth") + 1)
    return told.select(F.col("id").alias(id_col), root.alias("root_trade_id"), depth.alias("depth"), F.col("cycle").alias("cycle_id"))


def _met(rows: DataFrame) -> DataFrame:
    """rows (id, parent) -> id, root, depth, cycle."""
    there = rows.select(F.col("id").alias("_there"))
    known = rows.join(there, F.col("parent") == F.col("_there"), "left").select("id", F.col("_there").alias("parent"))
    # at: the ancestor steps above; low: the least id from the row up to, but without, at
    left = materialize(known.select("id", F.coalesce("parent", "id").alias("at"), F.col("parent").isNotNull().cast("long").alias("steps"), F.col("id").alias("low"), F.col("parent").isNull().alias("done")))
    met = [left.where("done")]
    left = left.where("NOT done")
    n, before = left.count(), None
    while n and n != before:
        at = reduce(DataFrame.unionByName, [*met, left])
        turned = materialize(_doubled(left, at))
        met.append(turned.where("done"))
        left, before = turned.where("NOT done"), n
        n = left.count()
    found = reduce(DataFrame.unionByName, met).select("id", F.col("at").alias("root"), F.col("steps").alias("depth"), F.lit(None).cast(dict(rows.dtypes)["id"]).alias("cycle"))
    if not n:
        return found
    steps = left.agg(F.min("steps")).first()[0]
    while steps < n:  # until a path covers its whole cycle
        left, steps = materialize(_doubled(left, left)), 2 * steps
    ends = left.select(F.col("id").alias("_end"), F.col("low").alias("cycle"))
    rounds = left.join(ends, F.col("at") == F.col("_end")).select("id", F.lit(None).cast(dict(rows.dtypes)["id"]).alias("root"), F.lit(None).cast("long").alias("depth"), "cycle")
    return found.unionByName(rounds)


def _doubled(left: DataFrame, at: DataFrame) -> DataFrame:
    above = at.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("low").alias("_low"), F.col("done").alias("_done"))
    joined = left.join(above, F.col("at") == F.col("_id"))
    # a root adds nothing to the path, not even itself
    low = F.when(F.col("_steps") > 0, F.least("low", "_low")).otherwise(F.col("low"))
    return joined.select("id", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), low.alias("low"), F.col("_done").alias("done"))
