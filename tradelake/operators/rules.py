"""Integrity rules as DataFrame expressions: row rules in one projection, keys by aggregation, references by anti join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelake.plans.schemas import DECIMALS, TABLES


def row_rules(table: str, columns: Sequence[str] | None = None) -> dict[str, Column]:
    """Constraint name -> what must be true or null, for the rules whose columns are all present."""
    spec = TABLES[table]
    have = set(columns) if columns is not None else {c.name for c in spec.columns}
    out: dict[str, Column] = {}
    for name, text in spec.checks.items():
        if {c.name for c in spec.columns if c.name in text.replace("(", " ").split()} <= have:
            out[f"ck_{table}_{name}"] = F.expr(text)
    for c in spec.columns:
        if c.name not in have:
            continue
        col = F.col(f"`{c.name}`")
        if c.domain:
            out[f"ck_{table}_{c.kind.lower()}"] = col.isin(*c.domain)
        if not c.nullable:
            out[f"nn_{table}_{c.name}"] = col.isNotNull()
        if c.kind == "varchar":
            out[f"len_{table}_{c.name}"] = F.char_length(col) <= c.size
        if c.kind in DECIMALS:
            precision, scale = DECIMALS[c.kind]
            out[f"num_{table}_{c.name}"] = F.abs(F.round(col, scale)) < F.lit(10 ** (precision - scale)).cast("decimal(38,0)")  # stored rounded
    return out


def violations(df: DataFrame, table: str, only: Sequence[str] | None = None) -> DataFrame:
    """df with `violations`, the names of the row rules that a row breaks, in the order of the registry."""
    rules = row_rules(table, df.columns)
    broken = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items() if only is None or name in only]
    return df.withColumn("violations", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def duplicate_keys(df: DataFrame, key: Sequence[str], where: str | None = None) -> DataFrame:
    """Keys that several rows have, with `n`; null keys are distinct from each other."""
    rows = df.where(where) if where else df
    for c in key:
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows of child whose reference is neither null nor in parent."""
    keys = parent.select(F.col(parent_column).alias("_parent"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def blocked_deletes(deleted: DataFrame, key: str, child: DataFrame, column: str) -> DataFrame:
    """Rows to be deleted that child rows still refer to."""
    return deleted.join(child.select(F.col(column).alias("_child")), F.col(key) == F.col("_child"), "left_semi")


def new_key_conflicts(incoming: DataFrame, stored: DataFrame, key: Sequence[str], where: str | None = None) -> DataFrame:
    """Keys that incoming has twice, or once beside a stored row."""
    both = incoming.select(*key, *_extra(where, incoming, key)).withColumn("_new", F.lit(1))
    both = both.unionByName(stored.select(*key, *_extra(where, stored, key)).withColumn("_new", F.lit(0)))
    rows = both.where(where) if where else both
    for c in key:
        rows = rows.where(F.col(c).isNotNull())
    return rows.groupBy(*key).agg(F.count("*").alias("n"), F.sum("_new").alias("n_new")).where("n > 1 AND n_new > 0").select(*key, "n")


def _extra(where: str | None, df: DataFrame, key: Sequence[str]) -> list[str]:
    return [c for c in df.columns if where and c not in key and c in where.split()]


def insert_report(incoming: DataFrame, table: str, stored: dict[str, DataFrame]) -> DataFrame:
    """(constraint, n) for everything that speaks against appending incoming to a table; empty if it may be appended.

    stored: the present tables by name, as far as the rules need them.
    """
    spec = TABLES[table]
    out = violations(incoming, table).select(F.explode("violations").alias("constraint")).groupBy("constraint").agg(F.count("*").alias("n"))
    for name, key, where in spec.unique_keys:
        if set(key) <= set(incoming.columns):
            found = new_key_conflicts(incoming, stored[table], key, where) if table in stored else duplicate_keys(incoming, key, where)
            out = out.unionByName(found.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("constraint"), "n"))
    for name, column, parent, parent_column in spec.foreign_keys:
        if column in incoming.columns and parent in stored:
            keys = stored[parent].select(parent_column)
            if parent == table:
                keys = keys.unionByName(incoming.select(parent_column))
            found = orphans(incoming, column, keys, parent_column)
            out = out.unionByName(found.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("constraint"), "n"))
    return out
