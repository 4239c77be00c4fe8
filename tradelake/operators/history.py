"""Immutability: guards on change sets, audits between snapshots, and the latest row of each entity.

File tables have no UPDATE or DELETE: a change set is a DataFrame with `op` (UPDATE or DELETE), the key and the new values of
all columns. It is guarded against the present rows, then applied by an anti join and a union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelake.plans.schemas import APPEND_ONLY, MUTABLE_COLUMNS, NO_DELETE, TABLES


def canonical(table: str, column: str, value: Column) -> Column:
    """A value as it is compared: JSON by content, with sorted keys."""
    json = {c.name for c in TABLES[table].columns if c.kind == "json"}
    return F.to_json(F.try_parse_json(value)) if column in json else value


def guard(changes: DataFrame, current: DataFrame, table: str, installed: bool = True) -> DataFrame:
    """Changes that meet a present row, with `rule`: null if allowed, else the name of what forbids them.

    Rows that no key matches raise nothing, as an update of no row does not. Without installed guards all is allowed.
    """
    spec = TABLES[table]
    key = list(spec.primary_key)
    values = [c.name for c in spec.columns if c.name in current.columns and c.name not in key]
    old = current.select(*key, *[F.col(f"`{c}`").alias(f"_old_{c}") for c in values])
    rows = changes.join(old, key)
    rule = F.lit(None).cast("string")
    if not installed:
        pass
    elif table in APPEND_ONLY:
        rule = F.concat(F.lit(f"append_only_{table}_"), F.lower("op"))
    elif table in NO_DELETE:
        frozen = [c for c in values if c in changes.columns and table in MUTABLE_COLUMNS and c not in MUTABLE_COLUMNS[table]]
        changed = F.lit(False)
        for c in frozen:
            changed = changed | ~canonical(table, c, F.col(f"`{c}`")).eqNullSafe(canonical(table, c, F.col(f"_old_{c}")))
        rule = F.when(F.col("op") == "DELETE", F.lit(f"no_delete_{table}")).when(changed, F.lit(f"frozen_columns_{table}"))
    return rows.withColumn("rule", rule).drop(*[f"_old_{c}" for c in values])


def apply_changes(current: DataFrame, accepted: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table after the accepted changes, of which a key has at most one."""
    untouched = current.join(accepted.select(*key), list(key), "left_anti")
    return untouched.unionByName(accepted.where("op = 'UPDATE'").select(*current.columns))


def audit_append_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old snapshot that the new one lacks: changed or deleted ones."""
    return old.exceptAll(new.select(*old.columns))


def audit_no_delete(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return old.join(new.select(*key), list(key), "left_anti")


def audit_frozen(old: DataFrame, new: DataFrame, key: Sequence[str], frozen: Sequence[str], json: Sequence[str] = ()) -> DataFrame:
    """key and `changed`, the frozen columns whose value differs between the snapshots."""

    def value(side: str, c: str) -> Column:
        col = F.col(f"{side}.{c}")
        return F.to_json(F.try_parse_json(col)) if c in json else col

    joined = old.alias("o").join(new.alias("n"), list(key))
    names = F.array_compact(F.array(*[F.when(~value("o", c).eqNullSafe(value("n", c)), F.lit(c)) for c in frozen]))
    return joined.select(*key, names.alias("changed")).where(F.size("changed") > 0)


def latest(df: DataFrame, key: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """The row of each key that comes last by version, reduced before the shuffle."""
    return df.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(*version)).alias("_last")).select("_last.*")
