"""Tables under a folder: checked appends and updates of Parquet tables.

A scope collects checked changes; leaving the outermost one writes them with plain Spark: new rows are appended, an update
replaces its table. An exception drops what its scope collected, and a scope within a scope undoes only its own part. There is no
transaction over several tables while they are written, and there must be a single writer.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelake.operators import history, ingest, rules
from tradelake.plans.schemas import TABLES


class RuleViolation(Exception):
    """A refused write; `rules` has the names of the constraints that speak against it."""

    def __init__(self, table: str, names: list[str]) -> None:
        super().__init__(f"{table}: {', '.join(names)}")
        self.table, self.rules = table, names


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        #: For each open scope, the tables' new rows, and the whole tables that updates give.
        self.scopes: list[dict[str, tuple[DataFrame | None, list[DataFrame]]]] = []

    def _path(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def read(self, table: str) -> DataFrame:
        """The table as the open scopes see it."""
        fs, path = self._path(table)
        schema = TABLES[table].schema
        out = self.spark.read.schema(schema).parquet(f"{self.root}/{table}") if fs.exists(path) else self.spark.createDataFrame([], schema)
        for scope in self.scopes:
            whole, added = scope.get(table, (None, []))
            out = whole if whole is not None else out
            for rows in added:
                out = out.unionByName(rows)
        return out

    @contextmanager
    def scope(self) -> Iterator[Store]:
        """Write what is changed within, or drop it if an exception leaves the block."""
        self.scopes.append({})
        try:
            yield self
        except BaseException:
            self.scopes.pop()
            raise
        done = self.scopes.pop()
        for table, (whole, added) in done.items():
            if not self.scopes:
                self._write(table, whole, added)
                continue
            before, earlier = self.scopes[-1].get(table, (None, []))
            self.scopes[-1][table] = (before, earlier + added) if whole is None else (whole, added)

    def _write(self, table: str, whole: DataFrame | None, added: list[DataFrame]) -> None:
        rows = whole
        for x in added:
            rows = x if rows is None else rows.unionByName(x)
        path = f"{self.root}/{table}"
        if whole is None:
            rows.write.mode("append").parquet(path)
            return
        rows.write.mode("overwrite").parquet(path + ".next")
        fs, old = self._path(table)
        _, new = self._path(table + ".next")
        fs.delete(old, True)
        fs.rename(new, old)

    def _stage(self, table: str, rows: DataFrame, replace: bool) -> None:
        if not self.scopes:
            self._write(table, rows if replace else None, [] if replace else [rows])
            return
        whole, added = self.scopes[-1].get(table, (None, []))
        self.scopes[-1][table] = (rows, []) if replace else (whole, [*added, rows])

    def insert(self, table: str, rows: DataFrame, now: Column) -> DataFrame:
        """Append rows, with defaults for columns that they lack, or raise RuleViolation; the whole rows that were added."""
        whole = ingest.with_defaults(rows, table, now)
        spec = TABLES[table]
        parents = {p: self.read(p) for _, _, p, _ in spec.foreign_keys} | {table: self.read(table)}
        refused = [r["constraint"] for r in rules.insert_report(whole, table, parents).orderBy("constraint").collect()]
        if refused:
            raise RuleViolation(table, refused)
        self._stage(table, whole, replace=False)
        return whole

    def change(self, table: str, changes: DataFrame, now: Column) -> None:
        """Apply a change set (op, key, new values of all columns), or raise RuleViolation. updated_at is set where there is one."""
        current, spec = self.read(table), TABLES[table]
        if "updated_at" in current.columns:
            changes = changes.withColumn("updated_at", now)
        guarded = history.guard(changes, current, table)
        refused = [r.rule for r in guarded.where("rule IS NOT NULL").select("rule").distinct().orderBy("rule").collect()]
        after = history.apply_changes(current, guarded, spec.primary_key)
        broken = rules.violations(after, table).select(F.explode("violations").alias("v")).distinct().orderBy("v").collect()
        keys = [name for name, key, where in spec.unique_keys if not rules.duplicate_keys(after, key, where).isEmpty()]
        gone = guarded.where("op = 'DELETE'")
        held = [n for other in TABLES.values() for n, column, parent, key in other.foreign_keys if parent == table and not rules.blocked_deletes(gone, key, self.read(other.name), column).isEmpty()]
        names = refused + [r.v for r in broken] + keys + held
        if names:
            raise RuleViolation(table, names)
        self._stage(table, after, replace=True)
