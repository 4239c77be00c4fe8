"""Snapshots of tables: written beside, checked, then put in place; read back into views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelake.plans.schemas import TABLES, schema_diff


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _digest(df: DataFrame) -> tuple[int, int]:
    """The number of rows and a sum of their hashes, whatever their order."""
    columns = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row.n, int(row.h)


def backup(spark: SparkSession, tables: Mapping[str, DataFrame], path: str) -> dict[str, int]:
    """Write each table under path.partial, read it again and compare its rows by number and content, then rename. Returns the
    counts."""
    fs, partial = _fs(spark, path + ".partial")
    fs.delete(partial, True)
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}.partial/{name}")
        found, sent = (_digest(x) for x in (spark.read.schema(df.schema).parquet(f"{path}.partial/{name}"), df))
        if found != sent:
            raise ValueError(f"{name}: {found[0]} rows were read back, {sent[0]} were sent, or they differ")
        counts[name] = found[0]
    _, final = _fs(spark, path)
    if not fs.rename(partial, final):
        raise OSError(f"cannot rename to {path}")
    return counts


def restore(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Register the tables of a snapshot as views; their names."""
    fs, top = _fs(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(top))
    for name in names:
        spark.read.parquet(f"{path}/{name}").createOrReplaceTempView(prefix + name)
    return names


def expired(spark: SparkSession, folder: str, keep_days: int = 14, now_ms: int | None = None) -> list[str]:
    """Snapshots under folder that are older than so many days."""
    import time

    fs, top = _fs(spark, folder)
    limit = (now_ms if now_ms is not None else int(time.time() * 1000)) - keep_days * 86_400_000
    return sorted(s.getPath().getName() for s in fs.listStatus(top) if s.getModificationTime() < limit)


def expire(spark: SparkSession, folder: str, keep_days: int = 14, now_ms: int | None = None) -> list[str]:
    """Delete the snapshots under folder that are older than so many days; their names."""
    names = expired(spark, folder, keep_days, now_ms)
    for name in names:
        fs, path = _fs(spark, f"{folder}/{name}")
        fs.delete(path, True)
    return names


def create_tables(spark: SparkSession, database: str) -> int:
    """Create all tables, empty, in a database; how many it then has."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for t in TABLES.values():
        spark.createDataFrame([], t.schema).write.mode("ignore").saveAsTable(f"{database}.{t.name}")
    return len(spark.catalog.listTables(database))


def drop_tables(spark: SparkSession, database: str) -> int:
    for t in reversed(list(TABLES)):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{t}")
    return len(spark.catalog.listTables(database))


def drift(spark: SparkSession, database: str) -> dict[str, list[str]]:
    """Tables whose stored schema differs from the registry, and how; tables too many or missing."""
    found = {t.name for t in spark.catalog.listTables(database)}
    out = {n: ["missing"] for n in TABLES if n not in found} | {n: ["unexpected"] for n in found if n not in TABLES}
    for name, t in TABLES.items():
        if name in found and (diff := schema_diff(t.schema, spark.table(f"{database}.{name}").schema)):
            out[name] = diff
    return out
