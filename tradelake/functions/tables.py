"""Tables written in the shared folder, which cut lineage and are computed once."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Where it is unset, each application gets one temporary folder, in local mode only: on a cluster a machine-local folder
    would not be seen by the other machines. The setting itself cannot be changed in a running session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    with _LOCK:
        own = spark.sparkContext.applicationId
        if own not in _LOCAL:
            _LOCAL[own] = tempfile.mkdtemp(prefix="tradelake-")
        return _LOCAL[own]


#: Temporary folders by application.
_LOCAL: dict[str, str] = {}
_LOCK = threading.Lock()


#: Paths of the tables written in each open scope of this thread, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def write_table(df: DataFrame, keep: bool = False) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder; a scan of it, which cuts its lineage, and its path.

    Within scratch(), the table goes at its end, or with keep at the end of the scope around it. Others stay under
    <spark.checkpoint.dir>/tables/<application id>, as results may still read them lazily, until drop_materialized().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _SCOPES.get()
    inner = len(scopes) - 1 - keep
    if inner >= 0:
        scopes[inner].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """The scan of write_table()."""
    return write_table(df, keep)[0]


def delete_table(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that materialize() writes within, but those to keep. What leaves the block must not read the others.

    Scopes belong to the thread (or context) that opened them: queries that run at once in threads keep their tables apart.
    """
    before, own = _SCOPES.get(), list[str]()
    _SCOPES.set((*before, own))
    try:
        yield
    finally:
        _SCOPES.set(before)
        for path in own:
            delete_table(spark, path)


def drop_materialized(spark: SparkSession) -> None:
    """Delete all tables that materialize() has written, and what streams have left, in this application."""
    for kind in ("tables", "streams"):
        delete_table(spark, f"{shared_dir(spark)}/{kind}/{spark.sparkContext.applicationId}")


def stream_folder(spark: SparkSession) -> str:
    """A new folder for a stream's checkpoint and tables, which drop_materialized() deletes."""
    return f"{shared_dir(spark)}/streams/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
