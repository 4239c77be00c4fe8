"""Tables of a relational database, read in parallel by ranges of a key and appended to.

Spark's own JDBC source does the work; here are the choices that keep it parallel and small: bounds of the key from the
database, a range for each task, filters and columns pushed down, and appends from few connections.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a range, ranges at most (each is a connection while it is read), and rows fetched or written at a time.
RANGE_ROWS, MOST_RANGES, AT_ONCE = 200_000, 64, 10_000


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, where: str | None = None, columns: Sequence[str] | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table as a DataFrame. Filters and columns that are applied to it, and where and columns given here, are evaluated by the
    database. With an integer, date or timestamp key, ranges of it are read side by side; rows without a key are in the first.

    The key's least and largest value and the number of rows reach the driver, from one query to the database.
    """
    reader = spark.read.format("jdbc").options(**{"url": url, "fetchsize": str(AT_ONCE)}, **(options or {}))
    if key is not None:
        of = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)  # as the database spells names
        asked = f"(SELECT MIN({of}) AS lowest, MAX({of}) AS highest, COUNT(*) AS n_rows FROM {table}) bounds"
        low, high, n = reader.option("dbtable", asked).load().select(F.col("lowest").cast("string"), F.col("highest").cast("string"), "n_rows").first()
        if low is not None:
            ranges = min(MOST_RANGES, 1 + n // RANGE_ROWS)
            reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=str(ranges))
    df = reader.option("dbtable", table).load()
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns is not None else df


def append(df: DataFrame, url: str, table: str, connections: int = 8, options: Mapping[str, str] | None = None) -> None:
    """Append rows, in batches and by so many connections at most; the table is made if it is not there. A task that is run again
    writes its rows again, unless the table's own keys refuse them, so let the table have its primary key and unique keys."""
    # rebalancing is by hash; fewer partitions are no shuffle
    df.coalesce(connections).write.format("jdbc").options(**{"url": url, "dbtable": table, "batchsize": str(AT_ONCE)}, **(options or {})).mode("append").save()
