"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelake.functions.tables import drop_materialized, materialize, scratch, shared_dir

__all__ = ["drop_materialized", "materialize", "scratch", "shared_dir"]

#: ASCII white space that separates words, as a Java and DuckDB regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: Bits of a broadcast bitmap: LEAST_BITS for each key, as a power of two from 2 ** 18 to 2 ** 30 (128 MB). Up to some 1e8 keys,
#: one row in eight or fewer is let through without a key of its own; beyond that, more are.
LEAST_BITS = 8
FEWEST_BITS, MOST_BITS = 18, 30


def bitmap_bits(n_keys: int) -> int:
    return min(MOST_BITS, max(FEWEST_BITS, (LEAST_BITS * n_keys - 1).bit_length()))


def marked(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """rows with a flag that is true for each row whose key (a long) is among the written keys (key), and for few others.

    The keys travel as a bitmap, rows of 4 KB whose number has a proven bound; keys that share a bit are not told apart.
    """
    bits = bitmap_bits(keys.count())

    def slot(of: Column) -> Column:
        return F.pmod(of, F.lit(1 << bits)) + 1

    place = slot(F.col("key"))
    bitmap = keys.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    at = F.bitmap_bit_position(slot(F.col(key)))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = (F.floor(byte / F.pow(F.lit(2.0), at % 8)) % 2) == 1
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(slot(F.col(key)))).join(F.broadcast(bitmap), "_bucket", "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_bucket", "_bits")


#: Row keys that without_rows() broadcasts at most, some 40 MB as a hash table.
BROADCAST_KEYS = 500_000


def row_hash(*columns: Column) -> Column:
    """A hash of the columns a decision was made on, nulls included; with the id it tells rows apart."""
    return F.xxhash64(*[x for c in columns for x in (c.isNull(), c.cast("string"))])


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores behind it that docs has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_rows(docs: DataFrame, id_col: str, decided: Sequence[str], gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose id and row_hash() of the columns decided are in gone; of rows with a key in once, one stays.

    gone and once have two columns, id and hash. Null ids are compared like any other value, so rows are told apart by id
    and content, never by id alone. Keys are written and counted first: few are broadcast, so that texts need no shuffle;
    many are joined by shuffle. Only the rows of once, which repeat a key, are shuffled to leave one of each.
    """
    id_name, hash_name, mark = fresh(docs, "_gone_id", "_gone_hash", "_row_hash")

    def keys(table: DataFrame) -> DataFrame:
        written = materialize(table.toDF(id_name, hash_name).distinct())
        return F.broadcast(written) if written.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else written

    marked = docs.withColumn(mark, row_hash(*[docs[c] for c in decided]))
    same = marked[id_col].eqNullSafe(F.col(id_name)) & (F.col(mark) == F.col(hash_name))
    left = marked.join(keys(gone), same, "left_anti")
    if once is not None and not (once := materialize(once)).isEmpty():
        repeats = keys(once)
        left = left.join(repeats, same, "left_anti").unionByName(left.join(repeats, same, "left_semi").dropDuplicates([id_col, mark]))
    return left.select([F.col(f"`{c}`") for c in docs.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a Python worker holds as strings at once.
AT_ONCE = 1 << 20


def small_batches(batches: Iterator[pa.RecordBatch], column: int, at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about at_once bytes in a string or binary column; a longer value is a slice of its own."""
    for batch in batches:
        values = batch.column(column)
        if not len(batch):
            continue
        ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(batch) + 1]
        begin = 0
        while begin < len(batch):
            stop = max(begin + 1, int(np.searchsorted(ends, int(ends[begin]) + at_once, "right")) - 1)
            yield batch.slice(begin, stop - begin)
            begin = stop


#: Bytes of an Arrow batch of texts, where the session states none. By rows alone, 10,000 texts would be tens or hundreds of MB.
BATCH_BYTES = 4 << 20
MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_texts(rows: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """rows.mapInArrow(each, schema) in batches of bounded bytes; the bound stays set in the session, as plans are made later."""
    spark = rows.sparkSession
    if spark.conf.get(MOST_BYTES, None) is None:
        spark.conf.set(MOST_BYTES, str(BATCH_BYTES))
    return rows.mapInArrow(each, schema)


def text_of(col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def without_space(text: Column) -> Column:
    """The text without its ASCII white space."""
    return F.regexp_replace(text, SPACE, "")
