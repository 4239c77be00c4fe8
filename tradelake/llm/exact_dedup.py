"""Exact deduplication by progressive refinement, in DataFrame operations only.

Texts are equal when they are identical after deleting ASCII white space. Three rounds narrow the rows down: by length of
the normalised text, then by a hash of its first characters, then by a SHA-256 of all of it. The first scan writes each row's
length and prefix hash; the first two rounds work on that table alone. Prefixes that repeat reach the second scan as a bitmap
whose size follows their number up to a bound (common.py), so what is broadcast has a proven bound; a bit set by another prefix only lets a
row through to the full hash. Text is never shuffled: only ids, lengths and digests are, and copies are counted on the map side
before that, so a group with a third of all rows costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelake.llm.common import SPACE, marked, materialize, row_hash, text_of, without_rows, without_space

PREFIX_CHARS = 64


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key")


def _grouped(docs: DataFrame, id_col: str, text_col: str, carry: Mapping[str, Column]) -> DataFrame:
    """One row per input row: _id, _hash (of the text as it is), _keep (the row that stays: id and hash), _n, _kept, and carry."""
    text = text_of(text_col)
    source = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), row_hash(F.col(text_col)).alias("_hash"), *[c.alias(f"_c{i}") for i, c in enumerate(carry.values())])
    norm = without_space(F.col("_text"))
    # the first PREFIX_CHARS visible characters, without normalising the rest
    start = F.regexp_replace(F.regexp_extract("_text", rf"^(?:{SPACE}*[^\x20\x09-\x0D]){{0,{PREFIX_CHARS}}}", 0), SPACE, "")
    # White space is no more than what is left out of the whole text, so the lengths are those of the normalised texts.
    length = F.length("_text") - F.regexp_count("_text", F.lit(SPACE))
    sized = source.withColumn("_len", length.cast("long")).withColumn("_prefix", F.xxhash64("_len", start))

    # rounds 1 and 2, on lengths and prefix hashes: only rows of a repeated length are grouped by prefix
    keys = materialize(sized.select("_len", "_prefix"))
    repeated = materialize(_repeated(keys.join(_repeated(keys, "_len").withColumnRenamed("key", "_len"), "_len", "left_semi"), "_prefix"))

    # round 3
    third = marked(source.withColumn("_prefix", F.xxhash64(length.cast("long"), start)), "_prefix", repeated, "_open").select(
        "_id",
        "_hash",
        F.length("_text").alias("_points"),
        F.when(F.col("_open"), F.sha2(norm, 256)).alias("_sha"),
        *[f"_c{i}" for i in range(len(carry))],
    )
    best = F.min(F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("z"), F.col("_id").alias("id"), F.col("_hash").alias("h")))
    groups = third.where(F.col("_sha").isNotNull()).groupBy("_sha").agg(F.count("*").alias("_n"), best.alias("_best")).where("_n > 1")
    # Joined by the digest alone, the groups are dealt out anew, so that AQE can split the rows of a large group.
    groups = groups.select(F.col("_sha").alias("_key"), "_n", F.struct("_best.id", "_best.h").alias("_keep"))
    rows = third.withColumn("_key", F.coalesce("_sha", F.concat(F.lit("id "), F.col("_id").cast("string")), F.lit("id")))
    own = F.struct(F.col("_id").alias("id"), F.col("_hash").alias("h"))
    out = rows.join(groups, "_key", "left").withColumn("_keep", F.coalesce("_keep", own)).withColumn("_n", F.coalesce("_n", F.lit(1)).cast("long"))
    return out.withColumn("_kept", F.col("_keep").eqNullSafe(own))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per input row: id_col, keep_id (the id of the row of its group that stays), group_size, kept, and carry.

    The row with the most code points in the original text stays, then that with the smallest id; null ids come last.
    carry: further result columns by name, as expressions over docs, evaluated in the last scan.

    Null texts count as empty, and all texts without a visible character are one group. Rows that repeat an id with
    different texts are told apart by the text. Rows that repeat both id and text cannot be told apart: each is returned,
    counted, and kept if one of them is (exact_dedup() leaves one of them). An empty table gives no rows. Other columns of
    docs are ignored, whatever their names.
    """
    carry = dict(carry or {})
    out = _grouped(docs, id_col, text_col, carry)
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep.id").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_kept").alias("kept"),
        *[F.col(f"_c{i}").alias(n) for i, n in enumerate(carry)],
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, as exact_groups() chooses it, with the columns of docs.

    Of rows that repeat both id and text, one stays, whichever it is. A row with a null id is deduplicated like any other. A
    table without rows gives none; other columns may have any names.
    """
    found = materialize(_grouped(docs, id_col, text_col, {}).where("_n > 1").select("_id", "_hash", "_kept"))
    again = found.where("_kept").groupBy("_id", "_hash").agg(F.count("*").alias("n")).where("n > 1")
    return without_rows(docs, id_col, [text_col], found.where("not _kept").select("_id", "_hash"), again.select("_id", "_hash"))
