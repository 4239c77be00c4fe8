"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target, and a document is emitted floor(rate) times, rate being target
over source size, plus once more with a probability equal to the rate's fraction. That draw is a hash of the document's id
and a seed, so reruns agree. Sources are counted on the map side; their table (one row per source) is broadcast only if it takes at
most BROADCAST_BYTES, which holds some million sources, else joined by shuffle, where AQE splits a hot source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelake.llm.common import WORD, materialize, text_of

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 17
#: Bytes of the table of sources that is broadcast: the names, and ROW_BYTES for the rest of a row.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 48


def n_words(col: str) -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """sizes (source, size), a row per document -> a row per source: source, source_size, weight, target.

    Sources in code-point order, null last, take the weights in turn; all of them together share the sum of all sizes. A
    target stops at most times its source's size and the excess is shared again by weight. A source without words has
    target 0.
    """
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    parts = summed.repartitionByRange(8, order).withColumn("part", F.spark_partition_id())
    parts = materialize(parts)
    # ranks without a single-task sort: the rank in the range, plus the rows of the ranges before (as many as partitions)
    before, counts = 0, []
    for part, n in sorted(map(tuple, parts.groupBy("part").count().collect())):
        counts.append((part, before))
        before += n
    offsets = spark.createDataFrame(counts, "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(order)) + F.col("before") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1)
    ranked = materialize(parts.join(F.broadcast(offsets), "part").select("source", "source_size", weight.cast("long").alias("weight")))
    # Raise the words a unit of weight gets until no further source is above its cap. A row of sums reaches the driver.
    unit = capped = None
    while True:
        at_cap = F.lit(False) if unit is None else F.col("weight") * F.lit(unit) > F.col("source_size") * most
        row = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(at_cap, F.col("source_size") * most)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0)).alias("weights"),
            F.coalesce(F.sum(F.when(at_cap, 1)), F.lit(0)).alias("capped"),
        ).first()
        if row.capped == capped or not row.weights:
            break
        unit, capped = (row.total - row.held) / row.weights, row.capped
    target = F.least(F.col("weight") * F.lit(float(unit or 0)), (F.col("source_size") * most).cast("double"))
    return ranked.withColumn("target", target)


def draw(id_: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on id and seed only."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """A row per document: id_col, size, source_size, target, copies; then the columns of docs named in keep.

    Null texts and texts without words have size 0. A null source is a source of its own. Rows that repeat an id get the
    same draw. An empty table gives no rows. Other columns of docs do not matter.
    """
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"), *kept)
    targets = source_targets(rows.select("source", "size")).select(F.col("source").alias("_source"), "source_size", "target")
    held = targets.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("_source"), F.lit(0)) + ROW_BYTES), F.lit(0))).first()[0]
    few = held <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.coalesce(F.try_divide("target", F.col("source_size")), F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select(F.col("_id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """docs with each row emitted as many times as mixing_plan() says, with the columns of docs."""
    whole = docs.select(id_col, F.struct("*").alias("_row"), source_col, text_col)
    plan = mixing_plan(whole, id_col, source_col, text_col, seed, keep=["_row"])
    emitted = plan.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return emitted.select("_row.*")
