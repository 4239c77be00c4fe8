"""As-of and nearest joins: a union and a window within pieces of time; no inequality join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length in time of the pieces that are ordered apart from each other.
PIECE_SECONDS = 86_400


def _piece(df: DataFrame, time: str, seconds: int) -> Column:
    """The piece of a time, which is a timestamp or a number."""
    number = F.unix_timestamp(time) if df.schema[time].dataType.typeName() == "timestamp" else F.col(time)
    return F.floor(number / seconds)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, prefix: str = "r_", strict: bool = True, forward: bool = False, piece_seconds: int = PIECE_SECONDS) -> DataFrame:
    """Each left row with the last right row before it (strict) or not after it, or with the first one behind it.

    Right columns other than keys get the prefix; they are null where there is no such row. If right has several rows of
    a key at one time, which of them is taken is arbitrary. A right row's values travel in one struct, so a null in it
    does not let an older row through. A task orders one piece of a key's time; what a piece hands on is one row.
    """
    values = [c for c in right.columns if c not in keys]
    row, side = right.select(F.struct(*values)).schema[0].dataType, left.select(F.struct("*")).schema[0].dataType
    a = left.select(*keys, _piece(left, left_time, piece_seconds).alias("_p"), F.col(left_time).alias("_t"), F.struct("*").alias("_l"), F.lit(None).cast(row).alias("_r"))
    b = right.select(*keys, _piece(right, right_time, piece_seconds).alias("_p"), F.col(right_time).alias("_t"), F.lit(None).cast(side).alias("_l"), F.struct(*values).alias("_r"))
    every = a.unionByName(b)
    # Looking ahead is looking back in descending order: a frame up to its partition's end would be read anew for each row.
    turned = (lambda c: F.col(c).desc()) if forward else F.col
    # At equal times a left row comes first for a strict look, else last.
    is_right = F.col("_r").isNotNull().cast("int")
    order = Window.partitionBy(*keys, "_p").orderBy(turned("_t"), is_right if strict else -is_right)
    found = F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    handed = every.groupBy(*keys, "_p").agg((F.min_by if forward else F.max_by)("_r", F.when(is_right == 1, F.col("_t"))).alias("_h"))
    carried = F.last("_h", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(turned("_p")).rowsBetween(Window.unboundedPreceding, -1))
    carry = handed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_p"])], carried.alias("_c"))
    out = every.withColumn("_f", found).where("_l IS NOT NULL")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_p"])]
    out = out.join(carry, same, "left").withColumn("_f", F.coalesce("_f", "_c"))
    return out.select("_l.*", *[F.col(f"_f.{c}").alias(prefix + c) for c in values])


def nearest(left: DataFrame, left_time: str, right: DataFrame, right_time: str, seconds: int, keys: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """left with seconds_off, the signed distance to the nearest right time of the same keys within so many seconds, the earlier
    one of two alike, and that row's values (the least of several at one time); null without one, and for a null key or time.

    Right rows are folded by the second first. A piece of time has copies of those that lie up to `seconds` beside it, and finds the last
    one before and the first one behind each row, so the cost grows with the rows and not with the pairs that are near."""
    size = 4 * seconds
    at = F.unix_timestamp(right_time)
    known = right.dropna(subset=[*keys, right_time]).groupBy(*keys, at.alias("_s")).agg(F.min(F.struct(at.alias("at"), *values)).alias("_r"))
    row, side = known.schema["_r"].dataType, left.select(F.struct("*")).schema[0].dataType
    second = F.unix_timestamp(left_time)
    a = left.select(*keys, F.floor(second / size).alias("_p"), second.alias("_s"), F.struct("*").alias("_l"), F.lit(None).cast(row).alias("_r"))
    places = F.explode(F.sequence(F.floor((F.col("_s") - seconds) / size), F.floor((F.col("_s") + seconds) / size)))
    b = known.select(*keys, places.alias("_p"), "_s", F.lit(None).cast(side).alias("_l"), "_r")
    piece = Window.partitionBy(*keys, "_p")

    def last(*order: Column) -> Column:
        return F.last("_r", ignorenulls=True).over(piece.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))

    met = a.unionByName(b).withColumns({"_before": last(F.col("_s"), F.col("_r").isNull()), "_behind": last(F.col("_s").desc())}).where("_l IS NOT NULL")
    off = {c: F.col(f"{c}.at") - F.col("_s") for c in ("_before", "_behind")}
    met = met.withColumn("_m", F.when(off["_behind"].isNull() | (-off["_before"] <= off["_behind"]), F.col("_before")).otherwise(F.col("_behind")))
    met = met.withColumn("_m", F.when(F.abs(F.col("_m.at") - F.col("_s")) <= seconds, F.col("_m")))
    return met.select("_l.*", (F.col("_m.at") - F.col("_s")).alias("seconds_off"), *[F.col(f"_m.{v}").alias(v) for v in values])
