"""Windows over long ordered series, in pieces, so that no task holds a whole series.

Rows of a series are numbered through time pieces: a rank within a piece, plus the rows of the pieces before it. Pieces of
PIECE_ROWS numbers are then windows of their own. A frame that looks some rows back or ahead gets these rows copied into the
neighbouring piece; a frame that looks back to the start gets one row from each piece before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Length in time of the pieces that are ranked, and rows in a piece of the windows.
PIECE_SECONDS = 7 * 86_400
PIECE_ROWS = 4096


def numbered(df: DataFrame, keys: Sequence[str] = ("symbol",), time: str = "bar_time", then: Sequence[str] = ()) -> DataFrame:
    """df with _n, the place of each row in its series from 0 on, by time and then further columns, which must be total. A df that
    has _n already is returned as it is. Rows with a null in the keys are a series too; rows without a time come first."""
    if "_n" in df.columns:
        return df
    cut = df.withColumn("_t", F.floor(F.unix_timestamp(time) / PIECE_SECONDS))
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_t").orderBy(time, *then)).cast("long") - 1)
    sizes = ranked.groupBy(*keys, "_t").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, "_t", F.coalesce(before, F.lit(0)).alias("_start"))
    return _with(ranked, starts, [*keys, "_t"]).withColumn("_n", F.col("_start") + F.col("_rank")).select(*df.columns, "_n")


def _with(rows: DataFrame, pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the further columns of their piece; null keys are keys like others."""
    named = pieces.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(named[f"_of_{k}"])
    return rows.join(named, same).drop(*[f"_of_{k}" for k in keys])


def over_pieces(rows: DataFrame, columns: Mapping[str, Callable[[WindowSpec], Column]], back: int = 0, ahead: int = 0, keys: Sequence[str] = ("symbol",), piece_rows: int | None = None) -> DataFrame:
    """numbered() rows with further columns over a series in order; each may look `back` rows back and `ahead` rows ahead."""
    size = piece_rows or max(PIECE_ROWS, 4 * (back + ahead))
    own, inside = F.floor(F.col("_n") / size), F.col("_n") % size
    places = [F.struct(own.alias("p"), F.lit(True).alias("own"))]
    if back:  # the last rows of a piece are known to the next one
        places.append(F.when(inside >= size - back, F.struct((own + 1).alias("p"), F.lit(False).alias("own"))))
    if ahead:
        places.append(F.when((inside < ahead) & (own > 0), F.struct((own - 1).alias("p"), F.lit(False).alias("own"))))
    dealt = rows.withColumn("_at", F.explode(F.array_compact(F.array(*places)))).withColumn("_p", F.col("_at.p"))
    w = Window.partitionBy(*keys, "_p").orderBy("_n")
    return dealt.withColumns({n: f(w) for n, f in columns.items()}).where("_at.own").drop("_at", "_p")


def last_known(rows: DataFrame, values: Mapping[str, Column], inclusive: bool = True, keys: Sequence[str] = ("symbol",), piece_rows: int | None = None) -> DataFrame:
    """numbered() rows with, for each value, the last one that is not null up to each row, or before it (not inclusive)."""
    size = piece_rows or PIECE_ROWS
    cut = rows.withColumn("_p", F.floor(F.col("_n") / size)).withColumns({f"_v_{n}": v for n, v in values.items()})
    ends = cut.groupBy(*keys, "_p").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_n"))).alias(f"_c_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_p", *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in values])
    near = Window.partitionBy(*keys, "_p").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = cut.withColumns({f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(near) for n in values})
    local = _with(local, carried, [*keys, "_p"])
    return local.select(*rows.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values])


def running_sum(rows: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = ("symbol",), piece_rows: int | None = None) -> DataFrame:
    """numbered() rows with the sum of each value up to and with each row."""
    return _running(rows, values, keys, piece_rows, F.sum, lambda local, before: local + F.coalesce(before, F.lit(0)))


def running_max(rows: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = ("symbol",), piece_rows: int | None = None) -> DataFrame:
    """numbered() rows with the largest of each value up to and with each row."""
    return _running(rows, values, keys, piece_rows, F.max, F.greatest)


def _running(rows: DataFrame, values: Mapping[str, Column], keys: Sequence[str], piece_rows: int | None, fold: Callable[[str], Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    """A running fold: within the pieces, joined with that of the pieces before, of which there is one row each."""
    size = piece_rows or PIECE_ROWS
    cut = rows.withColumn("_p", F.floor(F.col("_n") / size)).withColumns({f"_v_{n}": v for n, v in values.items()})
    sums = cut.groupBy(*keys, "_p").agg(*[fold(f"_v_{n}").alias(f"_c_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_p", *[fold(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in values])
    near = Window.partitionBy(*keys, "_p").orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({f"_l_{n}": fold(f"_v_{n}").over(near) for n in values})
    local = _with(local, carried, [*keys, "_p"])
    return local.select(*rows.columns, *[join(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in values])
