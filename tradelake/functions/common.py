"""Column helpers for exact arithmetic and JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def price(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(24,10)")


def money(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(20,4)")


def volume(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(16,4)")


def ratio(over: Column, under: Column) -> Column:
    """A quotient in double precision, null where the divisor is zero or null."""
    return F.try_divide(over.cast("double"), under.cast("double"))


def weighted_price(amount: Column, weight: Column) -> Column:
    """Volume-weighted mean as decimal(38,16): both sums are narrowed first, or the quotient keeps only 7 decimals."""
    return F.try_divide(F.sum(amount).cast("decimal(28,10)"), F.sum(weight).cast("decimal(20,4)"))


def canonical_json(col: Column) -> Column:
    """JSON with sorted keys; null where the text is no JSON."""
    return F.to_json(F.try_parse_json(col))


def json_hash(col: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical_json(col), 256)


def null_reasons(reasons: Mapping[str, Column]) -> Column:
    """A JSON object of the given reasons, without those that are null: {"feature": "reason", ...}."""
    entries = F.array(*[F.when(r.isNotNull(), F.struct(F.lit(n).alias("key"), r.alias("value"))) for n, r in reasons.items()])
    return F.to_json(F.map_from_entries(F.array_compact(entries)))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation with an error below 7.5e-8."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    # The published coefficients of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / F.lit((2 * 3.141592653589793) ** 0.5) * poly
    return F.when(z >= 0, F.lit(1.0) - tail).otherwise(tail)
