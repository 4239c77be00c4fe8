"""Hypotheses over frozen periods: conditions, segments, statistics, intervals and multiple tests.

Outcomes enter as exact decimals; sums stay decimal and quotients are double.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelake.functions.common import normal_cdf, ratio
from tradelake.functions.distributions import binomial_at_least, student_two_sided

Z95 = 1.959963984540054

_OPERATORS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def condition(spec: Mapping[str, Any], fields: Sequence[str]) -> Column:
    """A filter from {"field", "op", "value"} leaves under {"and": [...]}, {"or": [...]} and {"not": ...}.

    Only listed fields and known operators are allowed; values become literals, never SQL text.
    """
    if "and" in spec or "or" in spec:
        (word,) = spec
        parts = [condition(s, fields) for s in spec[word]]
        out = F.lit(word == "and")
        for p in parts:
            out = out & p if word == "and" else out | p
        return out
    if "not" in spec:
        return ~condition(spec["not"], fields)
    if spec["field"] not in fields:
        raise ValueError(f"field {spec['field']!r} is not allowed")
    col, value = F.col(spec["field"]), spec.get("value")
    if spec["op"] == "in":
        return col.isin(*value)
    if spec["op"] == "between":
        return col.between(*value)
    if spec["op"] == "is null":
        return col.isNull()
    if spec["op"] not in _OPERATORS:
        raise ValueError(f"operator {spec['op']!r} is not allowed")
    return _OPERATORS[spec["op"]](col, F.lit(value))


def scope(spec: Mapping[str, Any], fields: Sequence[str]) -> Column:
    """Equality on the given keys; a missing key restricts nothing."""
    return condition({"and": [{"field": k, "op": "=", "value": v} for k, v in spec.items()]}, fields)


def segment(at: Column, train_end: Column, validation_end: Column, oos_end: Column) -> Column:
    return F.when(at <= train_end, "TRAIN").when(at <= validation_end, "VALIDATION").when(at <= oos_end, "OOS").when(at.isNotNull(), "FORWARD")


def statistics(rows: DataFrame, keys: Sequence[str], net: str = "net_profit") -> DataFrame:
    """Per key: n, wins, win_rate, expectancy, profit_factor (null without losses), sums for the intervals."""
    x = F.col(net)
    out = rows.groupBy(*keys).agg(
        F.count(x).alias("n"),
        F.sum((x > 0).cast("long")).alias("wins"),
        F.sum(x).alias("total"),
        F.sum(F.when(x > 0, x)).alias("won"),
        F.sum(F.when(x < 0, -x)).alias("lost"),
        F.sum((x * x).cast("decimal(38,8)")).alias("squares"),
    )
    return derived(out)


def derived(sums: DataFrame) -> DataFrame:
    n = F.col("n")
    return sums.withColumns({"win_rate": ratio(F.col("wins"), n), "expectancy": ratio(F.col("total"), n), "profit_factor": ratio(F.coalesce("won", F.lit(0)), F.col("lost"))})


def variance() -> Column:
    """Sample variance from n, total and squares; null below two rows."""
    n, total = F.col("n").cast("double"), F.col("total").cast("double")
    return F.when(F.col("n") > 1, (F.col("squares").cast("double") - total * total / n) / (n - 1))


def wilson(wins: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a share; null for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = wins.cast("double") / n
    middle = p + z * z / (2 * n)
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


def mean_interval(mean: Column, var: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Normal interval of a mean; null below two rows."""
    half = z * F.sqrt(var / n.cast("double"))
    return mean - half, mean + half


def z_statistic(mean: Column, var: Column, n: Column) -> Column:
    return F.try_divide(mean, F.sqrt(var / n.cast("double")))


def p_value(z: Column) -> Column:
    """Two-sided."""
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))


#: Replicates of the bootstrap, its seed, and hexadecimal digits of a draw; eight draws come from one digest.
REPLICATES, SEED, DIGITS = 200, 5, 4
#: The Poisson distribution of mean 1 at 0, 1, 2 and so on, in 65536ths; a draw below the i-th is at most i.
POISSON = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)


def bootstrap(rows: DataFrame, keys: Sequence[str], id_: str, net: str = "net_profit", replicates: int = REPLICATES, seed: int = SEED, level: float = 0.95) -> DataFrame:
    """Percentile intervals of expectancy and profit factor by the Poisson bootstrap: keys, n, expectancy_low, expectancy_high,
    factor_low, factor_high.

    In each replicate a row counts as often as a draw says that depends on its id, the seed and the replicate only, so reruns
    and other partitions agree. Rows meet their replicates within a task and are summed there before the shuffle, which gets a row
    for each key and replicate of a task. Replicates without a row, or for the factor without a loss, do not count; a null
    result is no row. Rows that repeat an id get the same draws.
    """
    blocks = -(-replicates // 8)
    x = F.col(net)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string"), F.col("_block").cast("string")))
    drawn = rows.where(x.isNotNull()).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_digest", digest)
    draw = F.conv(F.substring("_digest", F.lit(1) + F.col("_i") * DIGITS, F.lit(DIGITS)), 16, 10).cast("int")
    each = drawn.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("_draw", draw)
    weight = sum((F.when(F.col("_draw") >= bound, 1).otherwise(0) for bound in POISSON), F.lit(0))
    each = each.select(*keys, (F.col("_block") * 8 + F.col("_i")).alias("_replicate"), weight.cast("decimal(4,0)").alias("_w"), x.alias("_x")).where(F.col("_replicate") < replicates)
    sums = each.groupBy(*keys, "_replicate").agg(
        F.count("*").alias("n"), F.sum("_w").alias("rows"), F.sum(F.col("_w") * F.col("_x")).alias("total"),
        F.sum(F.when(F.col("_x") > 0, F.col("_w") * F.col("_x"))).alias("won"), F.sum(F.when(F.col("_x") < 0, -F.col("_w") * F.col("_x"))).alias("lost"),
    )
    found = sums.select(*keys, "n", ratio(F.col("total"), F.nullif("rows", F.lit(0))).alias("e"), ratio(F.coalesce("won", F.lit(0)), F.nullif("lost", F.lit(0))).alias("f"))
    listed = found.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list("e")).alias("e"), F.array_sort(F.collect_list("f")).alias("f"))

    def at(values: str, share: float) -> Column:
        size = F.array_size(values)
        return F.get(values, F.greatest(F.ceil(size * F.lit(share) - 1e-9).cast("int") - 1, F.lit(0)))

    low, high = (1 - level) / 2, (1 + level) / 2
    return listed.select(*keys, "n", at("e", low).alias("expectancy_low"), at("e", high).alias("expectancy_high"), at("f", low).alias("factor_low"), at("f", high).alias("factor_high"))


#: Rows from which a test of a mean takes the normal distribution; a test of a share is exact up to EXACT_TRIALS trials.
NORMAL_FROM, EXACT_TRIALS = 200, 1_000_000


def mean_test(mean: Column, var: Column, n: Column) -> tuple[Column, Column]:
    """The two-sided p-value of a mean against 0, and the method: student_t below NORMAL_FROM rows, normal from there on, null with
    fewer than two rows or without variance."""
    t = z_statistic(mean, var, n)
    small = n < NORMAL_FROM
    p = F.when(small, student_two_sided(t, n - 1)).otherwise(p_value(t))
    return F.when(t.isNotNull(), p), F.when(t.isNotNull(), F.when(small, "student_t").otherwise("normal"))


def share_test(hits: Column, n: Column, share: Column) -> tuple[Column, Column]:
    """The two-sided p-value of hits in n trials against a share, and the method: twice the smaller tail of the binomial, at most 1, as
    exact_binomial; beyond EXACT_TRIALS normal; null without trials."""
    at_least, at_most = binomial_at_least(hits, n, share), F.lit(1.0) - binomial_at_least(hits + 1, n, share)
    exact = F.least(F.lit(1.0), F.lit(2.0) * F.least(at_least, at_most))
    z = F.try_divide(hits - n * share, F.sqrt(n * share * (F.lit(1.0) - share)))
    small = n <= EXACT_TRIALS
    return F.when(n > 0, F.when(small, exact).otherwise(p_value(z))), F.when(n > 0, F.when(small, "exact_binomial").otherwise("normal"))


def bonferroni(p: Column, tests: Column) -> Column:
    return F.least(F.lit(1.0), p * tests)


def holm(tests: DataFrame, family: Sequence[str], p: str, id_: str) -> DataFrame:
    """tests with p_holm: sorted by p, p times the tests not yet decided, never below an earlier one. A family is the
    tests of one hypothesis, so its window is small."""
    w = Window.partitionBy(*family)
    order = w.orderBy(p, id_)
    stepped = tests.withColumn("_s", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(w) - F.row_number().over(order) + 1)))
    return stepped.withColumn("p_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def compare_versions(rows: DataFrame, net: str = "net_profit") -> DataFrame:
    """Statistics by bot and version, by bot, and over all, retired bots included."""
    x = F.col(net)
    out = rows.rollup("bot_id", "version").agg(F.count(x).alias("n"), F.sum((x > 0).cast("long")).alias("wins"), F.sum(x).alias("total"), F.sum(F.when(x > 0, x)).alias("won"), F.sum(F.when(x < 0, -x)).alias("lost"), F.grouping_id().alias("level"))
    return derived(out)


def experiment_delta(experiments: DataFrame, stats: DataFrame) -> DataFrame:
    """experiments (code, base, candidate or null) with both versions' statistics and their difference."""
    base = stats.select(F.col("version_id").alias("base"), F.col("n").alias("base_n"), F.col("expectancy").alias("base_expectancy"))
    candidate = stats.select(F.col("version_id").alias("candidate"), F.col("n").alias("candidate_n"), F.col("expectancy").alias("candidate_expectancy"))
    out = experiments.join(base, "base").join(candidate, "candidate", "left")
    return out.withColumn("delta", F.col("candidate_expectancy") - F.col("base_expectancy"))


def findings(analyses: DataFrame, rules: Mapping[str, tuple[str, Column, Column]]) -> DataFrame:
    """A row per rule that holds: the columns of analyses, kind (FACT or HYPOTHESIS), code and evidence (JSON)."""
    made = [F.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"), evidence.alias("evidence"))) for code, (kind, holds, evidence) in rules.items()]
    return analyses.withColumn("_f", F.explode(F.array_compact(F.array(*made)))).select(*analyses.columns, "_f.*")


def metric(json: Column, name: str) -> Column:
    """A number of an imported metrics object; null where it is missing or no number."""
    return F.get_json_object(json, f"$.{name}").try_cast("double")
