"""Quality gates as tables of ``rule, actual, minimum, ok``; nothing raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minimum_gates(actuals: DataFrame, minimums: dict[str, float]) -> DataFrame:
    """Gates over ``rule, actual`` rows; a rule without an actual value has 0."""
    spark = actuals.sparkSession
    wanted = spark.createDataFrame([(k, float(v)) for k, v in minimums.items()], "rule string, minimum double")
    out = wanted.join(actuals.select("rule", F.col("actual").cast("double").alias("actual")), "rule", "left").withColumn("actual", F.coalesce("actual", F.lit(0.0)))
    return out.select("rule", "actual", "minimum", (F.col("actual") >= F.col("minimum")).alias("ok"))


def metric_gates(metrics: DataFrame, bounds: dict[str, tuple[str, float]]) -> DataFrame:
    """Gates of one row of metrics against bounds such as ``{"loss": ("<", 8.5)}``; null, NaN and infinite fail."""
    test = {"<": lambda c, b: c < b, "<=": lambda c, b: c <= b, ">": lambda c, b: c > b, ">=": lambda c, b: c >= b}
    one = lambda k, op, b: F.struct(F.lit(k).alias("rule"), F.col(k).cast("double").alias("actual"), F.lit(op).alias("relation"), F.lit(float(b)).alias("bound"))
    rows = metrics.select(F.explode(F.array(*(one(k, op, b) for k, (op, b) in bounds.items()))).alias("g")).select("g.*")
    finite = ~(F.isnan("actual") | F.col("actual").isin(float("inf"), float("-inf")))
    passed = F.lit(False)
    for op, f in test.items():
        passed |= (F.col("relation") == op) & f(F.col("actual"), F.col("bound"))
    return rows.withColumn("ok", F.coalesce(finite & passed, F.lit(False)))


def messages(rules: Sequence[tuple[str, str, float]]) -> Column:
    """Messages of the ``(column, relation, bound)`` rules that a row of metrics fails; null and NaN fail every rule."""
    test = {"<": lambda c, b: c < b, "<=": lambda c, b: c <= b, ">": lambda c, b: c > b, ">=": lambda c, b: c >= b}
    one = lambda k, op, b: F.when(~F.coalesce(test[op](F.col(k), F.lit(b)) & ~F.isnan(F.col(k)), F.lit(False)), F.lit(f"{k} is not {op} {b}"))
    return F.array_compact(F.array(*(one(*r) for r in rules)))


def violations(gates: DataFrame) -> Column:
    """Array of the rules that failed, for an aggregate over gates."""
    return F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("rule"))))


def missing_values(actual: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Wanted values that a column does not have."""
    want = actual.sparkSession.createDataFrame([(w,) for w in wanted], f"`{column}` string")
    return want.join(actual.select(column).distinct(), column, "left_anti")


def weighted_score(losses: dict[str, Column], weights: dict[str, float]) -> Column:
    total = sum(weights.values())
    return sum((losses[k] * w for k, w in weights.items()), F.lit(0.0)) / total


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))
