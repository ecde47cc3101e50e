"""Predictions from fixed weights, rules and probability vectors, as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_margin(weights: dict[str, float], intercept: float = 0.0) -> Column:
    """Weighted sum of columns, added in the order given."""
    terms = [F.col(c) * F.lit(float(w)) for c, w in weights.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(float(intercept)))


def score_linear(
    df: DataFrame,
    weights: dict[str, float],
    label: str = "Class",
    intercept: float = 0.0,
    threshold: float = 0.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(label, prediction): 1 where the margin lies above the threshold."""
    above = (linear_margin(weights, intercept) > threshold).cast("double")
    return df.select(*carry, F.col(label).cast("double").alias("label"), above.alias("prediction"))


def rule_score(df: DataFrame, rule: Column, label: str = "Class") -> DataFrame:
    """Add ``label`` and a 0/1 ``prediction`` that says where the rule holds."""
    return df.withColumn("label", F.col(label).cast("double")).withColumn(
        "prediction", F.when(rule, 1.0).otherwise(0.0)
    )


def argmax_prediction(probabilities: Column) -> Column:
    """Position, from 0, of the largest entry of an array; the first one in a tie."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1
