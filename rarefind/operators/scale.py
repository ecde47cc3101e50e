"""Class weights and z-scores: one small aggregate, then a projection.

The aggregate is a single row whatever the table size. It reaches the projection as literals, the
way a fitted Spark ML model carries its parameters, so no join is involved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the extra factor on the weight of the rare class.
PUBLISHED_WEIGHT_BOOST = 1.25


def positive_weight(
    train: DataFrame, label: str = "Class", positive: float = 1.0, boost: float = PUBLISHED_WEIGHT_BOOST
) -> float:
    """All training rows over positive training rows, times the boost."""
    row = train.agg(
        F.count("*").alias("n"), F.count_if(F.col(label) == F.lit(positive)).alias("n_pos")
    ).first()
    if not row["n_pos"]:
        raise ValueError("no positive rows to weigh")
    return row["n"] / row["n_pos"] * boost


def class_weight(
    df: DataFrame,
    label: str = "Class",
    positive: float = 1.0,
    boost: float = PUBLISHED_WEIGHT_BOOST,
    train: DataFrame | None = None,
    name: str = "weight",
) -> DataFrame:
    """Add a weight column: ``positive_weight`` of the training rows on positives, 1 elsewhere."""
    weight = positive_weight(df if train is None else train, label, positive, boost)
    return df.withColumn(
        name, F.when(F.col(label) == F.lit(positive), F.lit(weight)).otherwise(F.lit(1.0))
    )


@dataclass(frozen=True)
class Moments:
    """Mean and sample standard deviation per column."""

    mean: dict[str, float]
    std: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        """(x - mean) / std in place; a column that never varies becomes 0."""

        def scaled(c: str):
            std = self.std[c]
            centred = F.col(c) - F.lit(self.mean[c])
            return (centred / F.lit(std) if std else centred * 0.0).alias(c)

        return df.select(*[scaled(c) if c in self.mean else F.col(f"`{c}`") for c in df.columns])


    def stage(self) -> SQLTransformer:
        """The same as a pipeline stage, into columns ``_z_<name>``, so that a saved model scales new rows."""

        def scaled(c: str) -> str:
            std = self.std[c]
            centred = f"(`{c}` - {self.mean[c]!r}D)"
            return f"{centred} / {std!r}D AS `_z_{c}`" if std else f"{centred} * 0D AS `_z_{c}`"

        return SQLTransformer(statement=f"SELECT *, {', '.join(map(scaled, self.mean))} FROM __THIS__")


def fit_moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """One pass over the named columns only."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()

    def number(value) -> float:
        return 0.0 if value is None or math.isnan(value) else value

    return Moments(
        {c: number(row[f"m{i}"]) for i, c in enumerate(columns)},
        {c: number(row[f"s{i}"]) for i, c in enumerate(columns)},
    )


def zscore(
    train: DataFrame, test: DataFrame, columns: Sequence[str], fit_on: str = "train"
) -> tuple[DataFrame, DataFrame]:
    """Both sets z-scored with the same moments.

    ``fit_on="train"`` keeps the test rows out of the moments. ``fit_on="all"`` takes train and test
    together, as the published study did, which lets test rows leak into the training features.
    """
    if fit_on == "train":
        source = train.select(*columns)
    elif fit_on == "all":
        source = train.select(*columns).unionByName(test.select(*columns))
    else:
        raise ValueError(f"fit_on must be 'train' or 'all', not {fit_on!r}")
    moments = fit_moments(source, columns)
    return moments.apply(train), moments.apply(test)
