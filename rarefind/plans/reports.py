"""End-to-end jobs: raw text to a confusion matrix, and the weighted network study."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefind.operators.aggregate import confusion_matrix
from rarefind.operators.clean import clean
from rarefind.operators.features import score
from rarefind.operators.network import WeightedPerceptron
from rarefind.operators.project import threshold_flags
from rarefind.operators.sample import (
    exact_fraction_sample,
    half_split,
    random_split,
)
from rarefind.operators.scale import fit_moments, positive_weight
from rarefind.operators.search import (
    PUBLISHED_SMALL_FOLDS,
    PUBLISHED_SMALL_RATES,
    SearchResult,
    tune_imbalanced,
)
from rarefind.operators.skew import spread
from rarefind.operators.train import (
    FOREST_GRID_SMALL,
    EarlyStopResult,
    param_grid,
    random_forest,
    train_until_no_gain,
    weighted_perceptron,
)
from rarefind.sources.delimited import read_raw_csv
from rarefind.sources.scratch import fresh_path, stored


@dataclass
class FraudReport:
    """The search's outcome, the scored test rows and their confusion matrix."""

    search: SearchResult
    scored: DataFrame
    matrix: DataFrame


def _key_number(key: str) -> Column:
    """The key as a whole number; a missing or bad one stops the job, as one bad value elsewhere does."""
    missing = F.raise_error(F.lit(f"a row has no {key}")).cast("bigint")
    return F.coalesce(F.col(key).cast("bigint"), missing)


def clean_csv(
    spark: SparkSession, path: str, keys: Sequence[str], drop: Sequence[str] = ()
) -> DataFrame:
    """Cleaned rows of a CSV, stored once as a columnar table in the shared folder.

    Keys become whole numbers and everything else doubles. All later passes read the stored columns
    instead of parsing text again, also after an executor is lost.
    """
    raw = read_raw_csv(spark, path).drop(*drop)
    numbers = clean(raw, [c for c in raw.columns if c not in set(keys)])
    table = fresh_path(spark, "clean")
    numbers.withColumns({k: _key_number(k) for k in keys}).write.parquet(table)
    return spark.read.parquet(table)


def fraud_report(
    data: DataFrame,
    keys: Sequence[str],
    split_keys: Sequence[str] | None = None,
    *,
    estimator: Callable[[SparkSession], Estimator] = random_forest,
    grid: dict[str, Sequence] = FOREST_GRID_SMALL,
    rates: Sequence[float] = tuple(PUBLISHED_SMALL_RATES),
    num_folds: int = PUBLISHED_SMALL_FOLDS,
    label: str = "Class",
    **search_options,
) -> FraudReport:
    """Split, tune, score and count. ``keys`` identify rows and never become features."""
    train, test = random_split(data, split_keys or keys)
    model = estimator(data.sparkSession)
    features = [c for c in data.columns if c not in {*keys, label}]
    found = tune_imbalanced(
        train,
        model,
        param_grid(model, grid),
        rates,
        num_folds,
        keys=split_keys or keys,
        label=label,
        features=features,
        **search_options,
    )
    scored = score(found.model, test)
    return FraudReport(found, scored, confusion_matrix(scored))


@dataclass
class NetworkStudy:
    """Early-stopping outcome, the kept pipeline, and the rows it scored: training rows and the test half."""

    training: EarlyStopResult
    pipeline: PipelineModel
    train_scored: DataFrame
    scored: DataFrame


def network_study(
    data: DataFrame,
    keys: Sequence[str],
    flags: Sequence[tuple[str, str, float]] = (),
    *,
    drop: Sequence[str] = (),
    label: str = "Class",
    train_fraction: float = 0.8,
    fit_on: str = "train",
    save_to: str | None = None,
    estimator: MultilayerPerceptronClassifier | WeightedPerceptron | None = None,
    **stopping,
) -> NetworkStudy:
    """Flags, an exact share of each class for training, weights, z-scores, network, held-out halves.

    The rows outside the training sample are halved: one half steers early stopping, the other is
    scored with the kept weights. The prepared source is stored once, and every later pass reads that table.
    The network is ``weighted_perceptron`` unless another estimator of the same kind is given; one that
    takes no weights counts every row once.
    """
    data = threshold_flags(data.drop(*drop), flags) if flags else data.drop(*drop)
    data = stored(data, "study")
    features = [c for c in data.columns if c not in {*keys, label}]
    train, held_out = exact_fraction_sample(data, train_fraction, keys, label)
    validation, test = half_split(held_out, keys)
    weight = positive_weight(train, label)
    moments = fit_moments(train if fit_on == "train" else train.unionByName(held_out), features)
    before = [
        moments.stage(),
        SQLTransformer(statement=f"SELECT *, CAST(`{label}` AS DOUBLE) AS label FROM __THIS__"),
        VectorAssembler(inputCols=[f"_z_{c}" for c in features], outputCol="features"),
    ]

    def vectors(df: DataFrame) -> DataFrame:
        return PipelineModel(stages=before).transform(df).drop(*[f"_z_{c}" for c in features])

    weighted = train.withColumn("weight", F.when(F.col(label) == 1, weight).otherwise(1.0))
    rows = stored(vectors(weighted).select("label", "features", "weight"), "training")
    result = train_until_no_gain(
        spread(rows, rows.count()),
        vectors(validation),
        estimator or weighted_perceptron(len(features)),
        save_to=save_to,
        before=before,
        **stopping,
    )
    if result.model is None:
        raise RuntimeError(f"no round passed the accuracy floor; reached {max(result.history):.4f}")
    return NetworkStudy(
        result,
        PipelineModel(stages=[*before, result.model]),
        result.model.transform(vectors(train)),
        result.model.transform(vectors(test)),
    )
