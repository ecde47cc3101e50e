"""Estimators with the published settings, parameter grids, and training with early stopping.

Seeds are always set: Spark ML's default seeds come from a Python hash that changes per process.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from rarefind.functions.hashing import unit_hash
from rarefind.operators.network import COPIES, BlockPerceptron, WeightedPerceptron, accuracy_and_cost
from rarefind.operators.skew import repeat_rows, spread
from rarefind.sources.models import save_model
from rarefind.sources.scratch import ensure_checkpoint_dir, stored

SEED = 24
HELD_OUT_SALT = "held-out:"

# SVM settings, hidden layer widths, early-stopping rule of the published study.
PUBLISHED_SVM = {"maxIter": 100, "regParam": 0.01}
PUBLISHED_HIDDEN_LAYERS = [18, 27, 40]
PUBLISHED_PATIENCE = 15
PUBLISHED_MIN_ROUNDS = 80
PUBLISHED_ACCURACY_FLOOR = 0.993


def random_forest(spark: SparkSession, **settings) -> RandomForestClassifier:
    """All features per node. Rows find their node by walking down the trees: a cache of node ids takes a number per
    row and tree in every pass, which is more to read than the walk costs."""
    ensure_checkpoint_dir(spark)
    defaults = dict(
        featureSubsetStrategy="all", cacheNodeIds=False, checkpointInterval=10,
        maxMemoryInMB=1024, seed=SEED,
    )
    return RandomForestClassifier(**{**defaults, **settings})


def gradient_boosted_trees(spark: SparkSession, **settings) -> GBTClassifier:
    """Boosting keeps a running error per row; without checkpoints its lineage grows per tree.

    Name a boolean column in ``validationIndicatorCol`` to stop early on it.
    """
    ensure_checkpoint_dir(spark)
    defaults = dict(cacheNodeIds=False, checkpointInterval=10, maxMemoryInMB=1024, seed=SEED)
    return GBTClassifier(**{**defaults, **settings})


def held_out(keys: Sequence[str], share: float = 0.2) -> Column:
    """True for a share of the rows, drawn by hash of the key; independent of splits, folds and samples."""
    return unit_hash(keys, HELD_OUT_SALT) < share


def self_stopping_trees(spark: SparkSession, indicator: str = "held_out", **settings) -> GBTClassifier:
    """Boosting that decides its number of trees in one fit.

    Trees are grown on the rows where ``indicator`` is false. After each one the loss on the others is taken, and the
    first round that does not lower it ends the fit and is left out. ``maxIter`` is only the most there can be.
    """
    return gradient_boosted_trees(spark, validationIndicatorCol=indicator, **{"validationTol": 0.0, **settings})


def bagged_trees(estimator: Estimator, param_maps: Sequence[dict] = ({},)) -> int:
    """Trees that are grown from draws of the rows at the same time: the most of any map; 1 for all but forests."""
    if not estimator.hasParam("numTrees"):
        return 1
    size = estimator.getParam("numTrees")
    return max(m.get(size, estimator.getOrDefault(size)) for m in param_maps)


def indicator_of(estimator: Estimator) -> list[str]:
    """The estimator's column of held-out rows, if it has one."""
    name = "validationIndicatorCol"
    used = estimator.hasParam(name) and estimator.isDefined(name)
    return [estimator.getOrDefault(name)] if used else []


def linear_svm(**settings) -> LinearSVC:
    """Hinge loss with L2, no intercept. Give z-scored features; they are not scaled again."""
    defaults = dict(fitIntercept=False, standardization=False, **PUBLISHED_SVM)
    return LinearSVC(**{**defaults, **settings})


def multilayer_perceptron(num_features: int, **settings) -> MultilayerPerceptronClassifier:
    """Sigmoid layers of 18, 27 and 40 with a softmax over two classes; passes over the rows go through blocks."""
    defaults = dict(layers=[num_features, *PUBLISHED_HIDDEN_LAYERS, 2], seed=SEED)
    return BlockPerceptron(**{**defaults, **settings})


def weighted_perceptron(num_features: int, **settings) -> WeightedPerceptron:
    """The same layers, trained on the column ``weight`` with Adam; rows are not repeated."""
    defaults = dict(
        layers=[num_features, *PUBLISHED_HIDDEN_LAYERS, 2], seed=SEED, weightCol="weight", stepSize=0.05, batches=4, single=True
    )
    return WeightedPerceptron(**{**defaults, **settings})


# The published grids.
FOREST_GRID = {
    "maxDepth": [8, 12, 15],
    "minInfoGain": [0.0, 0.001],
    "minInstancesPerNode": [1, 2, 3],
    "numTrees": [20, 50, 100, 120],
}
BOOSTING_GRID = {
    "maxDepth": [5, 8, 10],
    "minInfoGain": [0.0, 0.001],
    "minInstancesPerNode": [1, 2, 3],
    "maxIter": [100, 150, 200],
    "stepSize": [0.01, 0.1],
}
BOOSTING_GRID_SMALL = {
    "maxDepth": [5, 8, 10],
    "minInfoGain": [0.0, 0.001],
    "minInstancesPerNode": [1, 3],
    "maxIter": [100, 150, 200],
    "stepSize": [0.01, 0.1],
}
FOREST_GRID_SMALL = {"maxDepth": [12], "numTrees": [100]}


def param_grid(estimator, values: dict[str, Sequence]) -> list[dict]:
    """Every combination of the named parameters."""
    builder = ParamGridBuilder()
    for name, choices in values.items():
        builder = builder.addGrid(estimator.getParam(name), list(choices))
    return builder.build()


def repeat_by_weight(train: DataFrame, weight: str, counted: bool = False) -> DataFrame:
    """Each row as often as its rounded weight, for estimators that take no weights.

    Counts are whole numbers of 64 bits. A row with very many copies is cut into chunks that are dealt out
    before they are written out, and all copies are dealt evenly to training partitions. ``counted`` gives each row
    once instead, with its number of copies in the column ``network.COPIES``, for estimators that read it.
    """
    times = F.greatest(F.round(F.col(weight)).cast("bigint"), F.lit(0).cast("bigint"))
    if counted:
        rows = train.withColumn(COPIES, times).drop(weight).filter(F.col(COPIES) > 0)
        return spread(rows, rows.count())
    total = train.agg(F.sum(times)).first()[0] or 0
    return spread(repeat_rows(train.withColumn("_times", times).drop(weight), "_times"), total)


def fit_stored(
    pipeline: Pipeline, train: DataFrame, partitions: int | None = None
) -> PipelineModel:
    """Fit a pipeline whose last stage is the estimator, reading the source twice at most.

    The stages before it are fitted first. Their output, reduced to label, features and weight, is written to the
    shared folder, with the column of held-out rows if the estimator names one, dealt into training partitions and held while the estimator makes its many passes.
    ``partitions`` fixes how many there are: models depend on it, as bagging draws per partition. By
    default it follows the number of rows and of cores.
    """
    *before, estimator = pipeline.getStages()
    prepared = Pipeline(stages=before).fit(train)
    ready = prepared.transform(train)
    columns = [c for c in ("label", "features", "weight") if c in ready.columns] + indicator_of(estimator)
    rows = stored(ready.select(*columns), "training")
    even = rows.repartition(partitions) if partitions else spread(rows, rows.count(), bagged_trees(estimator))
    even = even.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = estimator.fit(even)
    finally:
        even.unpersist()
    return PipelineModel(stages=[*prepared.stages, model])


@dataclass
class EarlyStopResult:
    """``model`` is the first of the most accurate rounds, or None if none passed the floor.

    ``history`` has the validation accuracy of each round, ``report`` also the training accuracy and the
    costs on both sets: rows of ``EARLY_STOP_REPORT``.
    """

    model: MultilayerPerceptronClassificationModel | None
    best_round: int | None
    history: list[float]
    report: list[tuple]


EARLY_STOP_REPORT = "round int, train_accuracy double, validation_accuracy double, train_cost double, validation_cost double"


def _accuracy_and_cost(scored: DataFrame) -> tuple[float, float | None]:
    """Share of right predictions and mean cross entropy, in one pass; no cost without probabilities.

    Both count a row by its column ``weight``, if there is one. Rows repeated by weight count as often as they are there.
    """
    weight = F.col("weight") if "weight" in scored.columns else F.lit(1.0)
    right = F.sum(weight * (F.col("prediction") == F.col("label")).cast("double")) / F.sum(weight)
    cost = F.lit(None).cast("double")
    if "probability" in scored.columns:
        p = F.get(vector_to_array("probability"), F.col("label").cast("int"))
        cost = F.sum(-weight * F.ln(F.greatest(p, F.lit(1e-12)))) / F.sum(weight)
    return tuple(scored.agg(right, cost).first())


_STATE = "round int, weights array<double>, kept array<double>, kept_round int, behind int, report array<struct<round int, train_accuracy double, validation_accuracy double, train_cost double, validation_cost double>>"


def _with_weights(
    estimator: MultilayerPerceptronClassifier | WeightedPerceptron, rows: DataFrame, weights: DenseVector
) -> MultilayerPerceptronClassificationModel:
    """The network of these weights: a fit that starts there and takes no step."""
    still = estimator.copy({estimator.initialWeights: weights, estimator.maxIter: 0})
    return still.fit_blocks(rows) if isinstance(still, WeightedPerceptron) else still.fit(rows)


def _save_state(spark: SparkSession, folder: str, state: tuple) -> None:
    """One small table for each round; a round that was written in part has no success mark and does not count."""
    table = spark.createDataFrame([state], _STATE).coalesce(1)
    table.write.mode("overwrite").parquet(f"{folder}/round-{state[0]:06}")


def _last_state(spark: SparkSession, folder: str) -> tuple | None:
    """The state after the last whole round; None if there is none."""
    context = spark.sparkContext
    marks = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/round-*/_SUCCESS")
    found = marks.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(marks)
    rounds = sorted(f.getPath().getParent().toString() for f in found or [])
    return tuple(spark.read.schema(_STATE).parquet(rounds[-1]).first()) if rounds else None


def train_until_no_gain(
    train: DataFrame,
    validation: DataFrame,
    estimator: MultilayerPerceptronClassifier | WeightedPerceptron,
    round_iters: int = 15,
    max_rounds: int = 1000,
    patience: int = PUBLISHED_PATIENCE,
    min_rounds: int = PUBLISHED_MIN_ROUNDS,
    floor: float = PUBLISHED_ACCURACY_FLOOR,
    save_to: str | None = None,
    before: Sequence[Transformer] = (),
    resume_from: str | None = None,
) -> EarlyStopResult:
    """Short fits that go on from each other's weights until validation accuracy stops rising.

    Stops after ``patience`` rounds in a row below the best accuracy so far, counted once past
    ``min_rounds``. A round above the floor that beats all before it is kept, and written to
    ``save_to`` if given: as a pipeline behind the stages in ``before``, so that the file alone scores new
    rows. The two sets are read from storage once and held for all rounds, as blocks where the estimator takes those. A column ``weight`` of the training rows is kept
    for estimators that use it.

    ``resume_from`` names a shared folder that gets weights, history and patience after every round. A call that finds
    rounds there goes on behind the last whole one, so a lost driver costs one round, and a call on a finished folder gives
    its result at the price of one short fit. The folder belongs to one training: rows and settings have to be the same.
    """
    spark = train.sparkSession
    weight = [c for c in ("weight",) if c in train.columns]
    train, validation = train.select("label", "features", *weight), validation.select("label", "features")
    in_blocks = isinstance(estimator, WeightedPerceptron)
    if in_blocks:
        train, validation = estimator.blocks(train), estimator.blocks(validation, weighted=False)
    else:
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
        validation = validation.persist(StorageLevel.MEMORY_AND_DISK)

    def reached_by(model: MultilayerPerceptronClassificationModel, rows: DataFrame) -> tuple[float, float | None]:
        if not in_blocks:
            return _accuracy_and_cost(model.transform(rows))
        return accuracy_and_cost(rows, estimator.getOrDefault("layers"), model.weights.toArray(), estimator.dtype())

    history: list[float] = []
    report: list[tuple] = []
    kept, kept_round, weights, behind, first = None, None, None, 0, 0
    try:
        state = _last_state(spark, resume_from) if resume_from else None
        if state is not None:
            last, weights, kept_weights, kept_round, behind, report = state
            weights, report, first = Vectors.dense(weights), [tuple(r) for r in report], last + 1
            history = [r[2] for r in report]
            if kept_weights is not None:
                kept = _with_weights(estimator, train, Vectors.dense(kept_weights))
        for round_number in range(first, max_rounds):
            if history and behind >= patience:
                break
            step = estimator.copy({estimator.maxIter: round_iters})
            if weights is not None:
                step = step.copy({step.initialWeights: weights})
            model = step.fit_blocks(train) if in_blocks else step.fit(train)
            weights = model.weights
            on_train = reached_by(model, train)
            reached, cost = reached_by(model, validation)
            report.append((round_number, on_train[0], reached, on_train[1], cost))
            if reached > max(history, default=-1.0) and reached > floor:
                kept, kept_round = model, round_number
                if save_to:
                    save_model(PipelineModel(stages=[*before, model]), save_to)
            history.append(reached)
            below_best = reached < max(history) and round_number > min_rounds
            behind = behind + 1 if below_best else 0
            if resume_from:
                kept_weights = None if kept is None else kept.weights.toArray().tolist()
                state = (round_number, weights.toArray().tolist(), kept_weights, kept_round, behind, report)
                _save_state(spark, resume_from, state)
    finally:
        train.unpersist()
        validation.unpersist()
    return EarlyStopResult(kept, kept_round, history, report)
