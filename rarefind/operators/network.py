"""A perceptron trained with row weights, Adam and dropout: gradients of blocks of rows, summed as a tree.

Spark's own perceptron takes no weights, so a rare row has to be there as many times as it weighs. Here a weight is a factor
of the row's gradient, and fractions keep their meaning. Rows become blocks of a matrix each, held by the executors.
A step sends the network to the tasks (some thousand numbers) and every task adds up the gradients of its blocks. Sums of 64
tasks each are added up by one more task, and the driver takes one small row of each such group. Within a block numbers may
have 32 bits, as in the published network; sums over blocks always have 64.
The outcome is a Spark ML model of the same network, which scores rows in the JVM and is saved like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasMaxIter, HasSeed, HasStepSize, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from rarefind.operators.skew import repeat_rows

# Learning rate, share of values kept by dropout and spread of the first weights of the published network.
PUBLISHED_LEARNING_RATE = 0.01
PUBLISHED_KEEP = 0.6
PUBLISHED_SPREAD = 0.15

BLOCK_ROWS = 1024
#: Rows of a step that one task goes through in about the time that a job takes to start.
ONE_TASK_ROWS = 1 << 17
#: Column with how often a row is there, for ``BlockPerceptron``.
COPIES = "_copies"
_BETA_1, _BETA_2, _EPSILON = 0.9, 0.999, 1e-8
_LEAST_SHARE = 1e-12
_GROUP = 64
_SEARCHES = 20
_BLOCK = "i int, x binary, y binary, w binary"
_SUMS = "part int, cost double, weight double, gradient binary"


def num_weights(layers: Sequence[int]) -> int:
    """Numbers in a network of these layer widths."""
    return sum((a + 1) * b for a, b in pairwise(layers))


def first_weights(layers: Sequence[int], seed: int, spread: float = PUBLISHED_SPREAD) -> np.ndarray:
    """Normal numbers, drawn again where they are more than two deviations out; shifts start at 0."""
    random = np.random.default_rng(seed)
    parts = []
    for a, b in pairwise(layers):
        drawn = random.standard_normal(a * b)
        while (out := np.abs(drawn) > 2).any():
            drawn[out] = random.standard_normal(int(out.sum()))
        parts += [drawn * spread, np.zeros(b)]
    return np.concatenate(parts)


def _matrices(layers: Sequence[int], weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the flat weights, laid out as Spark's model has them: a matrix and then a shift for each layer."""
    views, at = [], 0
    for a, b in pairwise(layers):
        views.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return views


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)) in place; numbers of 32 bits by the hyperbolic tangent, which is faster there."""
    if z.dtype == np.float32:
        z *= 0.5
        np.tanh(z, out=z)
        z *= 0.5
        z += 0.5
        return z
    np.clip(z, -500, 500, out=z)
    np.exp(np.negative(z, out=z), out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _forward(
    views: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, mask: np.ndarray | None = None
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Values of every layer but the last, the last hidden ones behind the mask, and the shares of the classes."""
    values = [x]
    for matrix, shift in views[:-1]:
        z = values[-1] @ matrix
        z += shift
        values.append(_sigmoid(z))
    last = values[-1] if mask is None else values[-1] * mask
    share = last @ views[-1][0]
    share += views[-1][1]
    share -= share.max(axis=1, keepdims=True)
    np.exp(share, out=share)
    share /= share.sum(axis=1, keepdims=True)
    return values, last, share


def block_gradient(
    layers: Sequence[int], weights: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, mask: np.ndarray | None = None
) -> tuple[float, np.ndarray]:
    """Sum over rows of weight times cross entropy, and its gradient. ``mask`` multiplies the last hidden layer."""
    views = _matrices(layers, weights)
    values, last, share = _forward(views, x, mask)
    rows = np.arange(len(y))
    cost = -float(w @ np.log(np.maximum(share[rows, y], _LEAST_SHARE)))

    ones = np.ones(len(y), x.dtype)
    gradient = np.empty(num_weights(layers), x.dtype)
    slopes = _matrices(layers, gradient)
    share[rows, y] -= 1
    back = share * w[:, None]
    for i in range(len(views) - 1, -1, -1):
        below = last if i == len(views) - 1 else values[i]
        slopes[i][0][:] = below.T @ back
        slopes[i][1][:] = ones @ back
        if i:
            back = back @ views[i][0].T
            if mask is not None and i == len(views) - 1:
                back *= mask
            slope = 1 - values[i]
            slope *= values[i]
            back *= slope
    return cost, gradient


class Adam:
    """Running means of a gradient and of its square; ``step`` gives the next weights."""

    def __init__(self, size: int, rate: float):
        self.rate, self.steps = rate, 0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.mean = _BETA_1 * self.mean + (1 - _BETA_1) * gradient
        self.square = _BETA_2 * self.square + (1 - _BETA_2) * gradient**2
        mean = self.mean / (1 - _BETA_1**self.steps)
        square = self.square / (1 - _BETA_2**self.steps)
        return weights - self.rate * mean / (np.sqrt(square) + _EPSILON)


def dropout_mask(
    seed: int, step: int, part: int, index: int, rows: int, width: int, keep: float, dtype: str = "f8"
) -> np.ndarray | None:
    """The same numbers whenever a task runs again: they follow from the step and the block's place."""
    if keep >= 1:
        return None
    drawn = np.random.default_rng([seed, step, part, index]).random((rows, width), dtype=np.dtype(dtype))
    return (drawn < keep) * np.dtype(dtype).type(1 / keep) if dtype != "f8" else (drawn < keep) / keep


def to_blocks(
    train: DataFrame, num_features: int, num_classes: int, weight: str | None = None, dtype: str = "f8"
) -> DataFrame:
    """Matrices of up to 1,024 rows from the columns label, features and ``weight``; ``i`` numbers those of a partition.

    ``dtype`` is the kind of the features and weights in the blocks and has to be named again where they are read.
    Rows without a label or features, and those whose weight is null, NaN or not above 0, take no part.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.filter(F.col("label").isNotNull() & F.col("features").isNotNull()).select(
        vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), w.alias("w")
    )

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False)
                if len(x) != part.num_rows * num_features:
                    raise ValueError(f"the first layer takes {num_features} features")
                y = part.column("y").to_numpy(zero_copy_only=False).astype("i4")
                if y.min() < 0 or y.max() >= num_classes:
                    raise ValueError(f"labels have to be 0 to {num_classes - 1}")
                weights = part.column("w").to_numpy(zero_copy_only=False)
                cells = [[x.astype(dtype).tobytes()], [y.tobytes()], [weights.astype(dtype).tobytes()]]
                arrays = [pa.array([index], pa.int32()), *[pa.array(c, pa.binary()) for c in cells]]
                yield pa.RecordBatch.from_arrays(arrays, names=["i", "x", "y", "w"])
                index += 1

    return rows.filter((F.col("w") > 0) & ~F.isnan("w")).mapInArrow(blocks, _BLOCK)


def _read_blocks(
    batches: Iterable[pa.RecordBatch], num_features: int, dtype: str
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, i, features, labels, weights) of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            y = np.frombuffer(row["y"], "i4")
            x = np.frombuffer(row["x"], dtype).reshape(len(y), num_features)
            yield row["part"], row["i"], x, y, np.frombuffer(row["w"], dtype)


def accuracy_and_cost(
    blocks: DataFrame, layers: Sequence[int], weights: np.ndarray, dtype: str = "f8"
) -> tuple[float, float] | tuple[None, None]:
    """Weighted share of right answers and weighted mean cross entropy over all blocks; a number pair of each task is sent."""
    layers, flat = tuple(layers), weights.astype(dtype)

    def of_task(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sums = None, np.zeros(3)
        views = _matrices(layers, flat)
        for part, _, x, y, w in _read_blocks(rows, layers[0], dtype):
            place = part
            share = _forward(views, x)[2]
            right = share.argmax(axis=1) == y
            of_label = np.maximum(share[np.arange(len(y)), y], _LEAST_SHARE)
            w = w.astype("f8")
            sums += [float(w @ right), -float(w @ np.log(of_label)), float(w.sum())]
        if place is not None:
            columns = [pa.array([place], pa.int32()), *[pa.array([v], pa.float64()) for v in sums]]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "right", "cost", "weight"])

    tasks = blocks.select(F.spark_partition_id().alias("part"), "*").mapInArrow(
        of_task, "part int, right double, cost double, weight double"
    )
    found = sorted(tasks.collect(), key=lambda r: r["part"])
    weight = math.fsum(r["weight"] for r in found)
    return (math.fsum(r["right"] for r in found) / weight, math.fsum(r["cost"] for r in found) / weight) if weight else (None, None)


def summed_gradient(
    blocks: DataFrame, layers: Sequence[int], weights: np.ndarray, step: int = 0, batches: int = 1, keep: float = 1.0, seed: int = 0,
    group: int = _GROUP, dtype: str = "f8",
) -> tuple[float, float, np.ndarray]:
    """Cost, weight and gradient summed over the step's blocks: one in ``batches`` of each task's, in turn.

    Parts are added in the order of their numbers, ``group`` of them by one task, so the same blocks give the same bits again.
    """
    layers, size, flat = tuple(layers), num_weights(layers), weights.astype(dtype)

    def of_task(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cost, weight, total = None, 0.0, 0.0, np.zeros(size)
        for part, i, x, y, w in _read_blocks(rows, layers[0], dtype):
            mask = dropout_mask(seed, step, part, i, len(y), layers[-2], keep, dtype)
            more, gradient = block_gradient(layers, flat, x, y, w, mask)
            cost, weight = cost + more, weight + float(w.sum(dtype="f8"))
            total += gradient
        if part is not None:
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "cost": cost, "weight": weight, "gradient": total.tobytes()}],
                schema=pa.schema([("part", pa.int32()), ("cost", pa.float64()), ("weight", pa.float64()), ("gradient", pa.binary())]),
            )

    def of_group(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        total = np.zeros(size)
        for gradient in parts["gradient"]:
            total += np.frombuffer(gradient, "f8")
        sums = [parts["part"].iloc[0], math.fsum(parts["cost"]), math.fsum(parts["weight"]), total.tobytes()]
        return pd.DataFrame([sums], columns=["part", "cost", "weight", "gradient"])

    used = blocks.filter((F.col("i") + step) % batches == 0)
    tasks = used.select(F.spark_partition_id().alias("part"), "*").mapInArrow(of_task, _SUMS)
    if blocks.rdd.getNumPartitions() > group:
        tasks = tasks.groupBy(F.floor(F.col("part") / group).alias("_group")).applyInPandas(of_group, _SUMS)
    found = sorted(tasks.collect(), key=lambda r: r["part"])
    gradient = sum((np.frombuffer(r["gradient"], "f8") for r in found), np.zeros(size))
    return math.fsum(r["cost"] for r in found), math.fsum(r["weight"] for r in found), gradient


def steps_in_one_task(
    blocks: DataFrame, layers: Sequence[int], weights: np.ndarray, steps: int, rate: float, batches: int = 1, keep: float = 1.0,
    seed: int = 0, dtype: str = "f8",
) -> tuple[np.ndarray, list[float]]:
    """All steps of Adam in one task: (weights after them, cost of each), the same bits as step by step over up to 64 parts.

    For blocks so few that a step takes less time than its job.
    """
    layers, size = tuple(layers), num_weights(layers)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted(_read_blocks(rows, layers[0], dtype), key=lambda b: b[:2])
        now, adam, costs = weights, Adam(size, rate), []
        for step in range(steps):
            flat, sums = now.astype(dtype), {}
            for part, i, x, y, w in held:
                if (i + step) % batches:
                    continue
                mask = dropout_mask(seed, step, part, i, len(y), layers[-2], keep, dtype)
                cost, gradient = block_gradient(layers, flat, x, y, w, mask)
                of_part = sums.setdefault(part, [0.0, 0.0, np.zeros(size)])
                of_part[0] += cost
                of_part[1] += float(w.sum(dtype="f8"))
                of_part[2] += gradient
            total = math.fsum(s[1] for s in sums.values())
            if total > 0:
                costs.append(math.fsum(s[0] for s in sums.values()) / total)
                now = adam.step(now, sum((s[2] for s in sums.values()), np.zeros(size)) / total)
        cells = [pa.array([a.tobytes()], pa.binary()) for a in (now, np.array(costs))]
        yield pa.RecordBatch.from_arrays(cells, names=["weights", "costs"])

    found = blocks.select(F.spark_partition_id().alias("part"), "*").coalesce(1).mapInArrow(run, "weights binary, costs binary")
    row = found.first()
    if row is None:
        return weights, []
    return np.frombuffer(row["weights"], "f8"), np.frombuffer(row["costs"], "f8").tolist()


def perceptron_model(
    spark: SparkSession, layers: Sequence[int], weights: Sequence[float]
) -> MultilayerPerceptronClassificationModel:
    """The Spark ML model of these weights, made directly: a fit that takes no step costs several jobs."""
    if len(weights) != num_weights(layers):
        raise ValueError(f"layers {list(layers)} have {num_weights(layers)} weights, not {len(weights)}")
    classes = spark.sparkContext._jvm.org.apache.spark.ml.classification
    uid = MultilayerPerceptronClassificationModel._randomUID()
    java = classes.MultilayerPerceptronClassificationModel(uid, _py2java(spark.sparkContext, Vectors.dense(weights)))
    model = MultilayerPerceptronClassificationModel(java)
    model._set(layers=list(layers))
    model._transfer_params_to_java()
    return model


class WeightedPerceptron(
    Estimator, HasMaxIter, HasStepSize, HasSeed, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Sigmoid layers and a softmax, fitted to the weighted mean cross entropy by ``maxIter`` steps of Adam.

    ``batches`` deals the blocks into that many parts, of which each step reads one; ``keep`` is the share of the last hidden
    layer's values that dropout leaves. ``initialWeights`` goes on from another fit of the same layers. ``costs`` has the mean
    cost of each step of the last fit, before the step. An empty table gives the first weights as they are. ``single`` works
    out each block in 32 bits, which takes about half the time; sums over blocks and the weights keep 64.
    """

    layers = Param(Params._dummy(), "layers", "widths from features to classes", TypeConverters.toListInt)
    initialWeights = Param(Params._dummy(), "initialWeights", "weights to start from", TypeConverters.toVector)
    batches = Param(Params._dummy(), "batches", "parts of the rows, one for each step", TypeConverters.toInt)
    keep = Param(Params._dummy(), "keep", "share of values left by dropout", TypeConverters.toFloat)
    single = Param(Params._dummy(), "single", "whether blocks have numbers of 32 bits", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, layers=None, maxIter=100, stepSize=PUBLISHED_LEARNING_RATE, seed=24, batches=1, keep=1.0,
                 weightCol=None, initialWeights=None, single=False):
        super().__init__()
        self.costs: list[float] = []
        self._setDefault(maxIter=100, stepSize=PUBLISHED_LEARNING_RATE, seed=24, batches=1, keep=1.0, single=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _start(self) -> np.ndarray:
        layers = self.getOrDefault(self.layers)
        if not self.isDefined(self.initialWeights):
            return first_weights(layers, self.getSeed())
        given: DenseVector = self.getOrDefault(self.initialWeights)
        if len(given) != num_weights(layers):
            raise ValueError(f"layers {layers} have {num_weights(layers)} weights, not {len(given)}")
        return given.toArray()

    def dtype(self) -> str:
        """The kind of the numbers in a block."""
        return "f4" if self.getOrDefault(self.single) else "f8"

    def blocks(self, dataset: DataFrame, weighted: bool = True) -> DataFrame:
        """The rows as blocks, held until the caller lets them go; ``fit_blocks`` takes them as often as wanted."""
        layers = self.getOrDefault(self.layers)
        weight = self.getWeightCol() if weighted and self.isDefined(self.weightCol) else None
        return to_blocks(dataset, layers[0], layers[-1], weight, self.dtype()).persist(StorageLevel.MEMORY_AND_DISK)

    def fit_blocks(self, blocks: DataFrame) -> MultilayerPerceptronClassificationModel:
        """``fit`` on rows that ``blocks`` has prepared."""
        layers, weights = self.getOrDefault(self.layers), self._start()
        batches, keep = self.getOrDefault(self.batches), self.getOrDefault(self.keep)
        if batches < 1 or not 0 < keep <= 1:
            raise ValueError("batches has to be 1 or more, keep above 0 and at most 1")
        self.costs = []
        if self.getMaxIter() and blocks.count() * BLOCK_ROWS <= batches * ONE_TASK_ROWS:
            weights, self.costs = steps_in_one_task(
                blocks, layers, weights, self.getMaxIter(), self.getStepSize(), batches, keep, self.getSeed(), self.dtype()
            )
            return perceptron_model(blocks.sparkSession, layers, weights)
        adam = Adam(len(weights), self.getStepSize())
        for step in range(self.getMaxIter()):
            cost, total, gradient = summed_gradient(
                blocks, layers, weights, step, batches, keep, self.getSeed(), dtype=self.dtype()
            )
            if total > 0:
                self.costs.append(cost / total)
                weights = adam.step(weights, gradient / total)
        return perceptron_model(blocks.sparkSession, layers, weights)

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        blocks = self.blocks(dataset)
        try:
            return self.fit_blocks(blocks)
        finally:
            blocks.unpersist()


def least_cost(
    cost_and_slope: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float, memory: int = 10
) -> np.ndarray:
    """Limited-memory BFGS with a search for a weak Wolfe point; ends once ten steps gain less than ``tol`` each, relatively."""
    cost, slope = cost_and_slope(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    costs = [cost]
    for _ in range(max_iter):
        way, shares = -slope, []
        for moved, turned in reversed(pairs):
            share = (moved @ way) / (moved @ turned)
            way = way - share * turned
            shares.append(share)
        if pairs:
            moved, turned = pairs[-1]
            way = way * ((moved @ turned) / (turned @ turned))
        for (moved, turned), share in zip(pairs, reversed(shares)):
            way = way + (share - (turned @ way) / (moved @ turned)) * moved
        steep = slope @ way
        if not steep < 0:
            way, steep, pairs = -slope, -(slope @ slope), []
        if steep == 0:
            break
        low, high, length = 0.0, math.inf, 1.0 if pairs else min(1.0, 1 / math.sqrt(slope @ slope))
        for _ in range(_SEARCHES):
            new_cost, new_slope = cost_and_slope(x + length * way)
            if not new_cost <= cost + 1e-4 * length * steep:
                high = length
            elif new_slope @ way < 0.9 * steep:
                low = length
            else:
                break
            length = 2 * low if high == math.inf else (low + high) / 2
        if not new_cost < cost:
            break
        moved, turned = length * way, new_slope - slope
        x, cost, slope = x + moved, new_cost, new_slope
        if moved @ turned > 0:
            pairs = [*pairs, (moved, turned)][-memory:]
        costs.append(cost)
        if len(costs) > 10 and costs[-11] - cost <= 10 * tol * abs(costs[-11]):
            break
    return x


class BlockPerceptron(MultilayerPerceptronClassifier):
    """Spark's perceptron, first weights and settings included, whose passes over all rows go through blocks in 32 bits.

    Only the solver ``l-bfgs`` is worked out so, and a fit without steps, or by another solver, is Spark's own. A row counts
    as often as its column ``COPIES`` says, if there is one: its gradient is worked out once and taken that many times.
    """

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        copies = COPIES if COPIES in dataset.columns else None
        if self.getSolver() != "l-bfgs" or self.getMaxIter() == 0:
            return super()._fit(repeat_rows(dataset, copies) if copies else dataset)
        layers = self.getLayers()
        wanted = [F.col(self.getLabelCol()).alias("label"), F.col(self.getFeaturesCol()).alias("features")]
        rows = dataset.select(*wanted, *([copies] if copies else []))
        names = [self.getLabelCol(), self.getFeaturesCol()]
        one = dataset.sparkSession.createDataFrame([(0.0, Vectors.zeros(layers[0]))], names)
        start = super(BlockPerceptron, self.copy({self.maxIter: 0}))._fit(one).weights.toArray()
        blocks = to_blocks(rows, layers[0], layers[-1], copies, "f4").persist(StorageLevel.MEMORY_AND_DISK)

        def mean(weights: np.ndarray) -> tuple[float, np.ndarray]:
            cost, total, gradient = summed_gradient(blocks, layers, weights, dtype="f4")
            if not total:
                raise ValueError("no rows to train on")
            return cost / total, gradient / total

        try:
            weights = least_cost(mean, start, self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        still = self.copy({self.initialWeights: Vectors.dense(weights), self.maxIter: 0})
        return super(BlockPerceptron, still)._fit(one)
