"""The weighted perceptron against plain NumPy, repeated rows, and Spark's own network."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from rarefind.operators import network as net
from rarefind.operators import train

LAYERS = [3, 5, 4, 2]


def _rows(n, seed=1):
    random = np.random.default_rng(seed)
    x = random.standard_normal((n, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] > 0)).astype(int)
    return x, y, random.random(n) * 3 + 0.1


def _frame(spark, x, y, w, partitions=3):
    rows = [(float(b), Vectors.dense(a), float(c)) for a, b, c in zip(x, y, w)]
    return spark.createDataFrame(rows, ["label", "features", "weight"]).repartition(partitions)


def test_gradient_is_the_slope_of_the_cost():
    x, y, w = _rows(20)
    weights = net.first_weights(LAYERS, 3, spread=0.8)
    mask = net.dropout_mask(1, 2, 3, 4, 20, 4, 0.6)
    assert set(np.unique(mask)) <= {0.0, 1 / 0.6}
    _, gradient = net.block_gradient(LAYERS, weights, x, y, w, mask)
    for i in range(len(weights)):
        up, down = weights.copy(), weights.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (net.block_gradient(LAYERS, up, x, y, w, mask)[0] - net.block_gradient(LAYERS, down, x, y, w, mask)[0]) / 2e-6
        assert slope == pytest.approx(gradient[i], abs=1e-5)


def test_one_block_trains_as_plain_numpy(spark):
    """Every step on one block: full rows, weights that are fractions, Adam and dropout."""
    x, y, w = _rows(200)
    estimator = net.WeightedPerceptron(layers=LAYERS, maxIter=12, keep=0.6, weightCol="weight", stepSize=0.05, seed=5)
    frame = _frame(spark, x, y, w, 1)
    order = [(r["features"].toArray(), int(r["label"]), r["weight"]) for r in frame.collect()]
    x, y, w = (np.array(c) for c in zip(*order))
    model = estimator.fit(frame)
    weights, costs = net.first_weights(LAYERS, 5), []
    mean, square = np.zeros(len(weights)), np.zeros(len(weights))
    for t in range(1, 13):
        mask = net.dropout_mask(5, t - 1, 0, 0, 200, 4, 0.6)
        cost, gradient = net.block_gradient(LAYERS, weights, x, y, w, mask)
        costs.append(cost / w.sum())
        g = gradient / w.sum()
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        weights = weights - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(model.weights.toArray(), weights, rtol=0, atol=1e-12)
    assert np.allclose(estimator.costs, costs, rtol=0, atol=1e-12)


def test_many_parts_add_up_and_repeat(spark):
    x, y, w = _rows(3000, 2)
    weights = net.first_weights(LAYERS, 1, 0.5)
    cost, gradient = net.block_gradient(LAYERS, weights, x, y, w)
    blocks = net.to_blocks(_frame(spark, x, y, w, 9), 3, 2, "weight").persist()
    got = net.summed_gradient(blocks, LAYERS, weights)
    assert got[0] == pytest.approx(cost, rel=1e-12) and got[1] == pytest.approx(w.sum(), rel=1e-12)
    assert np.allclose(got[2], gradient, rtol=1e-10, atol=1e-9)
    tree = net.summed_gradient(blocks, LAYERS, weights, group=2)
    assert tree[0] == pytest.approx(cost, rel=1e-12) and np.allclose(tree[2], gradient, rtol=1e-10, atol=1e-9)
    again = net.summed_gradient(blocks, LAYERS, weights)
    assert got[0] == again[0] and (got[2] == again[2]).all()
    turns = [net.summed_gradient(blocks, LAYERS, weights, step, batches=2) for step in (0, 1)]
    assert sum(t[1] for t in turns) == pytest.approx(w.sum(), rel=1e-12)
    assert np.allclose(sum(t[2] for t in turns), gradient, rtol=1e-10, atol=1e-9)
    blocks.unpersist()


def test_a_weight_is_as_good_as_copies(spark):
    x, y, _ = _rows(120, 4)
    times = np.where(y == 1, 3, 1)
    weighed = net.WeightedPerceptron(layers=LAYERS, maxIter=10, weightCol="weight").fit(_frame(spark, x, y, times))
    copies = _frame(spark, np.repeat(x, times, axis=0), np.repeat(y, times), np.ones(times.sum()))
    repeated = net.WeightedPerceptron(layers=LAYERS, maxIter=10).fit(copies)
    assert np.allclose(weighed.weights.toArray(), repeated.weights.toArray(), atol=1e-8)


def test_layout_is_that_of_the_spark_model(spark):
    """Probabilities of Spark's model equal the forward pass, and Spark's own trained weights have our cost."""
    x, y, w = _rows(60, 6)
    frame = _frame(spark, x, y, np.ones(60), 1)
    own = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=20, seed=3).fit(frame)
    same = net.perceptron_model(spark, LAYERS, own.weights.toArray())
    assert (same.weights.toArray() == own.weights.toArray()).all()
    scored = same.transform(frame).collect()
    cost = -sum(np.log(r["probability"][int(r["label"])]) for r in scored)
    assert net.block_gradient(LAYERS, own.weights.toArray(), x, y, np.ones(60))[0] == pytest.approx(cost, rel=1e-9)


def test_in_a_pipeline_saved_and_resumed(spark, tmp_path):
    x, y, w = _rows(300, 7)
    frame = _frame(spark, x, y, w)
    estimator = net.WeightedPerceptron(layers=LAYERS, maxIter=5, weightCol="weight", batches=2)
    first = Pipeline(stages=[estimator]).fit(frame).stages[-1]
    estimator.write().overwrite().save(str(tmp_path / "estimator"))
    loaded = net.WeightedPerceptron.load(str(tmp_path / "estimator"))
    assert loaded.getOrDefault("layers") == LAYERS and loaded.getOrDefault("batches") == 2
    still = estimator.copy({estimator.initialWeights: first.weights, estimator.maxIter: 0}).fit(frame)
    assert (still.weights.toArray() == first.weights.toArray()).all()


def test_odd_rows(spark):
    schema = spark.createDataFrame([(1.0, Vectors.dense(0, 0, 0), 1.0)], ["label", "features", "weight"]).schema
    full = (1.0, Vectors.sparse(3, [1], [2.0]), 0.5)
    odd = [(None, full[1], 1.0), (1.0, None, 1.0), (0.0, full[1], None), (0.0, full[1], float("nan")), (0.0, full[1], 0.0), (0.0, full[1], -2.0)]
    estimator = net.WeightedPerceptron(layers=LAYERS, maxIter=2, weightCol="weight")
    only = estimator.fit(spark.createDataFrame([full], schema)).weights
    assert np.allclose(estimator.fit(spark.createDataFrame([*odd, full], schema)).weights, only, atol=1e-12)
    empty = estimator.fit(spark.createDataFrame([], schema))
    assert (empty.weights.toArray() == net.first_weights(LAYERS, 24)).all() and estimator.costs == []
    with pytest.raises(Exception, match="labels have to be"):
        estimator.fit(spark.createDataFrame([(2.0, full[1], 1.0)], schema))
    with pytest.raises(ValueError, match="weights"):
        estimator.copy({estimator.initialWeights: Vectors.dense([1.0])}).fit(spark.createDataFrame([full], schema))


def test_published_perceptron_trains_through_blocks(spark):
    """From Spark's first weights to about the cost for each row that as many of Spark's own steps reach."""
    x, y, _ = _rows(400, 8)
    frame = _frame(spark, x, y, np.ones(400))
    blocked = train.multilayer_perceptron(3, layers=LAYERS, maxIter=30, seed=3)
    assert isinstance(blocked, net.BlockPerceptron)
    own = MultilayerPerceptronClassifier(layers=LAYERS, maxIter=30, seed=3)

    def cost(model):
        return net.block_gradient(LAYERS, model.weights.toArray(), x, y, np.ones(400))[0] / 400

    none = {blocked.maxIter: 0}
    assert (blocked.fit(frame, none).weights.toArray() == own.fit(frame, {own.maxIter: 0}).weights.toArray()).all()
    assert cost(blocked.fit(frame)) <= cost(own.fit(frame)) + 2e-3 < cost(blocked.fit(frame, none)) / 10
    with pytest.raises(Exception, match="no rows"):
        blocked.fit(frame.filter("label > 5"))


def test_copies_count_as_repeated_rows(spark):
    """A row with its number of copies weighs in the fit what as many equal rows do, and is there once."""
    x, y, _ = _rows(200, 8)
    weighed = _frame(spark, x, y, np.where(y == 1, 2.6, 1.0)).union(_frame(spark, x[:3], 1 - y[:3], np.zeros(3)))
    counted = train.repeat_by_weight(weighed, "weight", counted=True)
    repeated = train.repeat_by_weight(weighed, "weight")
    assert counted.count() == 200 and repeated.count() == counted.agg(F.sum(net.COPIES)).first()[0] == 200 + 2 * y.sum()
    network = train.multilayer_perceptron(3, layers=LAYERS, maxIter=4, seed=3)
    assert np.allclose(network.fit(counted).weights, network.fit(repeated).weights, atol=1e-3)
    none = {network.maxIter: 0}
    assert (network.fit(counted, none).weights.toArray() == network.fit(repeated, none).weights.toArray()).all()


def test_steps_in_one_task_are_the_steps(spark, monkeypatch):
    x, y, w = _rows(3000, 5)
    estimator = net.WeightedPerceptron(layers=LAYERS, maxIter=6, weightCol="weight", batches=2, keep=0.6)
    blocks = estimator.blocks(_frame(spark, x, y, w, 2).repartition(2))
    one_task, costs = estimator.fit_blocks(blocks).weights.toArray(), estimator.costs
    monkeypatch.setattr(net, "ONE_TASK_ROWS", 0)
    assert (estimator.fit_blocks(blocks).weights.toArray() == one_task).all() and estimator.costs == costs
    blocks.unpersist()


def test_least_cost_of_a_bowl():
    scale = np.array([1.0, 10.0, 100.0])
    found = net.least_cost(lambda v: (float(scale @ (v - 3) ** 2) + 1, 2 * scale * (v - 3)), np.zeros(3), 100, 1e-12)
    assert np.allclose(found, 3, atol=1e-4)


def test_numbers_of_32_bits_and_scores_of_blocks(spark):
    x, y, w = _rows(3000, 9)
    weights = net.first_weights(LAYERS, 2, 0.8)
    frame = _frame(spark, x, y, w)
    cost, gradient = net.block_gradient(LAYERS, weights, x, y, w)
    single = net.to_blocks(frame, 3, 2, "weight", "f4")
    got = net.summed_gradient(single, LAYERS, weights, dtype="f4")
    assert got[0] == pytest.approx(cost, rel=1e-5) and np.allclose(got[2], gradient, rtol=1e-3, atol=1e-2)
    model = net.perceptron_model(spark, LAYERS, weights)
    right, mean = train._accuracy_and_cost(model.transform(frame))
    for blocks, dtype in ((single, "f4"), (net.to_blocks(frame, 3, 2, "weight"), "f8")):
        scores = net.accuracy_and_cost(blocks, LAYERS, weights, dtype)
        assert scores[0] == pytest.approx(right, abs=2e-3) and scores[1] == pytest.approx(mean, rel=1e-5)
    assert net.accuracy_and_cost(single.limit(0), LAYERS, weights, "f4") == (None, None)
