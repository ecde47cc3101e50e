"""Quantiles, confusion counts, metrics and chi-square against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from rarefind.operators import aggregate as agg
from rarefind.operators import quantiles


def _frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def _check(spark, values, probabilities):
    known = [v for v in values if v is not None and not math.isnan(v)]
    found = quantiles.exact_quantiles(_frame(spark, values), ["x"], probabilities)["x"]
    assert found == pytest.approx([float(np.quantile(known, p)) for p in probabilities], abs=1e-12)


PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_quantiles_of_small_column(spark):
    _check(spark, [3.0, 1.0, None, float("nan"), 2.0, 10.0], PROBABILITIES)
    assert quantiles.exact_quantiles(_frame(spark, [None, None]), ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("shape", ["even", "heavy", "exponential", "edge"])
def test_quantiles_by_narrowing(spark, monkeypatch, shape):
    monkeypatch.setattr(quantiles, "_FEW_VALUES", 5)
    monkeypatch.setattr(quantiles, "_ACCURACY", 100)
    monkeypatch.setattr(quantiles, "_STEPS", 20)
    rng = random.Random(1)
    n = 4000
    values = {
        "even": [rng.random() for _ in range(n)],
        "heavy": [0.5 if rng.random() < 0.34 else rng.gauss(0, 1) for _ in range(n)],
        "exponential": [math.exp(rng.gauss(0, 40)) for _ in range(n)],
        # the lower quartile falls between the last copy of one value and the first larger one
        "edge": [1.0] * (n // 4) + [2.0 + rng.random() for _ in range(3 * n // 4)],
    }[shape]
    _check(spark, values, [0.25, 0.5, 0.75])


def test_describe_matches_pandas(spark):
    values = [random.Random(2).gauss(5, 2) for _ in range(500)]
    df = _frame(spark, values)
    row = agg.describe(df, ["x"]).first()
    stats = df.toPandas()["x"].describe()
    found = [row[c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
    assert found == pytest.approx(list(stats))


def _scored(spark, rows):
    return spark.createDataFrame(rows, "label double, prediction double")


def test_no_true_positive_scores_zero(spark):
    scored = _scored(spark, [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)])
    counts = agg.confusion_counts(scored)
    assert tuple(counts.first()) == (0, 1, 1)
    assert agg.corrected_f1_score(counts, 5.0).first()["metric"] == 0.0
    nothing = agg.corrected_f1_score(agg.confusion_counts(scored.filter("label = 9")))
    assert nothing.first()["metric"] == 0.0


def test_corrected_f1_by_hand(spark):
    scored = _scored(spark, [(1.0, 1.0)] * 4 + [(0.0, 1.0)] + [(1.0, 0.0)])
    metric = agg.corrected_f1_score(agg.confusion_counts(scored), 5.0).first()["metric"]
    precision = 0.8 / (0.8 + 0.2 * 5)
    assert metric == pytest.approx(2 / (1 / 0.8 + 1 / precision))


def test_wide_matrix_keeps_zeros(spark):
    wide = agg.confusion_matrix_wide(_scored(spark, [(1.0, 1.0), (0.0, 1.0)]))
    assert sorted(tuple(r) for r in wide.collect()) == [(0.0, 0, 1), (1.0, 0, 1)]


def test_first_trial_wins_a_tie(spark):
    summed = spark.createDataFrame(
        [(1, 0.5, 1, 1.5), (0, 0.5, 0, 1.0), (2, 0.2, 0, 1.5)],
        "trial int, rate double, grid_id int, metric double",
    )
    assert agg.best_trial(summed).first()["trial"] == 1


def test_cross_entropy_is_finite_at_zero(spark):
    df = spark.createDataFrame([(0.0, 2.0), (1.0, 1.0)], "p double, w double")
    loss = agg.weighted_cross_entropy(df, F.col("p"), F.col("w")).first()["loss"]
    assert loss == pytest.approx(-2 * math.log(1e-12))


def test_histogram_of_constant_column(spark):
    df = spark.createDataFrame(
        [(1.0, 0.0, 4.0), (1.0, 1.0, 4.0), (0.0, 5.0, 4.0)], "Class double, a double, b double"
    )
    rows = sorted(tuple(r) for r in agg.class_histogram(df, ["a", "b"]).collect())
    assert rows == [
        (0.0, "a", 0, 1), (0.0, "b", 0, 1),
        (1.0, "a", 0, 1), (1.0, "a", 49, 1), (1.0, "b", 0, 2),
    ]


def test_chi_square_agrees_with_spark(spark):
    rng = random.Random(3)
    rows = [
        (float(rng.random() < 0.2), float(rng.randrange(4)), float(rng.randrange(30)), float(rng.random() < 0.5))
        for _ in range(2000)
    ]
    rows = [(y, a + 3 * y, b, c) for y, a, b, c in rows]
    df = spark.createDataFrame(rows, "Class double, a double, b double, c double")
    features = ["c", "a", "b"]
    vectors = VectorAssembler(inputCols=features, outputCol="f").transform(df)
    spark_scores = ChiSquareTest.test(vectors, "f", "Class", flatten=True).orderBy("featureIndex").collect()
    ours = {r["feature"]: r for r in agg.chi_square_scores(df, features).collect()}
    for feature, theirs in zip(features, spark_scores):
        assert ours[feature]["statistic"] == pytest.approx(theirs["statistic"])
        assert ours[feature]["dof"] == theirs["degreesOfFreedom"]
        p = math.exp(agg.log_upper_gamma_share(ours[feature]["dof"] / 2, ours[feature]["statistic"] / 2))
        assert p == pytest.approx(theirs["pValue"], abs=1e-12)
    by_p = sorted(range(3), key=lambda i: spark_scores[i]["pValue"])
    chosen = agg.chi_square_select(df, features, top=2).filter("selected").collect()
    assert {r["feature"] for r in chosen} == {features[i] for i in by_p[:2]}


def test_very_many_classes(spark):
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("Class"), (F.col("id") / 10).alias("x"))
    histogram = agg.class_histogram(rows, ["x"])
    assert histogram.agg(F.sum("n"), F.count_distinct("class")).first() == (20_000, 5000)
    scored = agg.chi_square_select(rows.withColumn("x", F.col("x") % 3), ["x"])
    assert scored.first()["dof"] > 4999


def test_chi_square_ranks_beyond_the_smallest_double(spark):
    """Both p-values are 0 as doubles; the stronger feature still comes first."""
    y = F.col("id") % 2
    strong = spark.range(60_000).select(
        y.cast("double").alias("Class"), F.when(F.col("id") % 10 < 8, y).otherwise(0).alias("weak"), y.alias("full")
    )
    found = {r["feature"]: r for r in agg.chi_square_select(strong, ["weak", "full"], top=1).collect()}
    assert found["full"]["p_value"] == found["weak"]["p_value"] == 0
    assert found["full"]["log_p_value"] < found["weak"]["log_p_value"] < -1000
    assert found["full"]["selected"] and not found["weak"]["selected"]
    assert found["full"]["statistic"] == pytest.approx(60_000)


def test_histogram_leaves_out_infinite_values(spark):
    rows = [(0.0, x) for x in (0.0, 1.0, 2.0, float("inf"), float("-inf"), float("nan"), None)]
    found = agg.class_histogram(spark.createDataFrame(rows, "Class double, x double"), ["x"], bins=2)
    assert sorted((r["bin"], r["n"]) for r in found.collect()) == [(0, 1), (1, 2)]
