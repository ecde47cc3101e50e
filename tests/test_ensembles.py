"""Ensembles cut to their first trees, and trials packed into words."""

import random

import pytest
from pyspark.ml.classification import LinearSVC, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rarefind.operators import aggregate, search, train
from rarefind.operators.ensembles import by_largest, first_trees
from rarefind.plans import fixtures as fx


@pytest.fixture(scope="module")
def points(spark, sf_dir):
    rows = fx.txn(spark, sf_dir).withColumn("label", F.col("Class"))
    return VectorAssembler(inputCols=fx.FEATURES, outputCol="features").transform(rows).select("label", "features").coalesce(2).cache()


def _scores(model, df):
    raw = vector_to_array("rawPrediction")[1]
    return [tuple(r) for r in model.transform(df).select(raw, "prediction", vector_to_array("probability")[1]).collect()]


def test_a_prefix_of_boosting_is_the_shorter_fit(spark, points):
    boosting = train.gradient_boosted_trees(spark, maxDepth=3, stepSize=0.3)
    long = boosting.copy({boosting.maxIter: 7}).fit(points)
    short = boosting.copy({boosting.maxIter: 4}).fit(points)
    cut = first_trees(long, 4)
    assert cut.getNumTrees == 4 and first_trees(long, 9) is long
    assert _scores(cut, points) == _scores(short, points)


def test_a_prefix_of_a_forest_adds_up_its_trees(spark, points):
    forest = train.random_forest(spark, maxDepth=3, numTrees=5, predictionCol="said").fit(points)
    cut = first_trees(forest, 2)
    assert isinstance(cut, RandomForestClassificationModel) and cut.getPredictionCol() == "said"
    both = points
    for k, tree in enumerate(forest.trees[:2]):
        changes = {tree.probabilityCol: f"p{k}", tree.rawPredictionCol: "", tree.predictionCol: ""}
        both = tree.transform(both, changes)
    total = vector_to_array("p0")[1] + vector_to_array("p1")[1]
    rows = cut.transform(both).select(total.alias("t"), vector_to_array("rawPrediction")[1].alias("r")).collect()
    assert all(r["t"] == pytest.approx(r["r"], abs=1e-12) for r in rows) and len({r["r"] for r in rows}) >= 2
    with pytest.raises(ValueError):
        first_trees(forest, 0)


def test_maps_of_one_fit(spark):
    forest = train.random_forest(spark, numTrees=9)
    maps = train.param_grid(forest, {"maxDepth": [2, 3], "numTrees": [4, 12, 7]})
    groups = by_largest(forest, [*maps, {forest.maxDepth: 3}])
    assert sorted((sorted(size for _, size in members) for _, members in groups), key=len) == [[4, 7, 12], [4, 7, 9, 12]]
    assert all(largest[forest.numTrees] == 12 for largest, _ in groups)
    assert {j for _, members in groups for j, _ in members} == set(range(7))
    svm = LinearSVC()
    assert by_largest(svm, [{svm.regParam: 0.1}, {}]) == [({svm.regParam: 0.1}, [(0, None)]), ({}, [(1, None)])]


def test_published_grids_take_a_fit_for_each_shape(spark):
    """72 forest maps are 18 fits, 108 boosting maps 36."""
    forest, boosting = train.random_forest(spark), train.gradient_boosted_trees(spark)
    assert len(by_largest(forest, train.param_grid(forest, train.FOREST_GRID))) == 18
    assert len(by_largest(boosting, train.param_grid(boosting, train.BOOSTING_GRID))) == 36


def test_search_over_sizes_counts_like_single_fits(spark, sf_dir):
    """Every size of boosting gets the counts that a fit of its own gets."""
    rows = fx.txn(spark, sf_dir)
    boosting = train.gradient_boosted_trees(spark, maxDepth=2)
    maps = train.param_grid(boosting, {"maxIter": [1, 3], "stepSize": [0.1, 0.6]})
    options = dict(keys=fx.HASH_KEYS, features=fx.FEATURES)
    together = search.tune_imbalanced(rows, boosting, maps, [0.5], 2, **options)
    counted = {(r["grid_id"], r["fold"]): (r["tp"], r["fp"], r["fn"]) for r in together.trials.collect()}
    assert len(counted) == 8
    for j, one in enumerate(maps):
        alone = search.tune_imbalanced(rows, boosting, [one], [0.5], 2, **options)
        assert all(counted[j, r["fold"]] == (r["tp"], r["fp"], r["fn"]) for r in alone.trials.collect())


def test_unrelated_trials_make_few_groups(spark, monkeypatch):
    """Random predictions, nulls among them, over several passes: right counts, groups bounded by the words."""
    monkeypatch.setattr(aggregate, "TRIALS_PER_SCAN", 8)
    random.seed(2)
    n = 19
    rows = [(i % 3 if i % 50 else None, i % 2, *(random.choice([0, 1, None]) for _ in range(n))) for i in range(3000)]
    names = [f"p{k}" for k in range(n)]
    df = spark.createDataFrame(rows, "fold int, label int, " + ", ".join(f"{c} int" for c in names))
    predictions = {10 + k: F.col(c) for k, c in enumerate(names)}
    got = {(r["trial"], r["fold"]): (r["tp"], r["fp"], r["fn"]) for r in aggregate.fold_confusion(df, predictions, "fold").collect()}
    expected = {}
    for k in range(n):
        for fold in (None, 0, 1, 2):
            mine = [(r[1], r[2 + k]) for r in rows if r[0] == fold]
            expected[10 + k, fold] = tuple(mine.count(x) for x in ((1, 1), (0, 1), (1, 0)))
    assert got == expected
    words = df.select("fold", *names).repartition(4)
    groups = aggregate.packed_counts(words, ["fold"], [F.col(c) for c in names])
    assert groups.count() == 4 * n


def test_rule_trials_take_any_order_of_rates(spark, sf_dir):
    """Every rate by itself gives what all of them give together; rows without a sample number count if positive."""
    df = fx.txn(spark, sf_dir).withColumn("fold", F.lit(0)).withColumn("label", F.col("Class"))
    u = F.when(F.col("l_partkey") % 7 > 0, (F.col("l_partkey") % 100) / 100)
    rules = [F.col("l_quantity") > q for q in (10, 30, 46)]
    together = search.rule_trials(df, rules, [0.8, 0.2, 0.5], u).collect()
    assert len(together) == 9 and sorted(r["trial"] for r in together) == list(range(9))
    for k, rate in enumerate([0.8, 0.2, 0.5]):
        alone = {r["grid_id"]: tuple(r)[4:] for r in search.rule_trials(df, rules, [rate], u).collect()}
        assert alone == {r["grid_id"]: tuple(r)[4:] for r in together if r["trial"] // 3 == k}
        kept = df.filter((F.col("label") == 1) | (u < rate))
        direct = kept.agg(*[F.count_if(F.expr(f"l_quantity > 30 AND label = {c}")) for c in (1, 0)]).first()
        assert alone[1][:2] == tuple(direct)


def test_code_of_the_rule_grid_compiles(spark, sf_dir):
    """Plain Java code of every stage of the plan is generated and compiled."""
    from rarefind.plans.queries import REGISTRY

    plan = REGISTRY["rule_grid"](spark, sf_dir)._jdf.queryExecution()
    jvm = spark.sparkContext._jvm
    code = jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan.executedPlan())
    assert "Failed to compile" not in code
