"""Self-stopping boosting, the search's parts in Spark's cross-validation, and kept models that switch at once."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from rarefind.functions.hashing import unit_hash
from rarefind.operators import features, sample, search, train
from rarefind.operators.tuning import CorrectedF1Evaluator, UndersampledEstimator
from rarefind.plans import fixtures as fx
from rarefind.sources import models
from rarefind.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    """Labels that features tell only in part, so that later trees start to fit noise."""
    rows = fx.txn(spark, sf_dir)
    noisy = (F.col("l_quantity") + 30 * unit_hash(fx.HASH_KEYS, "noise:") > 40).cast("double")
    ready = features.assemble(rows, fx.FEATURES, "features").withColumn("label", noisy)
    marked = ready.withColumn("held_out", train.held_out(fx.HASH_KEYS, 0.3))
    return marked.select("label", "features", "held_out").repartition(1).persist()


def test_held_out_rows_are_a_share_of_every_fold(spark, sf_dir):
    rows = sample.assign_folds(fx.txn(spark, sf_dir), 3, fx.HASH_KEYS)
    shares = rows.groupBy("fold").agg(F.avg(train.held_out(fx.HASH_KEYS, 0.3).cast("int")).alias("s")).collect()
    assert len(shares) == 3 and all(abs(r["s"] - 0.3) < 0.05 for r in shares)


@pytest.mark.parametrize("step", [0.8, 1.0])
def test_number_of_trees_is_that_of_a_plain_evaluation(spark, vectors, step):
    settings = dict(maxDepth=5, stepSize=step, maxIter=12)
    stopped = train.self_stopping_trees(spark, **settings).fit(vectors)
    whole = train.gradient_boosted_trees(spark, **settings).fit(vectors.filter("NOT held_out"))
    losses = whole.evaluateEachIteration(vectors.filter("held_out"))
    gains = [after < before for before, after in zip(losses, losses[1:])]
    expected = gains.index(False) + 1 if False in gains else len(losses)
    assert stopped.getNumTrees == expected < 12
    assert stopped.treeWeights == whole.treeWeights[:expected]


def test_search_gives_the_estimator_its_held_out_rows(spark, sf_dir):
    trees = train.self_stopping_trees(spark, maxDepth=3, maxIter=4, stepSize=0.5)
    found = search.tune_imbalanced(
        fx.txn(spark, sf_dir), trees, [{trees.maxDepth: 2}, {}], [0.5], 2, keys=fx.HASH_KEYS, features=fx.FEATURES
    )
    assert found.trials.count() == 4
    assert 1 <= found.model.stages[-1].getNumTrees <= 4


def test_cross_validator_chooses_what_the_search_chooses(spark, sf_dir):
    rows = fx.txn(spark, sf_dir)
    forest = train.random_forest(spark, numTrees=1)
    rates, depths = [0.05, 0.8], [1, 3, 6]
    found = search.tune_imbalanced(
        rows, forest, train.param_grid(forest, {"maxDepth": depths}), rates, 3, keys=fx.HASH_KEYS, features=fx.FEATURES
    )
    drawn = sample.undersample_negatives(rows, max(rates), fx.HASH_KEYS)
    to_vector = features.feature_pipeline(fx.FEATURES, None, None, None).fit(drawn.select(*fx.FEATURES))
    ready = to_vector.transform(sample.assign_folds(rows, 3, fx.HASH_KEYS)).withColumn("label", F.col("Class"))
    under = UndersampledEstimator(forest, fx.HASH_KEYS)
    grid = ParamGridBuilder().addGrid(under.rate, rates).addGrid(forest.maxDepth, depths).build()
    judge = CorrectedF1Evaluator()
    validator = CrossValidator(estimator=under, estimatorParamMaps=grid, evaluator=judge, numFolds=3, foldCol="fold")
    fitted = validator.fit(ready.select("label", "features", "fold", *fx.HASH_KEYS))
    sums = {
        (r["rate"], depths[r["grid_id"]]): r["metric"]
        for r in found.trials.groupBy("rate", "grid_id").agg(F.sum("metric").alias("metric")).collect()
    }
    for trial, mean in zip(grid, fitted.avgMetrics):
        assert mean == pytest.approx(sums[trial[under.rate], trial[forest.maxDepth]] / 3)
    best = grid[max(range(len(grid)), key=fitted.avgMetrics.__getitem__)]
    assert best[under.rate] == found.rate and best[forest.maxDepth] == found.param_map[forest.maxDepth]
    assert fitted.bestModel.getOrDefault("maxDepth") == best[forest.maxDepth]


def test_parts_are_saved_and_loaded(spark, tmp_path):
    under = UndersampledEstimator(train.random_forest(spark, maxDepth=7), ["a", "b"], rate=0.25, labelCol="y")
    under.save(str(tmp_path / "under"))
    back = UndersampledEstimator.load(str(tmp_path / "under"))
    assert (back.uid, back.getRate(), back.getOrDefault("keys"), back.getLabelCol()) == (under.uid, 0.25, ["a", "b"], "y")
    assert back.getEstimator().getMaxDepth() == 7
    judge = CorrectedF1Evaluator(fpScale=4.0, labelCol="y")
    judge.save(str(tmp_path / "judge"))
    back = CorrectedF1Evaluator.load(str(tmp_path / "judge"))
    rows = spark.createDataFrame([(1, 1.0)] * 3 + [(0, 1.0)] + [(1, 0.0)] + [(2, 1.0)], "y int, prediction double")
    assert back.evaluate(rows) == judge.evaluate(rows) == pytest.approx(2 / (4 / 3 + (0.75 + 0.25 * 4) / 0.75))
    assert back.evaluate(rows.limit(0)) == 0.0


def test_a_save_that_fails_leaves_the_old_model(spark, vectors, tmp_path, monkeypatch):
    path = str(tmp_path / "kept")
    first, second = (train.linear_svm(maxIter=n).fit(vectors) for n in (1, 5))
    save_model(PipelineModel(stages=[first]), path)

    class Broken:
        def write(self):
            raise OSError("no space")

    with pytest.raises(OSError):
        save_model(Broken(), path)
    with monkeypatch.context() as patch:
        patch.setattr(models, "_switch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            save_model(second, path)
    assert load_model(path).stages[-1].coefficients == first.coefficients
    save_model(second, path)
    assert load_model(path).coefficients == second.coefficients
    plain = str(tmp_path / "plain")
    second.write().save(plain)
    assert load_model(plain).coefficients == second.coefficients


def test_training_goes_on_from_the_last_whole_round(spark, vectors, tmp_path):
    rows = vectors.select("label", "features")
    network = train.multilayer_perceptron(len(fx.FEATURES), layers=[len(fx.FEATURES), 4, 2])
    settings = dict(round_iters=3, patience=2, min_rounds=1, floor=0.0)
    straight = train.train_until_no_gain(rows, rows, network, max_rounds=4, **settings)
    folder = str(tmp_path / "rounds")
    cut = train.train_until_no_gain(rows, rows, network, max_rounds=2, resume_from=folder, **settings)
    assert cut.history == straight.history[:2]
    (tmp_path / "rounds" / "round-000002").mkdir()  # a round whose writing did not end
    resumed = train.train_until_no_gain(rows, rows, network, max_rounds=4, resume_from=folder, **settings)
    again = train.train_until_no_gain(rows, rows, network, max_rounds=4, resume_from=folder, **settings)
    for result in (resumed, again):
        assert result.history == straight.history and result.report == straight.report
        assert result.best_round == straight.best_round
        assert result.model.weights == straight.model.weights
