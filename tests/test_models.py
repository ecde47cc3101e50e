"""Feature stages, training helpers and the search on small frames."""

from collections import Counter

import pytest
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasPredictionCol
from pyspark.sql import functions as F

from __spark_entry__ import queries
from rarefind.functions.hashing import unit_hash
from rarefind.operators import aggregate as agg
from rarefind.operators import features, sample, score, search, train
from rarefind.operators.scale import fit_moments
from rarefind.operators.skew import spread
from rarefind.plans import fixtures as fx
from rarefind.plans.queries import _same_scores
from rarefind.plans.reports import network_study
from rarefind.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return fx.txn(spark, sf_dir)


# ---- labels and indexes ----


def test_frequency_label_flips_but_pinned_does_not(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (0.0,)], "Class double")
    by_frequency = {r["Class"]: r["label"] for r in features.string_index_label(df).collect()}
    assert by_frequency == {1.0: 0.0, 0.0: 1.0}
    pinned = df.withColumn("label", features.pinned_label("Class"))
    assert all(r["Class"] == r["label"] for r in pinned.collect())


def test_frequency_tie_goes_by_text(spark):
    df = spark.createDataFrame([("b",), ("a",)], "Class string")
    assert {r["Class"]: r["label"] for r in features.string_index_label(df).collect()} == {"a": 0.0, "b": 1.0}


def test_zero_is_coded_first(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 2, 3, 5, 7)], "x double")
    out = features.vector_index(features.assemble(df, ["x"]))
    codes = {r[0]: r[1] for r in out.select("x", vector_to_array("features")[0]).collect()}
    assert codes == {0.0: 0.0, -1.0: 1.0, 2.0: 2.0, 3.0: 3.0, 5.0: 4.0, 7.0: 5.0}


def test_unseen_category_is_kept(spark):
    seen = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, Class double")
    new = spark.createDataFrame([(9.0, 1.0)], "x double, Class double")
    model = features.feature_pipeline(["x"], None).fit(seen)
    assert model.transform(new).select(vector_to_array("features")[0]).first()[0] == 2.0


def test_feature_columns_leave_out_keys(lines):
    assert features.feature_columns(lines, [*fx.ROW_KEYS, "Class"]) == fx.FEATURES


# ---- scoring ----


def test_argmax_takes_the_first_of_a_tie(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.1, 0.9],)], "p array<double>")
    assert [r[0] for r in df.select(score.argmax_prediction(F.col("p"))).collect()] == [0, 1]


def test_linear_threshold_is_strict(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0)], "x double, Class double")
    out = score.score_linear(df, {"x": 1.0}, intercept=-1.0)
    assert [tuple(r) for r in out.collect()] == [(0.0, 0.0), (1.0, 1.0)]


# ---- training helpers ----


def test_published_grids(spark):
    forest, boosting = train.random_forest(spark), train.gradient_boosted_trees(spark)
    assert len(train.param_grid(forest, train.FOREST_GRID)) == 72
    assert len(train.param_grid(boosting, train.BOOSTING_GRID)) == 108
    assert len(train.param_grid(boosting, train.BOOSTING_GRID_SMALL)) == 72
    assert len(train.param_grid(forest, train.FOREST_GRID_SMALL)) == 1


def test_boosting_stops_early_on_validation_rows(spark, lines):
    rows = sample.undersample_negatives(lines, 0.1, fx.HASH_KEYS)
    rows = sample.add_random_column(rows, fx.HASH_KEYS).withColumn("held", F.col("_rand") < 0.3)
    boosting = train.gradient_boosted_trees(
        spark, maxIter=12, maxDepth=3, validationIndicatorCol="held", validationTol=0.5
    )
    model = features.feature_pipeline(fx.FEATURES, boosting).fit(rows)
    assert model.stages[-1].getNumTrees < 12


def test_repeat_by_very_large_weights(spark):
    df = spark.createDataFrame([(1.0, 3e9)], "label double, weight double")
    with pytest.MonkeyPatch.context() as patch:
        seen = []
        patch.setattr(train, "spread", lambda rows, n: seen.append(n) or rows)
        patch.setattr(train, "repeat_rows", lambda rows, times: rows)
        assert train.repeat_by_weight(df, "weight").first()["_times"] == 3_000_000_000
        assert seen == [3_000_000_000]
    many = spark.createDataFrame([(1.0, 1e6)], "label double, weight double")
    copies = train.repeat_by_weight(many, "weight")
    assert copies.count() == 1_000_000
    sizes = copies.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 500_000


def test_repeat_by_weight(spark):
    df = spark.createDataFrame([("a", 2.6), ("b", 1.0), ("c", 0.2)], "v string, weight double")
    out = train.repeat_by_weight(df, "weight")
    assert out.columns == ["v"]
    assert Counter(r["v"] for r in out.collect()) == {"a": 3, "b": 1}
    assert out.rdd.getNumPartitions() == 1


def test_training_partitions_follow_the_rows(spark):
    df, cores = spark.range(10), spark.sparkContext.defaultParallelism
    for rows, partitions in [(0, 1), (12_000, 3), (10**6, cores), (10**9, 2000)]:
        assert spread(df, rows).rdd.getNumPartitions() == partitions


class _Scripted:
    """Stands in for the network: round i reaches the i-th accuracy of a script."""

    def __init__(self, script):
        self.script, self.seen = list(script), []
        self.maxIter, self.initialWeights = "maxIter", "initialWeights"

    def copy(self, extra):
        self.seen.append(extra)
        return self

    def fit(self, df):
        reached = self.script.pop(0)

        class Model:
            weights = ("weights after", reached)
            accuracy = reached

            def transform(self, df):
                hits = round(reached * 1000)
                return df.sparkSession.range(1000).select(
                    F.lit(1.0).alias("label"), F.when(F.col("id") < hits, 1.0).otherwise(0.0).alias("prediction")
                )

        return Model()


def pairs_of(spark):
    return spark.createDataFrame([(1.0, 1.0)], "label double, features double")


@pytest.fixture()
def pairs(spark):
    return pairs_of(spark)


def test_early_stopping_keeps_the_best_round(pairs):
    script = _Scripted([0.5, 0.99, 0.997, 0.996, 0.996, 0.995, 0.999])
    out = train.train_until_no_gain(pairs, pairs, script, patience=3, min_rounds=1)
    assert out.best_round == 2 and out.model.accuracy == 0.997
    assert len(out.history) == 6
    assert {"initialWeights": ("weights after", 0.5)} in script.seen


def test_early_stopping_waits_and_needs_the_floor(pairs):
    out = train.train_until_no_gain(
        pairs, pairs, _Scripted([0.9, 0.8, 0.7, 0.6, 0.5]), patience=2, min_rounds=2, max_rounds=5
    )
    assert len(out.history) == 5 and out.model is None


def test_equal_to_best_resets_the_count(pairs):
    out = train.train_until_no_gain(
        pairs, pairs, _Scripted([0.9, 0.8, 0.9, 0.8, 0.8]), patience=2, min_rounds=0, max_rounds=9
    )
    assert len(out.history) == 5


def test_the_query_trains_until_no_gain(spark, sf_dir, monkeypatch):
    """No number of rounds ends the query's training: the published rule does, which has not fired after eight."""
    seen = []

    def script(train_rows, validation, estimator, **stopping):
        stopping = {k: v for k, v in stopping.items() if k not in ("save_to", "before", "round_iters", "floor")}
        rounds = _Scripted([0.9 + r / 1000 for r in range(90)] + [0.5] * 30)
        seen.append(len(early_stop(pairs_of(spark), pairs_of(spark), rounds, **stopping).history))
        raise KeyboardInterrupt

    early_stop = train.train_until_no_gain
    monkeypatch.setattr("rarefind.plans.reports.train_until_no_gain", script)
    with pytest.raises(KeyboardInterrupt):
        queries()["train_until_no_gain"](spark, sf_dir)
    assert seen == [90 + train.PUBLISHED_PATIENCE]


def test_network_study_saves_the_kept_model(lines, tmp_path):
    path = str(tmp_path / "network")
    study = network_study(
        lines, fx.ROW_KEYS, [("l_quantity", ">", 45.0)], save_to=path,
        round_iters=10, max_rounds=2, floor=0.5,
    )
    kept = load_model(path)
    assert kept.stages[-1].weights == study.training.model.weights
    again = kept.transform(lines.withColumn("l_quantity_", (F.col("l_quantity") > 45).cast("int")))
    ours = study.pipeline.transform(lines.withColumn("l_quantity_", (F.col("l_quantity") > 45).cast("int")))
    columns = [*fx.ROW_KEYS, "prediction"]
    assert sorted(again.select(*columns).collect()) == sorted(ours.select(*columns).collect())
    assert len(study.training.report) == len(study.training.history)
    single = str(tmp_path / "single")
    save_model(study.training.model, single)
    assert isinstance(load_model(single), MultilayerPerceptronClassificationModel)
    # 85 and 5,915 rows per class leave 17 + 1,183 outside the sample; half of those is the test set.
    assert study.scored.count() == 600


def test_every_stage_of_the_loaded_network_is_compared(lines, tmp_path):
    path = str(tmp_path / "network")
    study = network_study(lines, fx.ROW_KEYS, save_to=path, round_iters=10, max_rounds=1, floor=0.0)
    loaded = load_model(path)

    def same(other):
        return {r["same_scores"] for r in _same_scores(study.pipeline, other, lines).collect()}

    assert same(loaded) == {True}
    # The network alone is the kept one, the stages in front of it are those of another table.
    doubled = lines.withColumn("l_quantity", F.col("l_quantity") * 2)
    moments = fit_moments(doubled, fx.FEATURES).stage()
    assert same(PipelineModel(stages=[moments, *loaded.stages[1:]])) == {False}


# ---- the search ----


class RuleModel(Model, HasPredictionCol):
    def __init__(self, cut):
        super().__init__()
        self.cut = cut

    def copy(self, extra=None):
        out = RuleModel(self.cut)
        self._copyValues(out, extra)
        return out

    def _transform(self, df):
        above = vector_to_array("features")[0] >= self.cut
        return df.withColumn(self.getPredictionCol(), F.when(above, 1.0).otherwise(0.0))


class RuleEstimator(Estimator, HasPredictionCol):
    """Says 1 above the cut, or above the mean of the training negatives plus the cut."""

    cut = Param(Params._dummy(), "cut", "cut", TypeConverters.toFloat)
    learn = Param(Params._dummy(), "learn", "learn", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, cut=0.0, learn=False):
        super().__init__()
        self._setDefault(cut=0.0, learn=False)
        self._set(**self._input_kwargs)

    def _fit(self, df):
        cut = self.getOrDefault(self.cut)
        if self.getOrDefault(self.learn):
            cut += df.filter("label = 0").agg(F.avg(vector_to_array("features")[0])).first()[0]
        return RuleModel(cut)


def test_search_counts_equal_direct_counts(spark, lines):
    """Fixed rules need no training, so every trial's counts can be found by a plain filter."""
    cuts = [30.0, 46.0, 49.0]
    rule = RuleEstimator()
    found = search.tune_imbalanced(
        lines, rule, [{rule.cut: c} for c in cuts], [0.3, 0.6], 3,
        keys=fx.HASH_KEYS, features=fx.FEATURES, models_per_pass=4,
    )
    folded = sample.assign_folds(lines, 3, fx.HASH_KEYS)
    for r in found.trials.collect():
        said = F.col("l_quantity") >= cuts[r["grid_id"]]
        direct = folded.filter(F.col("fold") == r["fold"]).agg(
            F.count_if(said & (F.col("Class") == 1)),
            F.count_if(said & (F.col("Class") == 0)),
            F.count_if(~said & (F.col("Class") == 1)),
        ).first()
        assert (r["tp"], r["fp"], r["fn"]) == tuple(direct)
    assert found.trials.count() == 18
    assert found.param_map[rule.cut] == 46.0 and found.rate == 0.3
    scored = features.score(found.model, lines)
    assert scored.filter("label = 1 and prediction = 0").count() == 0


def test_rates_give_different_metrics(spark, lines):
    rule = RuleEstimator(learn=True)
    found = search.tune_imbalanced(
        lines, rule, [{rule.cut: 20.0}], [0.02, 0.9], 2, keys=fx.HASH_KEYS, features=fx.FEATURES
    )
    sums = [r["metric"] for r in agg.sum_fold_metrics(found.trials).collect()]
    assert len(set(sums)) == 2


def test_search_trains_without_the_validation_fold(spark, lines):
    sizes = []

    class Watching(RuleEstimator):
        def _fit(self, df):
            sizes.append((df.filter("label = 1").count(), df.filter("label = 0").count()))
            return RuleModel(46.0)

    watching = Watching()
    search.tune_imbalanced(
        lines, watching, [{}], [0.5], 2, keys=fx.HASH_KEYS, features=fx.FEATURES, parallelism=1
    )
    drawn = sample.undersample_negatives(sample.assign_folds(lines, 2, fx.HASH_KEYS), 0.5, fx.HASH_KEYS)
    expected = [
        tuple(
            drawn.filter(F.col("fold") != i)
            .agg(F.count_if(F.col("Class") == 1), F.count_if(F.col("Class") == 0))
            .first()
        )
        for i in range(2)
    ]
    everything = tuple(drawn.agg(F.count_if(F.col("Class") == 1), F.count_if(F.col("Class") == 0)).first())
    assert sizes == [*expected, everything]


def test_rule_trials_weigh_the_sampled_negatives(lines):
    rows = sample.assign_folds(lines.withColumn("label", F.col("Class")), 2, fx.HASH_KEYS)
    u = unit_hash(fx.HASH_KEYS, sample.UNDERSAMPLE_SALT)
    full = search.rule_trials(rows, [fx.rule()], [1.0], u)
    plain = agg.sum_fold_metrics(full).first()["metric"] / 2
    sampled = agg.sum_fold_metrics(search.rule_trials(rows, [fx.rule()], [0.5], u)).first()["metric"] / 2
    assert sampled == pytest.approx(plain, abs=0.1)


def test_saved_pipeline_scores_the_same(spark, lines, tmp_path):
    forest = train.random_forest(spark, maxDepth=3, numTrees=3)
    model = features.feature_pipeline(fx.FEATURES, forest, positive=None).fit(lines)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    columns = ["label", "prediction", "probability"]
    assert Counter(map(str, model.transform(lines).select(*columns).collect())) == Counter(
        map(str, again.transform(lines).select(*columns).collect())
    )


# ---- how often the source is read ----


def _counted(spark):
    """Rows with a rare class, and a counter that goes up whenever their one partition is read."""
    reads = spark.sparkContext.accumulator(0)

    def opened(rows):
        reads.add(1)
        return rows

    values = [(i, float(i % 7), float(i % 50), float(i % 50 > 45)) for i in range(600)]
    rows = spark.sparkContext.parallelize(values, 1).mapPartitions(opened)
    return spark.createDataFrame(rows, "id bigint, a double, b double, Class double"), reads


def test_a_fit_reads_the_source_twice(spark):
    rows, reads = _counted(spark)
    forest = train.random_forest(spark, maxDepth=3, numTrees=3)
    model = train.fit_stored(features.feature_pipeline(["a", "b"], forest), rows, partitions=2)
    assert reads.value <= 2
    assert model.transform(rows).filter("prediction = label").count() > 500


def test_a_search_reads_the_source_three_times(spark):
    rows, reads = _counted(spark)
    forest = train.random_forest(spark, numTrees=2)
    grid = train.param_grid(forest, {"maxDepth": [1, 3]})
    found = search.tune_imbalanced(
        rows, forest, grid, [0.5, 0.8], 3, keys=["id"], features=["a", "b"], models_per_pass=2
    )
    assert reads.value <= 3
    assert found.trials.count() == 12


def test_forests_hold_few_numbers_for_each_task(spark):
    """Bagging takes a number for each row and tree: with many trees partitions get smaller, and no ids are cached beside."""
    forest = train.random_forest(spark, numTrees=100)
    assert not forest.getCacheNodeIds() and not train.gradient_boosted_trees(spark).getCacheNodeIds()
    assert train.bagged_trees(forest) == 100
    assert train.bagged_trees(forest, train.param_grid(forest, {"numTrees": [2, 7]})) == 7
    assert train.bagged_trees(train.gradient_boosted_trees(spark, maxIter=50)) == 1
    rows = spark.range(10)
    assert spread(rows, 2_000_000, 100).rdd.getNumPartitions() == 20
    assert spread(rows, 2_000_000, 1000).rdd.getNumPartitions() == 200
