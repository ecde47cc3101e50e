"""Splits and samples: exactness, partition, repeatability, and keys that hold many rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rarefind.operators import sample, skew
from rarefind.operators.sample import _find_cuts
from rarefind.plans import fixtures as fx


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return fx.txn(spark, sf_dir)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of all rows, half of those plain copies of each other; one null key."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 100).alias("k"),
        F.when(F.col("id") % 6 == 0, 1).otherwise(F.col("id")).alias("v"),
        (F.col("id") % 2).cast("double").alias("Class"),
    )
    missing = rows.limit(1).select(F.lit(None).cast("bigint").alias("k"), "v", "Class")
    return rows.unionByName(missing)


def test_survey_split_counts(spark):
    scored = fx.txn(spark, "/root/testdata/sf0.01").withColumn(
        "prediction", F.when(fx.rule(), 1).otherwise(0)
    )
    _, test = sample.random_split(scored, fx.HASH_KEYS)
    found = {(r[0], r[1]): r[2] for r in test.groupBy("Class", "prediction").count().collect()}
    assert found == {(0.0, 0): 23358, (0.0, 1): 251, (1.0, 1): 370}


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_does_not_depend_on_layout(lines, partitions):
    train, _ = sample.random_split(lines, fx.HASH_KEYS)
    again, _ = sample.random_split(lines.repartition(partitions), fx.HASH_KEYS)
    assert _rows(train) == _rows(again)


def test_split_and_folds_partition_the_rows(lines):
    train, test = sample.random_split(lines, fx.HASH_KEYS)
    assert _rows(train) + _rows(test) == _rows(lines)
    folds = sample.assign_folds(lines, 5, fx.HASH_KEYS)
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert set(sizes) == set(range(5)) and sum(sizes.values()) == lines.count()


def test_undersampling_keeps_positives_and_is_nested(lines):
    low = sample.undersample_negatives(lines, 0.1, fx.HASH_KEYS)
    high = sample.undersample_negatives(lines, 0.4, fx.HASH_KEYS)
    assert low.filter("Class = 1").count() == lines.filter("Class = 1").count()
    assert not _rows(low) - _rows(high)


def test_missing_stratum_is_dropped(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0)], "k int, Class double")
    kept = sample.undersample_negatives(df, 1.0, ["k"])
    assert {r["Class"] for r in kept.collect()} == {0.0, 1.0}
    native = sample.undersample_negatives(df, 1.0, None)
    assert {r["Class"] for r in native.collect()} == {0.0, 1.0}


def test_without_keys_spark_draws(lines):
    train, test = sample.random_split(lines, None)
    assert train.count() + test.count() == lines.count()
    drawn = sample.add_random_column(lines, None).agg(F.min("_rand"), F.max("_rand")).first()
    assert 0 <= drawn[0] < drawn[1] < 1


@pytest.mark.parametrize("fraction", [0.0, 0.25, 0.5, 0.8, 1.0])
def test_exact_sample_on_heavy_key(skewed, fraction):
    taken, rest = sample.exact_fraction_sample(skewed, fraction, ["k"])
    assert _rows(taken) + _rows(rest) == _rows(skewed)
    sizes = {r["Class"]: r["count"] for r in skewed.groupBy("Class").count().collect()}
    found = {r["Class"]: r["count"] for r in taken.groupBy("Class").count().collect()}
    assert found == {c: round(fraction * n) for c, n in sizes.items() if round(fraction * n)}


def test_exact_sample_cuts_inside_copies(spark):
    copies = spark.range(1001).select(F.lit(1).alias("k"), F.lit("x").alias("v"))
    taken, rest = sample.exact_split(copies, ["k"], F.floor(F.col("_total") * 0.3))
    assert (taken.count(), rest.count()) == (300, 701)


def test_half_split_sizes(skewed):
    first, second = sample.half_split(skewed, ["k"])
    assert (first.count(), second.count()) == (1500, 1501)
    assert _rows(first) + _rows(second) == _rows(skewed)


def test_cut_search_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(sample, "_SMALL_BUCKET", 0)
    hashed = spark.range(20_000).select(
        (F.col("id") % 2).alias("_group"),
        F.pmod(F.xxhash64("id"), F.lit(1 << 24)).alias("_hash"),
    )
    cuts = _find_cuts(hashed, F.floor(F.col("_total") * 0.37))
    for cut in cuts.collect():
        values = [r["_hash"] for r in hashed.filter(F.col("_group") == cut["_cut_group"]).collect()]
        assert sum(v < cut["_limit"] for v in values) + cut["_tied"] == 3700


def test_exact_sample_of_very_many_classes(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 5000).alias("Class"))
    taken, rest = sample.exact_fraction_sample(rows, 0.5, ["id"])
    assert taken.groupBy("Class").count().select("count").distinct().collect() == [(2,)]
    assert rest.count() == 10_000


def test_remainder_is_the_rest(skewed):
    taken = skewed.filter("k is null or k = 7 or k % 5 = 0")
    expected = _rows(skewed.filter("not (k is null or k = 7 or k % 5 = 0)"))
    assert _rows(sample.remainder_rows(skewed, taken, ["k"])) == expected
    kept = _rows(sample.remainder_rows(skewed, taken.filter("k != 7"), ["k"]))
    assert sum(n for row, n in kept.items() if row[0] == 7) == 1000


def test_remainder_splits_a_heavy_key(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        # Keys of their own for half of the rows; one key for the other half.
        key = F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id"))
        rows = spark.range(0, 200_000, numPartitions=16).select(key.alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
        left = sample.remainder_rows(rows, rows.filter("k BETWEEN 1 AND 999"), ["k"])
        assert len(left.collect()) == 200_000 - 500
        assert "skew=true" in left._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_remainder_shuffles_each_side_once(lines, spark):
    taken = lines.filter("Class = 1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = sample.remainder_rows(lines, taken, fx.ROW_KEYS)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("Exchange hashpartitioning") == 3
    assert "SortMergeJoin" in physical


def test_shuffle_order_depends_on_the_key_alone(skewed):
    plain = sample.shuffle_rows(skewed.filter("k IS NULL OR k != 7"), ["k"])
    more = sample.shuffle_rows(skewed, ["k"])
    assert _rows(more.drop("_order")) == _rows(skewed)
    assert _rows(more.filter("k IS NULL OR k != 7")) == _rows(plain)
    assert more.filter("k = 7").select("_order").distinct().count() == 1
    orders = [r["_order"] for r in more.collect()]
    assert orders == sorted(orders)


def test_shuffle_spreads_a_heavy_key(spark):
    rows = spark.range(0, 100_000).select(F.lit(1).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sample.shuffle_rows(rows, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 50_000


def test_repeat_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "_CHUNK", 3)
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 0)], "v string, n bigint")
    out = skew.repeat_rows(df, "n", "i")
    assert sorted((r["v"], r["i"]) for r in out.collect()) == [("a", i) for i in range(7)] + [("b", 0)]
    assert skew.repeat_rows(df, "n").columns == ["v"]
