"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from rarefind.operators import aggregate as agg
from rarefind.operators import project, sample
from rarefind.operators.search import rule_trials
from rarefind.plans import fixtures as fx
from rarefind.plans.queries import REGISTRY

FITTED = {
    name for name, sql in oracle_sql().items()
    if re.search(r"quality_ok|same_scores|predictions_ok|report_ok", sql)
}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - FITTED))
def test_rows_stay_in_the_engine(spark, sf_dir, name):
    plan = _plan(queries()[name](spark, sf_dir))
    for bad in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_filters_on_stored_columns_reach_the_scan(spark, sf_dir):
    labels, lines = fx.table(spark, sf_dir, "labels"), fx.table(spark, sf_dir, "lineitem")
    assert "EqualTo(toxic,1)" in _plan(project.filter_class(labels, "toxic", 1))
    plan = _plan(project.range_filter(lines, "l_discount", 0.02, 0.05))
    assert "GreaterThanOrEqual(l_discount,0.02)" in plan and "LessThan(l_discount,0.05)" in plan


def test_drawing_rows_moves_none(spark, sf_dir):
    lines = fx.txn(spark, sf_dir)
    drawn = [
        *sample.random_split(lines, fx.HASH_KEYS),
        sample.undersample_negatives(lines, 0.2, fx.HASH_KEYS),
        sample.assign_folds(lines, 5, fx.HASH_KEYS),
        *sample.half_split(lines, fx.ROW_KEYS),
    ]
    for df in drawn:
        plan = _plan(df)
        assert "Exchange" not in plan
        assert plan.startswith("*(1) ")
    for df in sample.exact_fraction_sample(lines, 0.8, fx.ROW_KEYS):
        # Cuts per class are joined; a few rows, so they are broadcast and the table itself stays.
        assert "BroadcastHashJoin" in _plan(df) and "Exchange hashpartitioning" not in _plan(df)


def test_counting_reads_only_what_it_counts(spark, sf_dir):
    plan = _plan(agg.class_counts(fx.doc_labels(spark, sf_dir).select("toxic"), "toxic"))
    assert "text" not in plan
    trials = rule_trials(
        sample.assign_folds(fx.txn(spark, sf_dir).withColumn("label", F.col("Class")), 3, fx.HASH_KEYS),
        [fx.rule()],
        [0.5],
        F.lit(0.1),
    )
    scan = re.search(r"ReadSchema: struct<([^>]*)>", _plan(trials)).group(1)
    assert {c.split(":")[0] for c in scan.split(",")} == {
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount",
    }


def test_many_trials_are_one_scan_and_two_small_shuffles(spark, sf_dir):
    plan = _plan(queries()["trial_metrics"](spark, sf_dir))
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange") == 2
