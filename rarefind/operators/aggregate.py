"""Confusion counts, class counts and column statistics.

Groups are labels, predictions, trials or bins. Partial sums run before every shuffle, so a class
or a value that makes up most of the table reaches the shuffle as one row per task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarefind.functions.metrics import corrected_f1, f1
from rarefind.operators.quantiles import exact_quantiles, number_or_null

# Bins of the published histograms, features kept by the published selection.
PUBLISHED_BINS = 50
PUBLISHED_TOP_FEATURES = 30

#: Predictions packed into one word, two bits each, and predictions counted in one pass over a table.
TRIALS_PER_WORD = 4
TRIALS_PER_SCAN = 96


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def confusion_matrix(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Row count per (label, prediction)."""
    return scored.groupBy(label, prediction).agg(F.count("*").alias("n"))


def confusion_matrix_wide(
    scored: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    classes: Sequence[float] = (0.0, 1.0),
) -> DataFrame:
    """One row per true class, one column per predicted class, zeros included."""
    return (
        scored.groupBy(label)
        .agg(*[_count(F.col(prediction) == F.lit(c), f"predicted_{int(c)}") for c in classes])
    )


def confusion_counts(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """True positives, false positives and false negatives in one pass."""
    truth, said = F.col(label), F.col(prediction)
    return scored.agg(
        _count((said == 1) & (truth == 1), "tp"),
        _count((said == 1) & (truth == 0), "fp"),
        _count((said == 0) & (truth == 1), "fn"),
    )


def packed_counts(df: DataFrame, group: Sequence[str], predictions: Sequence[Column]) -> DataFrame:
    """How often each 0/1 prediction was 1, and was 0: columns (group, i, ones, zeros), a row for each group and i."""
    parts = packed_parts(df, group, predictions)
    return parts.groupBy(*group, "i").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def packed_parts(df: DataFrame, group: Sequence[str], predictions: Sequence[Column]) -> DataFrame:
    """Rows that add up to ``packed_counts``, for a caller that sums them with other things in one shuffle.

    A row's predictions are packed into words of ``TRIALS_PER_WORD``, two bits each, and words are counted. A word has at
    most 256 values, so there are at most 256 groups for each word and group, however many rows there are and however
    little the predictions have to do with each other. ``TRIALS_PER_SCAN`` bounds the code of one pass; more
    predictions take more passes. Null predictions count as neither.
    """
    bits = 2 * TRIALS_PER_WORD

    def word(some: Sequence[Column]) -> Column:
        value = F.lit(0)
        for k, p in enumerate(some):
            value = value + F.when(p == 1, 1 << 2 * k).when(p == 0, 2 << 2 * k).otherwise(0)
        return value.cast("smallint")

    parts = []
    for at in range(0, len(predictions), TRIALS_PER_SCAN):
        some = predictions[at : at + TRIALS_PER_SCAN]
        words = [word(some[k : k + TRIALS_PER_WORD]) for k in range(0, len(some), TRIALS_PER_WORD)]
        each = df.select(*group, F.posexplode(F.array(*words)).alias("_w", "_word"))
        counted = each.groupBy(*group, "_w", "_word").agg(F.count("*").alias("_n"))
        parts.append(counted.withColumn("_w", F.col("_w") + at // TRIALS_PER_WORD))
    kinds = reduce(DataFrame.unionByName, parts)
    places = F.explode(F.array(*[F.lit(k) for k in range(0, bits, 2)])).alias("_at")
    single = kinds.select(*group, "_w", "_n", "_word", places)
    said = F.expr("shiftright(CAST(_word AS int), _at)").bitwiseAND(F.lit(3))
    i = F.col("_w") * TRIALS_PER_WORD + F.col("_at") / 2
    return single.select(
        *group,
        i.cast("int").alias("i"),
        F.when(said == 1, F.col("_n")).otherwise(0).alias("ones"),
        F.when(said == 2, F.col("_n")).otherwise(0).alias("zeros"),
    ).filter(F.col("i") < len(predictions))


def fold_confusion(
    scored: DataFrame, predictions: dict[int, Column], fold: str, label: str = "label"
) -> DataFrame:
    """tp, fp and fn of many trials: columns (trial, fold, tp, fp, fn).

    ``predictions`` maps a trial's number to its 0/1 prediction, null where a row does not count for it. See
    ``packed_counts`` for how often the table is read.
    """
    truth = scored.withColumn("_truth", F.col(label))
    counts = packed_parts(truth, [fold, "_truth"], list(predictions.values()))
    trial = F.get(F.array(*[F.lit(t) for t in predictions]), F.col("i"))

    def total(condition: Column, count: str, name: str) -> Column:
        return F.sum(F.when(condition, F.col(count)).otherwise(0)).alias(name)

    is_true, is_false = F.col("_truth") == 1, F.col("_truth") == 0
    return (
        counts.groupBy("i", fold)
        .agg(total(is_true, "ones", "tp"), total(is_false, "ones", "fp"), total(is_true, "zeros", "fn"))
        .select(trial.alias("trial"), fold, "tp", "fp", "fn")
    )


def corrected_f1_score(counts: DataFrame, fp_scale: float | Column = 1.0) -> DataFrame:
    """Add ``metric`` to rows with tp, fp and fn."""
    return counts.withColumn(
        "metric", corrected_f1(F.col("tp"), F.col("fp"), F.col("fn"), fp_scale)
    )


def sum_fold_metrics(trials: DataFrame) -> DataFrame:
    """Metric summed over the folds of each (rate, grid_id)."""
    return trials.groupBy("rate", "grid_id").agg(F.sum("metric").alias("metric"))


def best_trial(summed: DataFrame) -> DataFrame:
    """The trial with the largest metric; the first in (rate position, grid) order wins a tie."""
    return summed.orderBy(F.desc("metric"), F.asc("trial")).limit(1)


def f1_by_class(
    scored: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """F1 with each class in turn as the one to find: columns (class, f1)."""
    truth, said = F.col(label), F.col(prediction)
    counts = scored.agg(
        _count((truth == 1) & (said == 1), "both"),
        _count((truth == 1) & (said == 0), "missed"),
        _count((truth == 0) & (said == 1), "wrong"),
        _count((truth == 0) & (said == 0), "neither"),
    )
    both, missed, wrong, neither = (F.col(c) for c in ("both", "missed", "wrong", "neither"))
    return counts.select(
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("class"), f1(both, wrong, missed).alias("f1")),
                F.struct(F.lit(0.0).alias("class"), f1(neither, missed, wrong).alias("f1")),
            )
        )
    )


def accuracy(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = (F.col(prediction) == F.col(label)).cast("double")
    return scored.agg(F.avg(hit).alias("accuracy"))


def weighted_cross_entropy(
    scored: DataFrame, probability_of_truth: Column, weight: Column, eps: float = 1e-12
) -> DataFrame:
    """Sum of -weight * ln(p), where p is the probability given to the true class, at least eps."""
    loss = -weight * F.ln(F.greatest(probability_of_truth, F.lit(eps)))
    return scored.agg(F.sum(loss).alias("loss"))


def class_counts(df: DataFrame, label: str = "Class") -> DataFrame:
    """Row count per class."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum: one row per column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    aggregates = []
    for i, c in enumerate(columns):
        x = number_or_null(c)
        aggregates.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                *[
                    F.lit(quartiles[c][k]).cast("double").alias(name)
                    for k, name in enumerate(("p25", "p50", "p75"))
                ],
                F.max(x).alias("max"),
            ).alias(f"s{i}")
        )
    return df.agg(*aggregates).select(
        F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))]))
    )


def _finite_or_null(column: str) -> Column:
    """NaN and infinite values count as missing."""
    x = number_or_null(column)
    return F.when(F.abs(x) < float("inf"), x)


def class_histogram(
    df: DataFrame, features: Sequence[str], label: str = "Class", bins: int = PUBLISHED_BINS
) -> DataFrame:
    """Equal-width bins per class and feature, each over that class's own range.

    Returns (class, feature, bin, n) for the bins that hold rows. Missing, NaN and infinite values are left
    out. The ranges are a table with a row per class, joined by the label.
    """
    values = F.array(*[_finite_or_null(c) for c in features])
    ranges = df.groupBy(F.col(label).alias("_class")).agg(
        F.array(*[F.min(_finite_or_null(c)) for c in features]).alias("_low"),
        F.array(*[F.max(_finite_or_null(c)) for c in features]).alias("_high"),
    )
    rows = df.select(F.col(label).alias("class"), values.alias("_x"))
    rows = rows.join(ranges, F.col("class").eqNullSafe(F.col("_class")))
    width = F.zip_with("_low", "_high", lambda low, high: (high - low) / bins)
    from_low = F.zip_with("_x", "_low", lambda x, low: x - low)
    bin_of = F.zip_with(
        from_low,
        width,
        lambda x, w: F.when(x.isNull(), None).when(w > 0, F.least(F.floor(x / w), F.lit(bins - 1))).otherwise(0),
    )
    counts = (
        rows.select("class", F.posexplode(bin_of).alias("i", "bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("class", "i", F.col("bin").cast("bigint").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    feature = F.get(F.array(*[F.lit(c) for c in features]), F.col("i"))
    return counts.select("class", feature.alias("feature"), "bin", "n")


_MAX_TERMS = 1_000_000


def log_upper_gamma_share(a: float, x: float) -> float:
    """Logarithm of the regularized upper incomplete gamma function.

    A series below a + 1, else a continued fraction; in logarithms, so that shares far below the smallest
    double still have an order.
    """
    if x <= 0:
        return 0.0
    log_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        for k in range(1, _MAX_TERMS):
            term *= x / (a + k)
            total += term
            if term <= total * 1e-16:
                break
        lower = math.exp(min(0.0, log_front + math.log(total)))
        return math.log1p(-lower) if lower < 1 else -math.inf
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, _MAX_TERMS):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return log_front + math.log(h)


def chi_square_scores(df: DataFrame, features: Sequence[str], label: str = "Class") -> DataFrame:
    """Pearson's chi-square of each feature's values against the label: (feature, statistic, dof).

    Counts per (feature, value, label) are summed in each task before the one large shuffle; class totals are a
    table joined by the label. The statistic adds up (o - e)^2 / e; cells without rows add their e, which is
    taken from whole counts. There is no limit on the number of values or classes.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    )
    classes = df.groupBy(F.col(label).alias("_class")).agg(F.count("*").alias("in_class"))
    n, n_classes = classes.agg(F.sum("in_class"), F.count("*")).first()
    observed = (
        df.select(F.col(label).alias("_label"), F.inline(cells))
        .groupBy("feature", "value", "_label")
        .agg(F.count("*").alias("o"))
        .withColumn("in_value", F.sum("o").over(Window.partitionBy("feature", "value")))
        .join(classes, F.col("_label").eqNullSafe(F.col("_class")))
    )
    e = F.col("in_value") * F.col("in_class").cast("double") / F.lit(n)
    off = F.col("o") - e
    by_value = observed.groupBy("feature", "value").agg(
        F.sum(off * off / e).alias("seen"),
        (F.first("in_value") * (F.lit(n) - F.sum("in_class")) / F.lit(float(n or 1))).alias("unseen"),
    )
    return by_value.groupBy("feature").agg(
        F.sum(F.col("seen") + F.col("unseen")).alias("statistic"),
        ((F.count("*") - 1) * F.lit(n_classes - 1)).alias("dof"),
    )


def chi_square_select(
    df: DataFrame,
    features: Sequence[str],
    label: str = "Class",
    top: int = PUBLISHED_TOP_FEATURES,
) -> DataFrame:
    """Scores with p-values; ``selected`` marks the ``top`` smallest, an earlier column first in a tie.

    Ranked by the logarithm of the p-value, as p-values themselves are 0 for nearly every feature of a large
    table. One row per feature, so ranking them is left to the driver.
    """
    scores = {r["feature"]: r for r in chi_square_scores(df, features, label).collect()}

    def log_p(c: str) -> float:
        r = scores.get(c)
        return log_upper_gamma_share(r["dof"] / 2, r["statistic"] / 2) if r and r["dof"] else 0.0

    ranked = sorted((log_p(c), i, c) for i, c in enumerate(features) if c in scores)
    rows = [
        (c, scores[c]["statistic"], scores[c]["dof"], math.exp(p), p, place < top)
        for place, (p, _, c) in enumerate(ranked)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "feature string, statistic double, dof bigint, p_value double, log_p_value double, selected boolean",
    )
