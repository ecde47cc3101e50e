"""Feature vectors, labels and the stages that go in front of an estimator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: columns with at most this many distinct values count as categorical.
PUBLISHED_MAX_CATEGORIES = 10


def feature_columns(df: DataFrame, leave_out: Sequence[str]) -> list[str]:
    """All columns except the label, keys and weights named."""
    return [c for c in df.columns if c not in set(leave_out)]


def assemble(df: DataFrame, features: Sequence[str], output: str = "features_vector") -> DataFrame:
    """Columns packed into one vector column; a missing value stops the job."""
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(df)


def labeled_point(df: DataFrame, features: Sequence[str], label: str = "Class") -> DataFrame:
    """Just (label, features)."""
    return assemble(df, features, "features").select(
        F.col(label).cast("double").alias("label"), "features"
    )


def pinned_label(label: str, positive: float = 1.0) -> Column:
    """1 for the positive value and 0 for any other, however frequent each is."""
    return (F.col(label) == F.lit(positive)).cast("double")


def string_index_label(df: DataFrame, label: str = "Class", output: str = "label") -> DataFrame:
    """Values numbered by falling frequency, ties in text order.

    With two classes 1 then means the rarer one, which flips on a set with a positive majority.
    ``pinned_label`` does not.
    """
    indexer = StringIndexer(inputCol=label, outputCol=output, stringOrderType="frequencyDesc")
    return indexer.fit(df).transform(df)


def vector_index(
    df: DataFrame,
    input: str = "features_vector",
    output: str = "features",
    max_categories: int = PUBLISHED_MAX_CATEGORIES,
) -> DataFrame:
    """Re-code vector slots with few distinct values to 0..m-1; a later unseen value becomes m."""
    return _indexer(input, output, max_categories).fit(df).transform(df)


def _indexer(input: str, output: str, max_categories: int) -> VectorIndexer:
    return VectorIndexer(
        inputCol=input, outputCol=output, maxCategories=max_categories, handleInvalid="keep"
    )


def label_stage(label: str, positive: float | None) -> Estimator | Transformer:
    """The pipeline's label column: pinned to a value, or by frequency when that is None."""
    if label == "label":
        raise ValueError("the class column must not be called 'label'; the pipeline adds that name")
    if positive is None:
        return StringIndexer(inputCol=label, outputCol="label")
    return SQLTransformer(
        statement=f"SELECT *, CAST(`{label}` = {float(positive)!r}D AS DOUBLE) AS label FROM __THIS__"
    )


def feature_pipeline(
    features: Sequence[str],
    estimator: Estimator | None,
    label: str | None = "Class",
    positive: float | None = 1.0,
    max_categories: int = PUBLISHED_MAX_CATEGORIES,
) -> Pipeline:
    """Label, vector, categories, estimator. The assembler is inside, so scoring needs no extra step."""
    stages = [label_stage(label, positive)] if label else []
    stages += [
        VectorAssembler(inputCols=list(features), outputCol="features_vector"),
        _indexer("features_vector", "features", max_categories),
    ]
    if estimator is not None:
        stages.append(estimator)
    return Pipeline(stages=stages)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with their features, label and prediction."""
    return model.transform(df)
