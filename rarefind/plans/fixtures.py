"""Tables with a rare class, built from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefind.operators.project import PUBLISHED_FLAGS
from rarefind.sources.scratch import fresh_path

HASH_KEYS = ["l_orderkey", "l_lineno", "l_partkey"]
ROW_KEYS = [*HASH_KEYS, "l_suppkey"]
KEY_TYPES = {"l_orderkey": "bigint", "l_lineno": "int", "l_partkey": "bigint", "l_suppkey": "bigint"}
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
COMPONENTS = [f"V{i}" for i in range(1, 65)]
# The published table has 28 of them: what a slice or a drop by name picks from.
PUBLISHED_COMPONENTS = COMPONENTS[:28]

# Cuts that suit the embedding components, which lie within about 0.4 of zero.
COMPONENT_FLAGS = [("V1", "<", -0.2), ("V2", ">", 0.2), ("V3", "<", -0.15), ("V4", ">", 0.1)]
# The published cuts brought to the range of these components.
STUDY_FLAGS = [(c, op, cut * 0.06) for c, op, cut in PUBLISHED_FLAGS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a rare, learnable class: a high discount on a large quantity."""
    rare = (F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 46)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("l_lineno"),
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
        F.when(rare, 1.0).otherwise(0.0).alias("Class"),
    )


def rule() -> Column:
    """A fixed rule that finds every rare row of ``txn`` and some others."""
    return (F.col("l_quantity") >= 46) & (F.col("l_discount") >= 0.08)


def txn_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txn`` as text: quoted class, and ``null`` for the features of the first line of an order."""
    source = txn(spark, sf_dir)
    kept = {*ROW_KEYS, "l_linenumber"}

    def as_text(c: str) -> Column:
        text = F.col(c).cast("string")
        if c == "Class":
            return F.concat(F.lit('"'), F.col(c).cast("int").cast("string"), F.lit('"')).alias(c)
        if c in kept:
            return text.alias(c)
        return F.when(F.col("l_lineno") == 1, "null").otherwise(text).alias(c)

    return source.select(*[as_text(c) for c in source.columns])


def txn_csv(spark: SparkSession, sf_dir: str) -> str:
    """Write ``txn_text`` as CSV into the shared folder, a header in every file; returns the path."""
    text = txn_text(spark, sf_dir)
    path = fresh_path(spark, "txn_raw")
    header = [f'"{c}"' for c in text.columns]
    text.toDF(*header).write.options(header=True, quote="", escapeQuotes=False).csv(path)
    return path


def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed components V1..V64 of the embeddings; the class is label 0 against all others."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        *[F.col("embedding")[i].cast("double").alias(f"V{i + 1}") for i in range(64)],
        F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias("Class"),
    )


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: toxic is rare, good quality is the majority."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(documents, "doc_id")
