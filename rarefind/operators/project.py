"""Projections and filters. None of them shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published cuts, as (column, comparison, cut).
PUBLISHED_FLAGS = [
    ("V1", "<", -3.0),
    ("V2", ">", 2.5),
    ("V3", "<", -4.0),
    ("V4", ">", 2.5),
    ("V5", "<", -4.5),
    ("V6", "<", -2.5),
    ("V7", "<", -3.0),
    ("V9", "<", -2.0),
    ("V10", "<", -2.5),
    ("V11", ">", 2.0),
    ("V12", "<", -2.0),
    ("V14", "<", -2.5),
    ("V16", "<", -2.0),
    ("V17", "<", -2.0),
    ("V18", "<", -2.0),
    ("V19", ">", 1.5),
    ("V21", ">", 0.6),
]

# The columns the published study leaves out.
PUBLISHED_DROPPED = ["V8", "V13", "V15", "V20", "V22", "V23", "V24", "V25", "V26", "V27", "V28"]


def preview(df: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """The first n rows by the given order, as a distributed top-n rather than a full sort."""
    return df.orderBy(*order).limit(n)


def slice_columns(df: DataFrame, start: int, stop: int) -> DataFrame:
    """Columns by position, from start up to but not including stop."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[start:stop]])


def threshold_flags(
    df: DataFrame,
    flags: Sequence[tuple[str, str, float]] = PUBLISHED_FLAGS,
    suffix: str = "_",
) -> DataFrame:
    """Add a 0/1 column per (column, ``<`` or ``>``, cut). Null and NaN give 0.

    Spark orders NaN above every number, so ``NaN > cut`` has to be ruled out by hand.
    """

    def flag(name: str, comparison: str, cut: float) -> Column:
        value = F.col(name)
        if comparison not in ("<", ">"):
            raise ValueError(f"comparison must be < or >, not {comparison!r}")
        hit = value < F.lit(cut) if comparison == "<" else value > F.lit(cut)
        return F.when(hit & ~F.isnan(value), 1).otherwise(0).alias(name + suffix)

    return df.select("*", *[flag(*spec) for spec in flags])


def complement_label(df: DataFrame, label: str = "Class", name: str = "Normal") -> DataFrame:
    """Add the opposite of a 0/1 label; any other value gives null."""
    value = F.col(label)
    return df.withColumn(name, F.when(value == 0, 1).when(value == 1, 0))


def filter_class(df: DataFrame, label: str, value: float) -> DataFrame:
    return df.filter(F.col(label) == F.lit(value))


def range_filter(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows with low <= column < high."""
    return df.filter((F.col(column) >= low) & (F.col(column) < high))


def complement_filter(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows outside [low, high). Rows without a value are in neither this nor ``range_filter``."""
    return df.filter((F.col(column) < low) | (F.col(column) >= high))
