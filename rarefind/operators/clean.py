"""From raw text columns to numbers. Each step is one projection inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The texts that stand for flags and for a missing number.
QUOTED_ZERO = '"0"'
QUOTED_ONE = '"1"'
NULL_TEXT = "null"


def _each(df: DataFrame, columns: Sequence[str] | None, change) -> DataFrame:
    chosen = set(df.columns if columns is None else columns)
    return df.select(
        *[change(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns]
    )


def strip_quoted_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``"0"`` and ``"1"`` lose their quotes; every other text is left alone."""
    return _each(
        df,
        columns,
        lambda c: F.when(c == QUOTED_ZERO, "0").when(c == QUOTED_ONE, "1").otherwise(c),
    )


def null_text_to_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The text ``null`` becomes ``0``. An empty field is not a zero and stays as it is."""
    return _each(df, columns, lambda c: F.when(c == NULL_TEXT, "0").otherwise(c))


def cast_all_double(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text to double; a field that is empty or no number stops the job and is named."""

    def strict(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit("(empty)"))
        return F.coalesce(
            c.try_cast("double"), F.raise_error(F.concat(F.lit("not a number: "), text))
        )

    return _each(df, columns, strict)


def bad_number_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: per column, how many fields ``cast_all_double`` would refuse."""
    columns = df.columns if columns is None else columns
    return df.agg(
        *[F.count_if(F.col(f"`{c}`").try_cast("double").isNull()).alias(c) for c in columns]
    )


def clean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Quoted flags, then missing values, then doubles."""
    for step in (strip_quoted_flags, null_text_to_zero, cast_all_double):
        df = step(df, columns)
    return df


def floor_discretize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each value rounded down to a whole number, kept as double."""
    return _each(df, columns, lambda c: F.floor(c).cast("double"))
