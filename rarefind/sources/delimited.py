"""Comma-separated text as DataFrames.

The raw readers take the text as it stands: a double quote is an ordinary character, and every comma
ends a field. ``rarefind.operators.clean`` turns the raw columns into numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, StringType, StructField, StructType


def _raw_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line of the input as they stand there, quotes included."""
    return spark.read.options(header=True, quote="", inferSchema=False).csv(path).columns


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line of the input, without the quotes around them."""
    return [name.strip('"') for name in _raw_header(spark, path)]


def _schema(names: Sequence[str], kind: DataType) -> StructType:
    return StructType([StructField(name, kind, True) for name in names])


def _strict(header: bool) -> dict:
    """Reader options under which every line and every header is checked, whatever columns are asked for.

    With column pruning the parser skips fields that nobody wants, and with them the check of their number.
    With ``enforceSchema`` the headers of further files go unread.
    """
    return {"header": header, "mode": "FAILFAST", "columnPruning": False, "enforceSchema": not header}


def read_raw_csv(
    spark: SparkSession, path: str, names: Sequence[str] | None = None, header: bool = True
) -> DataFrame:
    """Every field as text. A line with too many or too few fields stops the read.

    With ``header=True`` the first line of each file is skipped, after it was compared with that of the first
    file: names in another order stop the read. With ``header=False`` header lines come through as rows, for
    ``drop_header_rows`` to remove. ``names`` rename the columns by position.
    """
    found = _raw_header(spark, path) if header or not names else list(names)
    rows = spark.read.schema(_schema(found, StringType())).options(quote="", **_strict(header)).csv(path)
    return rows.toDF(*(names or [name.strip('"') for name in found]))


def drop_header_rows(df: DataFrame, name: str | None = None) -> DataFrame:
    """Drop rows whose first field repeats the header, quoted or not, wherever they stand."""
    first = df.columns[0]
    name = name or first
    value = F.coalesce(F.col(first), F.lit(""))
    return df.filter(~value.isin(name, f'"{name}"'))


def read_typed_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    null_text: str = "null",
) -> DataFrame:
    """Typed columns in one read: doubles unless a schema is given; ``null_text`` becomes null.

    Quotes around fields and names are taken off. Lines and headers are checked as in ``read_raw_csv``.
    """
    schema = schema or _schema(header_names(spark, path), DoubleType())
    return spark.read.schema(schema).options(nullValue=null_text, **_strict(True)).csv(path)
