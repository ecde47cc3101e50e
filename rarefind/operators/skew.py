"""Even work per task: joins by key, repeated rows, and the size of training partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 100_000
_MIN_TRAINING_ROWS = 5_000
_MAX_TRAINING_ROWS = 500_000
# Bagging holds a number for each row and tree.
_MAX_BAGGED_ROWS = 10_000_000


def key_struct(keys: Sequence[str]) -> Column:
    """The key as one struct: equal also where parts are null, and still a plain equi-join key."""
    return F.struct(*keys)


def match_keys(df: DataFrame, found: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join of rows with keys listed in the column ``_key``."""
    return df.join(found, key_struct(keys) == F.col("_key"), how)


def repeat_rows(df: DataFrame, times: str, index: str | None = None) -> DataFrame:
    """Each row ``times`` over (the column is dropped), numbered from 0 in ``index`` if named.

    Small counts are written out where the row lies. A row with a very large count is first cut into
    chunks, which are spread over the cluster, so that no task writes out all of its copies.
    """
    kept = [c for c in df.columns if c != times]
    number = index or "_copy"
    n = F.col(times)

    def numbered(first: Column, last: Column) -> list[Column]:
        return [*[F.col(c) for c in kept], F.explode(F.sequence(first, last)).alias(number)]

    small = df.filter((n > 0) & (n <= _CHUNK)).select(
        *numbered(F.lit(0).cast("bigint"), n.cast("bigint") - 1)
    )
    first = F.col("_chunk") * _CHUNK
    large = (
        df.filter(n > _CHUNK)
        .select("*", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK))).alias("_chunk"))
        .repartition(*kept, "_chunk")
        .select(*numbered(first, F.least(first + _CHUNK, n.cast("bigint")) - 1))
    )
    out = small.unionByName(large)
    return out if index else out.drop(number)


def spread(df: DataFrame, rows: int, trees: int = 1) -> DataFrame:
    """Rows dealt out evenly into training partitions: all cores busy, none with a handful of rows.

    A sample of a large table otherwise keeps the table's many partitions, each nearly empty, and
    every tree level or gradient step would start all of those tasks again. A forest of many ``trees`` gets smaller
    partitions, as each row takes a number for each of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    busy = min(cores, -(-rows // _MIN_TRAINING_ROWS))
    largest = max(_MIN_TRAINING_ROWS, min(_MAX_TRAINING_ROWS, _MAX_BAGGED_ROWS // max(1, trees)))
    return df.repartition(max(1, busy, -(-rows // largest)))
