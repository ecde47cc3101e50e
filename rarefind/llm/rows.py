"""Taking named rows out of a table of texts while moving few of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefind.llm.bloom import build_bloom

_FILTER_BITS = 1 << 27


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """(id, hash of the text): names a row, or rows that are equal in both."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))


def _may_be_in(keys: DataFrame) -> Column:
    parts = keys.select("key.id", "key.hash")
    bloom = build_bloom(parts, parts.count(), 0.01, max_bits=_FILTER_BITS)
    return bloom.may_contain(F.col("key.id"), F.col("key.hash"))


def drop_rows(
    docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text", twins: DataFrame | None = None
) -> DataFrame:
    """``docs`` without the rows whose key is in ``rejected`` (a column ``key``, see ``row_key``).

    Of rows whose key is in ``twins``, one of each key stays. Rows that a Bloom filter of fixed size clears
    stay where they are; only the others are moved to meet the keys. Pass stored tables of keys.
    """
    keys = rejected if twins is None else rejected.unionByName(twins)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, row_key(f"`{id_col}`", f"`{text_col}`").alias("key"))
    hit = _may_be_in(keys)
    clear = keyed.filter(~hit)
    left = keyed.filter(hit).join(rejected.select("key").distinct(), "key", "left_anti")
    if twins is not None:
        one = twins.select("key").distinct()
        single = left.join(one, "key", "left_anti")
        pairs = left.join(one, "key", "left_semi").dropDuplicates(["key"])
        left = single.unionByName(pairs)
    return clear.unionByName(left.select(*keyed.columns)).select("row.*")
