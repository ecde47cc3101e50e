"""Numbers drawn from a hash of the row's key.

``rand(seed)`` and ``randomSplit`` depend on how rows are laid out in partitions, so a task that is
run again after an executor is lost may draw different numbers. A hash of the key gives every row
the same number in every run, on every cluster size, and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def key_text(keys: Sequence[str | Column]) -> Column:
    """The key columns as one text, joined by ``-``; a null part counts as empty."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _hex_digits(keys: Sequence[str | Column], salt: str, digits: int) -> Column:
    digest = F.md5(F.concat(F.lit(salt), key_text(keys)))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def unit_hash(keys: Sequence[str | Column], salt: str) -> Column:
    """A double in [0, 1), fixed by the key and the salt.

    Different salts give independent numbers, which keeps splits, folds and samples from
    following one another.
    """
    return _hex_digits(keys, salt, 8) / F.lit(4294967296.0)


def long_hash(keys: Sequence[str | Column], salt: str) -> Column:
    """A bigint in [0, 2**60), fine enough to rank very large tables with hardly a tie."""
    return _hex_digits(keys, salt, HASH_BITS // 4)
