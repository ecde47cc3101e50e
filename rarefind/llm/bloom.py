"""Bloom filters as bit strings in column expressions: built by aggregates, asked without a join.

The bit string is one row of a stored table and enters an expression as a scalar subquery: Spark reads it once
for a query and hands it to the tasks. As a literal it would be spelled out wherever the plan is printed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefind.llm.common import stored

#: Bits of one aggregated bitmap, as fixed by Spark's bitmap functions.
_BUCKET_BITS = 32_768


@dataclass(frozen=True)
class Bloom:
    """``seed`` tells apart the hashes of filters that are asked about the same keys."""

    bits: DataFrame
    size: int
    hashes: int
    seed: int

    def may_contain(self, *key: Column) -> Column:
        """False only for keys that were not put in."""
        bits = self.bits.scalar()

        def is_set(place: Column) -> Column:
            byte = F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))
            return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1

        return reduce(Column.__and__, [is_set(p) for p in _places(key, self.size, self.hashes, self.seed)])


def bits_for(n: int, mistakes: float) -> int:
    """Bits that a filter of n keys takes to let others pass at the rate ``mistakes``."""
    return max(64, 8 * math.ceil(n * math.log2(1 / mistakes) / math.log(2) / 8))


def build_bloom(keys: DataFrame, n: int, mistakes: float, seed: int = 0, max_bits: int = 1 << 30) -> Bloom:
    """A filter of all rows of ``keys``, n of them, over all its columns.

    A filter that would need more than ``max_bits`` gets that many and lets more keys pass. Bits are set
    in bitmaps by partial aggregates; the driver receives the finished string.
    """
    size = min(bits_for(n, mistakes), max_bits)
    hashes = max(1, round(size / max(n, 1) * math.log(2)))
    hashes = min(hashes, max(1, round(math.log2(1 / mistakes))))
    columns = [F.col(c) for c in keys.columns]
    maps = (
        keys.select(F.explode(F.array(*_places(columns, size, hashes, seed))).alias("place"))
        .groupBy(F.floor(F.col("place") / _BUCKET_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("place") % _BUCKET_BITS).alias("bits"))
    )
    bits = bytearray(-(-size // _BUCKET_BITS) * _BUCKET_BITS // 8)
    for r in maps.toLocalIterator():
        at = r["bucket"] * _BUCKET_BITS // 8
        bits[at : at + len(r["bits"])] = r["bits"]
    spark = keys.sparkSession
    row = stored(spark.createDataFrame([(bits[: -(-size // 8)],)], "bits binary"), "bloom")
    return Bloom(row, size, hashes, seed)


def _places(key: list[Column] | tuple[Column, ...], size: int, hashes: int, seed: int) -> list[Column]:
    """Bit numbers of a key, by double hashing."""
    first = F.pmod(F.xxhash64(*key, F.lit(2 * seed)), F.lit(size))
    step = F.pmod(F.xxhash64(*key, F.lit(2 * seed + 1)), F.lit(size - 1)) + 1
    return [F.pmod(first + j * step, F.lit(size)) for j in range(hashes)]
