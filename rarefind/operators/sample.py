"""Splits, samples, folds and the row combinations around them.

Rows are drawn by a hash of their key (see ``rarefind.functions.hashing``): a split, a fold or an
undersample is a plain column expression, computed where the row lies. Rows that share a key share
their number, so copies of a row cannot end up both in training and in testing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarefind.functions.hashing import HASH_BITS, long_hash, unit_hash
from rarefind.operators.skew import key_struct, match_keys, repeat_rows
from rarefind.sources.scratch import stored

SPLIT_SALT = "split:"
FOLD_SALT = "fold:"
UNDERSAMPLE_SALT = "under:"
SAMPLE_SALT = "sample:"
SHUFFLE_SALT = "shuffle:"

# Training share and seed of the published split.
PUBLISHED_TRAIN_SHARE = 0.6
PUBLISHED_SPLIT_SEED = 24

_DIGIT_BITS = 12
_SMALL_BUCKET = 1 << 16


def add_random_column(
    df: DataFrame,
    keys: Sequence[str] | None,
    salt: str = FOLD_SALT,
    name: str = "_rand",
    seed: int = 0,
) -> DataFrame:
    """Add a number in [0, 1): the key's hash, or ``rand(seed)`` when there is no key."""
    return df.withColumn(name, unit_hash(keys, salt) if keys else F.rand(seed))


def random_split(
    df: DataFrame,
    keys: Sequence[str] | None,
    train_share: float = PUBLISHED_TRAIN_SHARE,
    salt: str = SPLIT_SALT,
    seed: int = PUBLISHED_SPLIT_SEED,
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows. Without keys this is ``randomSplit``, which layout can change."""
    if not keys:
        train, test = df.randomSplit([train_share, 1 - train_share], seed)
        return train, test
    u = unit_hash(keys, salt)
    return df.filter(u < train_share), df.filter(u >= train_share)


def undersample_negatives(
    df: DataFrame,
    rate: float,
    keys: Sequence[str] | None,
    label: str = "Class",
    positive: float = 1.0,
    negative: float = 0.0,
    salt: str = UNDERSAMPLE_SALT,
    seed: int = 0,
) -> DataFrame:
    """All positives and a share ``rate`` of the negatives; any other label is left out.

    With keys the samples are nested: rows kept at one rate are kept at every higher rate.
    """
    if not keys:
        return df.sampleBy(label, {positive: 1.0, negative: rate}, seed)
    value = F.col(label)
    return df.filter(
        (value == F.lit(positive)) | ((value == F.lit(negative)) & (unit_hash(keys, salt) < rate))
    )


def assign_folds(
    df: DataFrame,
    num_folds: int,
    keys: Sequence[str] | None,
    salt: str = FOLD_SALT,
    name: str = "fold",
    seed: int = 0,
) -> DataFrame:
    """Add a fold number: fold i takes i/k <= u < (i+1)/k."""
    u = unit_hash(keys, salt) if keys else F.rand(seed)
    return df.withColumn(name, F.floor(u * num_folds).cast("int"))


def concat_rows(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns matched by name."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def remainder_rows(df: DataFrame, sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``sample``.

    The sample's keys are made distinct before the join, so copies there cost one row. A key that holds a
    large share of ``df`` makes one large partition of the left side, which adaptive execution splits. It
    does so only where both sides are shuffled for the join itself, so the distinct keys are dealt out by
    their hash as well.
    """
    key = key_struct(keys).alias("_key")
    taken = sample.select(key).select("_key", F.xxhash64("_key").alias("_h")).distinct().select("_key")
    return match_keys(df, taken, keys, "left_anti")


def shuffle_rows(
    df: DataFrame,
    keys: Sequence[str],
    salt: str = SHUFFLE_SALT,
    name: str = "_order",
    seed: int = 0,
) -> DataFrame:
    """Rows in random order; the order is also kept as a column, a hash of the key.

    Rows of one key are ordered by a hash of the whole row, and rows equal in every column by chance. Spark
    sorts by sampled ranges of all three, so the rows of a key that is everywhere fill many ranges.
    """
    ordered = df.withColumn(name, long_hash(keys, salt))
    return ordered.orderBy(name, F.xxhash64(*df.columns), F.rand(seed))


def _find_cuts(hashed: DataFrame, target: Column) -> DataFrame:
    """Per group, where the rows with the smallest hashes stop, given how many are wanted.

    ``hashed`` has (_group, _hash); ``target`` is an expression over ``_total``, or over a column ``_take`` that
    has the same value throughout a group. Returns (_cut_group, _limit,
    _tied): rows with a hash below the limit are in, and so are ``_tied`` of the rows exactly at it. Groups
    that want no rows are left out.

    Each round counts rows per 12-bit digit of the hash (at most 4,096 counts per group, summed before the
    shuffle) and goes on inside the one digit that holds the cut; once that holds few rows, the last round
    counts single hashes. Two rounds do for hundreds of millions of rows, three for a trillion. Rows are
    never sorted, and groups are rows of small tables, so their number has no limit.
    """
    found: list[DataFrame] = []
    rows, wanted, shift = hashed, target, HASH_BITS - _DIGIT_BITS
    if "_take" not in rows.columns:
        rows = rows.withColumn("_take", F.lit(None).cast("bigint"))
    group = Window.partitionBy("_group")
    while True:
        counts = rows.groupBy("_group", F.shiftright("_hash", shift).alias("_bucket")).agg(
            F.count("*").alias("_n"), F.first("_take").alias("_take")
        )
        cut = (
            counts.withColumn("_total", F.sum("_n").over(group))
            .withColumn("_wanted", wanted.cast("bigint"))
            .withColumn("_upto", F.sum("_n").over(group.orderBy("_bucket")))
            .filter((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted")))
            .select(
                F.col("_group").alias("_cut_group"),
                "_bucket",
                "_n",
                (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_open"),
            )
        )
        cut = stored(cut, "cuts")
        whole = F.col("_open") == F.col("_n")
        limit = F.when(whole, F.call_function("shiftleft", F.col("_bucket") + 1, F.lit(shift))).otherwise(F.col("_bucket"))
        tied = F.when(whole, F.lit(0)).otherwise(F.col("_open")).cast("bigint")
        closed = cut if shift == 0 else cut.filter(whole)
        found.append(closed.select("_cut_group", limit.alias("_limit"), tied.alias("_tied")))
        largest = cut.filter(~whole).agg(F.max("_n")).first()[0]
        if shift == 0 or largest is None:
            return reduce(DataFrame.unionByName, found)
        still_open = cut.filter(~whole).select("_cut_group", "_bucket", "_open")
        inside = F.shiftright(F.col("_hash"), shift) == F.col("_bucket")
        rows = (
            hashed.join(still_open, F.col("_group").eqNullSafe(F.col("_cut_group")) & inside)
            .select("_group", "_hash", F.col("_open").alias("_take"))
        )
        wanted = F.col("_take")
        shift = 0 if largest <= _SMALL_BUCKET else max(0, shift - _DIGIT_BITS)


def _with_cuts(rows: DataFrame, cuts: DataFrame, grouped: bool) -> DataFrame:
    """Add the limit and the number of tied places of the row's group; 0 where the group has no cut.

    The cuts have a row per group. Spark broadcasts them where they are small, and shuffles otherwise. Without
    groups there is one cut, which becomes a literal.
    """
    if not grouped:
        limit, tied = cuts.select("_limit", "_tied").first() or (0, 0)
        return rows.withColumns({"_limit": F.lit(limit).cast("bigint"), "_tied": F.lit(tied).cast("bigint")})
    joined = rows.join(cuts, F.col("_group").eqNullSafe(F.col("_cut_group")), "left").drop("_cut_group")
    zero = F.lit(0).cast("bigint")
    return joined.withColumns({"_limit": F.coalesce("_limit", zero), "_tied": F.coalesce("_tied", zero)})


def exact_split(
    df: DataFrame,
    keys: Sequence[str],
    target: Column,
    by: str | None = None,
    salt: str = SAMPLE_SALT,
) -> tuple[DataFrame, DataFrame]:
    """Exactly ``target`` rows per group, drawn by key hash, and all the other rows.

    ``target`` is an expression over ``_total``, the group's row count. The counting rounds read only the key
    and group columns. Both results are filters over ``df`` joined with a cut per group, which Spark
    broadcasts unless groups are very many.

    Rows that share the key at the cut are told apart by a hash of the whole row. Rows that are
    equal in every column are interchangeable: they are counted, and the right number is written
    out again on each side.
    """
    columns = df.columns
    group = F.col(by) if by else F.lit(0)
    hashed = df.select("*", group.alias("_group"), long_hash(keys, salt).alias("_hash"))
    cuts = _find_cuts(hashed.select("_group", "_hash"), target)
    below = F.col("_hash") < F.col("_limit")
    at = (F.col("_hash") == F.col("_limit")) & (F.col("_tied") > 0)

    marked = _with_cuts(hashed, cuts, bool(by))
    sample = marked.filter(below).select(*columns)
    rest = marked.filter(~below & ~at).select(*columns)
    if cuts.filter("_tied > 0").isEmpty():
        return sample, rest

    row_hash = long_hash([F.to_json(F.struct(*columns))], salt)
    same_key = marked.filter(at).withColumn("_hash", row_hash).withColumnRenamed("_tied", "_places").drop("_limit")
    row_cuts = _find_cuts(same_key.select("_group", "_hash", F.col("_places").alias("_take")), F.col("_take"))
    marked = _with_cuts(same_key, row_cuts, bool(by))
    sample = sample.unionByName(marked.filter(below).select(*columns))
    rest = rest.unionByName(marked.filter(~below & ~at).select(*columns))
    if row_cuts.filter("_tied > 0").isEmpty():
        return sample, rest

    copies = (
        marked.filter(at)
        .groupBy("_group", *columns)
        .agg(F.count("*").alias("_n"), F.first("_tied").alias("_in"))
        .withColumn("_out", F.col("_n") - F.col("_in"))
    )
    return (
        sample.unionByName(repeat_rows(copies.select(*columns, "_in"), "_in")),
        rest.unionByName(repeat_rows(copies.select(*columns, "_out"), "_out")),
    )


def exact_fraction_sample(
    df: DataFrame,
    fraction: float,
    keys: Sequence[str],
    by: str = "Class",
    salt: str = SAMPLE_SALT,
) -> tuple[DataFrame, DataFrame]:
    """Exactly round(fraction * n) rows of every class, without replacement, and the rest."""
    return exact_split(df, keys, F.bround(F.col("_total") * F.lit(float(fraction))), by, salt)


def half_split(
    df: DataFrame, keys: Sequence[str], salt: str = SHUFFLE_SALT
) -> tuple[DataFrame, DataFrame]:
    """The first floor(n/2) rows in hash order, and the others."""
    return exact_split(df, keys, F.floor(F.col("_total") / 2), None, salt)
