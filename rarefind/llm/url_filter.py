"""URL filters by Bloom filter cascades: exact membership in a list, without a join.

A cascade answers for a known universe of keys, here every key that the pages can ask for. Its first level
encodes the listed keys, the second the unlisted keys that pass the first by mistake, the third the listed
keys that pass the second, and so on until nothing passes by mistake. The first level that a key fails
tells whether it is listed. Levels are bit strings inside the expression: about 10 bits for a listed key,
and far fewer for all others. A list whose first level would be over the limit is split by hash of the key into
several cascades, of which a key asks one; executors hold the bit strings of all of them.

Everything runs as DataFrame expressions. Only finished bit strings reach the driver, never keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefind.llm.bloom import Bloom, bits_for, build_bloom
from rarefind.llm.common import stored

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Largest bit string of a level; 2**30 bits are 128 MB, about a hundred million listed keys. Longer lists are split.
MAX_LEVEL_BITS = 1 << 30


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lowered."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, _LETTERS, _LETTERS.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


@dataclass
class Cascade:
    """Levels of a finished cascade; ``contains`` is exact for every key of the universe."""

    levels: list[Bloom] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        listed = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            listed = F.when(self.levels[i].may_contain(key), listed).otherwise(F.lit(i % 2 == 1))
        return listed

    def passes_all(self, key: Column) -> Column:
        return reduce(Column.__and__, [level.may_contain(key) for level in self.levels], F.lit(True))


@dataclass
class SplitCascade:
    """Cascades of disjoint parts of the universe, each key in one of them by its hash."""

    parts: list[Cascade]

    def contains(self, key: Column) -> Column:
        listed = self.parts[-1].contains(key)
        for i in reversed(range(len(self.parts) - 1)):
            listed = F.when(_part_of(key, len(self.parts)) == i, self.parts[i].contains(key)).otherwise(listed)
        return listed


def _part_of(key: Column, parts: int) -> Column:
    """Levels hash keys with numbers from 0 up, so that -1 tells nothing about their bits."""
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def _first_level(universe: DataFrame) -> tuple[int, float]:
    """Listed keys, and the rate of mistakes that evens out the sizes of the first two levels."""
    sizes = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    listed, unlisted = sizes.get(True, 0), sizes.get(False, 0)
    mistakes = min(0.5, math.sqrt(0.5) * listed / unlisted) if listed and unlisted else 0.5
    return listed, max(mistakes, 1e-6)


def build_split_cascade(universe: DataFrame, max_bits: int = MAX_LEVEL_BITS) -> SplitCascade:
    """As ``build_cascade``, in as many parts as keep the mean first level within ``max_bits``: lists of any size."""
    n, mistakes = first = _first_level(universe)
    parts = -(-bits_for(n, mistakes) // max_bits)
    if parts <= 1:
        return SplitCascade([build_cascade(universe, first=first)])
    own = [universe.filter(_part_of(F.col("key"), parts) == i) for i in range(parts)]
    return SplitCascade([build_cascade(rows, max_bits=max_bits) for rows in own])


def build_cascade(
    universe: DataFrame, max_levels: int = 64, max_bits: int = MAX_LEVEL_BITS, first: tuple[int, float] | None = None
) -> Cascade:
    """A cascade over distinct rows (key, listed): pass a stored table, it is read at every level.

    The first level lets unlisted keys pass at a rate that evens out its size and that of the next one;
    later levels halve what is left. A level that would be over ``max_bits`` gets that many, lets more keys pass and
    leaves them to the next one. An empty list gives an empty cascade, which contains nothing.
    """
    cascade = Cascade()
    n, mistakes = first or _first_level(universe)
    while n:
        number = len(cascade.levels)
        if number == max_levels:
            raise ValueError("the keys of the universe are not distinct")
        rest = universe.filter((F.col("listed") == F.lit(number % 2 == 0)) & cascade.passes_all(F.col("key")))
        cascade.levels.append(build_bloom(rest.select("key"), n, mistakes, number, max_bits))
        wrong = (F.col("listed") == F.lit(number % 2 == 1)) & cascade.passes_all(F.col("key"))
        n, mistakes = universe.filter(wrong).count(), 0.5
    return cascade


def _rule_keys(host: Column, path: Column, rules: Sequence[Rule]) -> list[Column]:
    """The keys under which a rule for this host and path could be listed.

    Only as many last labels and first path characters as some rule has are asked for, so their number is
    fixed by the rules, however long a host or a path is. Keys that cannot be are null.
    """
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    return [
        F.when(
            (F.length(path) >= n) & (F.length(host) > 0),
            F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n)),
        )
        for labels, n in shapes
    ]


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    blocked_hosts: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every url: (id, host, path, rule, verdict).

    The longest rule that fits decides; of equal rules for both verdicts, block. Where none fits, the url
    is blocked if its host is in ``blocked_hosts`` (one text column, any number of rows), else allowed. A
    null url, or one without ``://``, has an empty host and path and is allowed. Rows keep null or repeated
    ids. ``rules`` is a plain list, as small as rule files are; the host list is a table of any size.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    cascades = _cascades(spark, urls, rules, blocked_hosts)

    hits = []
    for key in _rule_keys(F.col("host"), F.col("path"), rules):
        for verdict in ("allow", "block"):
            found = F.struct(F.length(key).alias("length"), F.lit(verdict).alias("verdict"), key.alias("rule"))
            hits.append(F.when(key.isNotNull() & cascades[verdict].contains(key), found))
    best = F.array_max(F.array(*hits)) if hits else F.lit(None).cast("struct<verdict:string,rule:string>")
    listed = cascades["hosts"].contains(F.col("host"))
    return urls.withColumn("_best", best).select(
        id_col,
        "host",
        "path",
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.when(listed, "block").otherwise("allow")).alias("verdict"),
    )


def _cascades(
    spark: SparkSession, urls: DataFrame, rules: Sequence[Rule], blocked_hosts: DataFrame
) -> dict[str, SplitCascade]:
    """One cascade for each of: allow rules, block rules, blocked hosts.

    The universe is made in one aggregate over all keys that the urls can ask for, with the listed keys
    among them; partial sums come before the shuffle, so a host with a third of the pages is a row a task.
    """
    asked = F.array(
        F.struct(F.lit("hosts").alias("list"), F.col("host").alias("key")),
        *[
            F.struct(F.lit("rules").alias("list"), key.alias("key"))
            for key in _rule_keys(F.col("host"), F.col("path"), rules)
        ],
    )
    nothing = F.lit(0).alias("listed")
    listed = {"allow": 1, "block": 2, "hosts": 4}
    keys = urls.select(F.inline(asked)).filter(F.col("key").isNotNull()).select("list", "key", nothing)
    rows = [("rules", r.key, listed[r.verdict]) for r in rules]
    own = spark.createDataFrame(rows, "list string, key string, listed int")
    host = F.col(blocked_hosts.columns[0])
    hosts = blocked_hosts.filter(host.isNotNull()).select(
        F.lit("hosts").alias("list"), host.alias("key"), F.lit(listed["hosts"]).alias("listed")
    )
    universe = stored(
        keys.unionByName(own).unionByName(hosts).groupBy("list", "key").agg(F.bit_or("listed").alias("listed")),
        "url_keys",
    )

    def cascade(kind: str, name: str) -> SplitCascade:
        is_listed = F.col("listed").bitwiseAND(F.lit(listed[name])) > 0
        return build_split_cascade(universe.filter(F.col("list") == kind).select("key", is_listed.alias("listed")))

    return {"allow": cascade("rules", "allow"), "block": cascade("rules", "block"), "hosts": cascade("hosts", "hosts")}


def hosts_with_terms(
    pages: DataFrame, terms: Sequence[str], url_col: str = "url"
) -> DataFrame:
    """Distinct hosts with a label that has one of the terms as a word between dots and hyphens."""
    found = rf"(^|[.-])({'|'.join(terms)})([.-]|$)"
    return pages.select(host_of(F.col(url_col)).alias("host")).filter(F.col("host").rlike(found)).distinct()
