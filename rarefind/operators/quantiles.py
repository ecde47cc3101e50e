"""Exact quantiles of many columns without sorting any of them.

``percentile`` keeps every distinct value of a column in one buffer, which no executor can hold for a
continuous column of a very large table. Here each wanted row number is enclosed by two approximate
quantiles, which are then checked by counting: the wanted value is one of the two, or it lies
strictly between them, or (if the sketch was off) outside. That repeats inside the interval until
few distinct values are left, and only those are counted one by one. A value that fills a large part
of the column becomes an end of the interval, and so drops out. Each pass reads all columns together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ACCURACY = 10_000
_STEPS = 2_000
_FEW_VALUES = 200_000


@dataclass
class _Rank:
    """The value of one row number, somewhere strictly between ``low`` and ``high`` (None: no bound).

    ``below`` counts the rows up to ``low``; ``trial`` holds the two values to check next.
    """

    column: str
    row: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    trial: tuple[float, float] | None = None
    few: bool = False
    value: float | None = None

    @property
    def open(self) -> bool:
        return self.value is None and not self.few


def number_or_null(column: str) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(F.col(column)), F.col(column)).cast("double")


def _between(x: Column, low: float | None, high: float | None) -> Column:
    inside = x.isNotNull()
    if low is not None:
        inside = inside & (x > low)
    if high is not None:
        inside = inside & (x < high)
    return inside


def _steps() -> Column:
    """Evenly spaced shares from 0 to 1, given as text: one call instead of one per literal."""
    return F.expr(f"array({', '.join(f'{k / _STEPS!r}D' for k in range(_STEPS + 1))})")


def _first_trials(df: DataFrame, ranks_of: dict[str, Sequence[float]]) -> tuple[dict, list[_Rank]]:
    """Row counts per column, and the ranks wanted in each with their first trial values."""
    aggregates = []
    for i, (c, probabilities) in enumerate(ranks_of.items()):
        x = number_or_null(c)
        shares = [
            min(1.0, max(0.0, p + side * 2.0 / _ACCURACY)) for p in probabilities for side in (-1, 1)
        ]
        aggregates += [
            F.count(x).alias(f"n{i}"),
            F.approx_count_distinct(x).alias(f"d{i}"),
            F.percentile_approx(x, shares, _ACCURACY).alias(f"q{i}"),
        ]
    found = df.agg(*aggregates).first()
    counts, ranks = {}, []
    for i, (c, probabilities) in enumerate(ranks_of.items()):
        counts[c] = n = found[f"n{i}"]
        few = found[f"d{i}"] <= _FEW_VALUES
        for j, p in enumerate(probabilities if n else []):
            position = p * (n - 1)
            for row in sorted({math.floor(position), math.ceil(position)}):
                trial = None if few else (found[f"q{i}"][2 * j], found[f"q{i}"][2 * j + 1])
                ranks.append(_Rank(c, row, trial=trial, few=few))
    return counts, ranks


def _narrow(df: DataFrame, ranks: list[_Rank]) -> None:
    """One pass: place each rank against its trial values and pick the next ones between them."""
    aggregates = []
    for i, r in enumerate(ranks):
        x = number_or_null(r.column)
        low, high = r.trial or (r.low, r.high)
        inner = F.when(_between(x, low, high), x)
        for name, end in (("a", low), ("b", high)):
            if end is not None:
                aggregates += [
                    F.count_if(x < end).alias(f"lt_{name}{i}"),
                    F.count_if(x <= end).alias(f"le_{name}{i}"),
                ]
        aggregates += [
            F.approx_count_distinct(inner).alias(f"d{i}"),
            F.percentile_approx(inner, _steps(), _ACCURACY).alias(f"q{i}"),
        ]
    found = df.agg(*aggregates).first().asDict()
    for i, r in enumerate(ranks):
        low, high = r.trial or (r.low, r.high)
        r.trial = None
        if low is not None and r.row < found[f"lt_a{i}"]:
            r.high = low
        elif low is not None and r.row < found[f"le_a{i}"]:
            r.value = low
        elif high is not None and r.row >= found[f"le_b{i}"]:
            r.low, r.below = high, found[f"le_b{i}"]
        elif high is not None and r.row >= found[f"lt_b{i}"]:
            r.value = high
        else:
            r.low, r.high, r.below = low, high, found.get(f"le_a{i}", 0)
            r.few = found[f"d{i}"] <= _FEW_VALUES
            steps = found[f"q{i}"]
            if not r.few and high is not None:
                at = (r.row - r.below) / (found[f"lt_b{i}"] - r.below) * _STEPS
                r.trial = (
                    steps[max(0, math.floor(at) - 1)],
                    steps[min(_STEPS, math.ceil(at) + 1)],
                )
            elif not r.few:
                r.trial = (steps[0], steps[_STEPS])


def _count_few(df: DataFrame, ranks: list[_Rank]) -> None:
    """Find the ranks whose interval holds few distinct values, by counting those values.

    Ranks with the same interval share the count.
    """
    slots: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        slots.setdefault((r.column, r.low, r.high), []).append(r)
    cells = [
        F.when(
            _between(number_or_null(column), low, high),
            F.struct(F.lit(i).alias("slot"), number_or_null(column).alias("x")),
        )
        for i, (column, low, high) in enumerate(slots)
    ]
    wanted = F.array(*[F.array(*[F.lit(r.row - r.below) for r in group]) for group in slots.values()])
    hits = (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .filter(F.col("cell").isNotNull())
        .groupBy("cell.slot", "cell.x")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(Window.partitionBy("slot").orderBy("x")))
        .withColumn("wanted", F.explode(F.element_at(wanted, F.col("slot") + 1)))
        .filter((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("n") <= F.col("wanted")))
        .select("slot", "wanted", "x")
        .collect()
    )
    value = {(h["slot"], h["wanted"]): h["x"] for h in hits}
    for i, group in enumerate(slots.values()):
        for r in group:
            r.value = value[i, r.row - r.below]


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column; missing values are left out."""
    counts, ranks = _first_trials(df, {c: probabilities for c in columns})
    while unsettled := [r for r in ranks if r.open]:
        _narrow(df, unsettled)
    if few := [r for r in ranks if r.value is None]:
        _count_few(df, few)

    value = {(r.column, r.row): r.value for r in ranks}

    def quantile(c: str, p: float) -> float | None:
        if not counts[c]:
            return None
        position = p * (counts[c] - 1)
        low, high = value[c, math.floor(position)], value[c, math.ceil(position)]
        return low if low == high else low + (high - low) * (position - math.floor(position))

    return {c: [quantile(c, p) for p in probabilities] for c in columns}
