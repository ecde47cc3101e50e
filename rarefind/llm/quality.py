"""Quality rules: word statistics per text, fixed base rules, and an isolation forest on top.

The forest is grown over the statistics of labelled good texts. A text whose statistics random splits
isolate after few cuts is unlike them. How few is too few is set from labelled texts of both kinds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarefind.llm.common import map_batches, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Most labelled texts that the forest and its threshold are fitted on.
MAX_LABELLED = 20_000
TREES = 200
TREE_ROWS = 256
#: Share of labelled good texts that the threshold may reject.
MAX_GOOD_REJECTED = 0.001

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_ENDINGS = re.compile(r"[.,;:!?]")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE_COUNTS = ("n_upper", "n_marks")
FEATURES = ("n_symbols", "n_repeat_words", "n_dup_lines", "word_chars", "n_upper", "n_marks")
PRIOR_WORDS = 50


def repeated_words(found: list[str], window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words found twice or more, the first one included.

    Words become numbers, and runs of two, four and ``window`` words are numbered in turn, so equal
    numbers mean equal words: no hash can collide.
    """
    n = len(found) - window + 1
    if n < 2:
        return 0
    index: dict[str, int] = {}
    code = np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, len(found))
    width, runs, size = 1, code, len(index)
    while width < window:
        step = min(width, window - width)
        pairs = runs[:-step] * np.int64(size) + runs[step:]
        distinct, runs = np.unique(pairs, return_inverse=True)
        width, size = width + step, len(distinct)
    often = np.bincount(runs, minlength=size)[runs] > 1
    if not often.any():
        return 0
    edges = np.zeros(len(found) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of the output columns; zeros for a null text."""
    if not text:
        return (0,) * (len(_COUNTS) + len(_MORE_COUNTS))
    found = words(text)
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif line and words(line):
            seen.add(line)
    return (
        len(found),
        sum(map(len, found)),
        len(_SYMBOLS.findall(text)),
        duplicates,
        repeated_words(found),
        len(_UPPER.findall(text)),
        len(_ENDINGS.findall(text)),
    )


def _counted(texts: pa.Array) -> dict[str, np.ndarray]:
    rows = [text_statistics(t.as_py()) for t in texts]
    return {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate((*_COUNTS, *_MORE_COUNTS))}


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...) of every whole text.

    A null text has no words and no lines. One row per input row, where it lies; null ids stay null.
    """
    names = (*_COUNTS, *_MORE_COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [pa.array(v) for v in _counted(batch.column(1)).values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *[f"{c} bigint" for c in names]])
    return map_batches(docs.select(id_col, text_col), count, schema)


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    n = counts["n_words"]
    return (n < MIN_WORDS) | (counts["n_repeat_words"] * 100 > n * MAX_REPEAT_PERCENT)


def _rates(columns: dict[str, np.ndarray], usual: np.ndarray | None) -> np.ndarray:
    """Rates per word, so that a text's length alone never makes it an outlier.

    With the ``usual`` rates of good texts, every text is read as if ``PRIOR_WORDS`` such words came on
    top: rates of short texts vary by chance, and this takes that out.
    """
    c = {k: np.asarray(v, np.float64) for k, v in columns.items()}
    n = c["n_words"]
    counts = np.column_stack([c[k] for k in FEATURES])
    if usual is None:
        return counts.sum(axis=0) / max(n.sum(), 1.0)
    return (counts + PRIOR_WORDS * usual) / (n + PRIOR_WORDS)[:, None]


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, np.float64)
    safe = np.maximum(n, 3)
    deep = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Random split trees in flat arrays. Inner nodes have a feature, leaves have -1 and a depth."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: np.ndarray
    roots: list[int]
    rows: int

    @classmethod
    def fit(cls, x: np.ndarray, trees: int, rows: int, seed: int) -> IsolationForest:
        """Each tree splits ``rows`` drawn rows at random cuts, somewhat beyond what they span.

        The margin lets a value outside everything seen be cut off early. Where all rows have one
        value, as the number of odd symbols mostly has, the cut lies above it.
        """
        random = np.random.default_rng(seed)
        margin = np.maximum(x.std(axis=0), 1e-3)
        nodes: list[list[float]] = []

        def grow(part: np.ndarray, depth: int, limit: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, depth + float(_average_path(len(part)))])
            if depth < limit and len(part) > 1:
                f = int(random.integers(x.shape[1]))
                lo, hi = part[:, f].min(), part[:, f].max()
                cut = random.uniform(lo - margin[f] if hi > lo else lo, hi + margin[f])
                left = part[:, f] <= cut
                nodes[at][:2] = [f, cut]
                nodes[at][2] = grow(part[left], depth + 1, limit)
                nodes[at][3] = grow(part[~left], depth + 1, limit)
            return at

        rows = min(rows, len(x))
        limit = max(1, math.ceil(math.log2(max(rows, 2)))) * 2
        roots = [
            grow(x[random.choice(len(x), rows, replace=False)], 0, limit) for _ in range(trees)
        ]
        table = np.array(nodes)
        feature, low, high = (table[:, i].astype(np.int32) for i in (0, 2, 3))
        return cls(feature, table[:, 1], low, high, table[:, 4], roots, rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 to the power of -(mean path / average path)."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            while (inner := self.feature[at] >= 0).any():
                f = np.maximum(self.feature[at], 0)
                below = x[every, f] <= self.cut[at]
                at = np.where(inner, np.where(below, self.low[at], self.high[at]), at)
            total += self.depth[at]
        return 2.0 ** (-total / len(self.roots) / float(_average_path(max(self.rows, 3))))


@dataclass
class QualityModel:
    usual: np.ndarray
    forest: IsolationForest
    threshold: float

    def score(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return self.forest.score(_rates(columns, self.usual))


def _threshold(good: np.ndarray, bad: np.ndarray, max_good_rejected: float) -> float:
    """The score above which a text goes: between the good texts' upper end and the bad ones above it.

    At most ``max_good_rejected`` of the good texts lie above the lower bound. From there the threshold
    moves halfway to the next bad text, which leaves room for good texts a little odder than those seen.
    """
    floor = float(np.quantile(good, 1 - max_good_rejected, method="higher"))
    above = bad[bad > floor]
    return floor if not len(above) else (floor + float(above.min())) / 2


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
    seed: int = 7,
) -> QualityModel | None:
    """Forest and threshold from at most ``max_labelled`` labelled rows, drawn by hash of the id.

    Labels are 1 for good and 0 for bad; other labels, unlabelled texts and texts that fail the base
    rules take no part. Without good labelled rows there is no model. The drawn ids are broadcast (their
    number is bounded), and statistics are taken of their texts only.
    """
    drawn = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
        .groupBy("_id")
        .agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_labelled)
    )
    plain = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    texts = plain.join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))
    statistics = rule_statistics(texts, "_label", "_text")
    found = statistics.orderBy(F.xxhash64(*statistics.columns), "n_words").limit(max_labelled).toPandas()
    counts = {c: found[c].to_numpy() for c in (*_COUNTS, *_MORE_COUNTS)}
    passed = ~base_failed(counts)
    counts = {c: v[passed] for c, v in counts.items()}
    good = found["_label"].to_numpy()[passed] == 1
    if not good.any():
        return None
    usual = _rates({c: v[good] for c, v in counts.items()}, None)
    x = _rates(counts, usual)
    forest = IsolationForest.fit(x[good], TREES, TREE_ROWS, seed)
    scores = forest.score(x)
    return QualityModel(usual, forest, _threshold(scores[good], scores[~good], MAX_GOOD_REJECTED))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    with_rows: bool = False,
) -> DataFrame:
    """Statistics, base verdict, anomaly score and final verdict of every text.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks,
    base_failed, score, kept; with ``with_rows`` also ``row``, a struct of the input columns. The forest is
    fitted on a bounded sample first; then every text is counted and judged where it lies, without a shuffle.
    A null or empty text has no words and fails the base rules. Without a model (no good labels) the base
    rules alone decide and scores are null. Repeated ids are judged row by row.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col)
    names = [id_col, *_COUNTS, *_MORE_COUNTS, "base_failed", "score", "kept"] + ["row"] * with_rows
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    given = docs.select(F.col(id_col), F.col(text_col), *[row] * with_rows)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counted(batch.column(1))
            failed = base_failed(counts)
            if model is None:
                scores, kept = pa.nulls(len(failed), pa.float64()), ~failed
            else:
                x = model.score(counts)
                scores, kept = pa.array(x, pa.float64()), ~failed & (x <= model.threshold)
            columns = [batch.column(0), *[pa.array(v) for v in counts.values()]]
            columns += [pa.array(failed, pa.bool_()), scores, pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=names)

    types = dict(given.dtypes)
    schema = ", ".join(
        [f"`{id_col}` {types[id_col]}", *[f"{c} bigint" for c in (*_COUNTS, *_MORE_COUNTS)]]
        + ["base_failed boolean", "score double", "kept boolean"]
        + [f"row {types.get('row')}"] * with_rows
    )
    return map_batches(given, judge, schema)
