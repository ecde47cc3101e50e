"""Ranked lexical search as a search for the largest inner products, by buckets of vector length.

A text is a vector of impacts over the terms that any query of a block holds; a query's coordinates are term weights.
With both scaled by the root of the weight, a score is an inner product, so that frequent terms add little to a
vector's length. Vectors are dealt to ranges of length, longest first, and searched in a few rounds:

1. A bucket, a run of vectors of about one length, is skipped by a query if the product of its largest length and the
   query's (Cauchy-Schwarz) cannot reach the score that the query's list ends with so far.
2. Inside, the heaviest coordinates of the query are summed. What the others can add is bounded by the
   lengths that are left on both sides, and by the bucket's largest impact of each term.
3. Survivors are scored in whole numbers over all coordinates.

The longest vectors go first, so that the next round knows a score to beat for each query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefind.llm.common import map_batches, stored

TOP = 50
#: Heaviest coordinates of a query that are summed before a bound is taken.
FOCUS = 8
#: Bytes of query texts searched in one go; each such block reads the documents once.
BLOCK_BYTES = 4_000_000
#: Shares of the vectors, longest first, that the rounds before the last one search.
ROUND_SHARES = (1 / 64, 1 / 8)
_SLACK = 1 + 1e-9

# Digits, letters and all beyond ASCII make terms; A-Z are lowered, all else parts them.
_TO_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    r"""Matches of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` in UTF-8, A-Z lowered."""
    return text.translate(_TO_TERMS).split()


def _impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """1000000000 tf div (1000 tf + 20 m), with m = 100 - 50 + (50 n N) div L."""
    m = 100 - 50 + (50 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _int_lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def _counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of every text: all its terms counted, those with a number listed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tfs = [], [], []
            for i in range(batch.num_rows):
                found = terms_of(batch.column(1)[i].as_buffer().to_pybytes())
                kinds = Counter(map(numbers.get, found))
                kinds.pop(None, None)
                n.append(len(found))
                terms.append(np.fromiter(kinds.keys(), np.int64, len(kinds)))
                tfs.append(np.fromiter(kinds.values(), np.int64, len(kinds)))
            columns = [batch.column(0), pa.array(n, pa.int64()), _int_lists(terms), _int_lists(tfs)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "terms", "tfs"])

    return map_batches(docs, count, "id bigint, n bigint, terms array<bigint>, tfs array<bigint>")


def _flat(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column."""
    lists = batch.column(column)
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


def _vectors(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(id, length, terms, impacts) of the texts that can score at all."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms = _flat(batch, 2)
            _, tfs = _flat(batch, 3)
            row = np.repeat(np.arange(len(sizes)), sizes)
            impacts = _impact(tfs, batch.column(1).to_numpy()[row], n_docs, n_terms)
            heavy = weights[terms] > 0
            row, terms, impacts = row[heavy], terms[heavy], impacts[heavy]
            squares = np.bincount(row, weights[terms] * impacts.astype(float) ** 2, minlength=len(sizes))
            left = np.bincount(row, minlength=len(sizes))
            some = np.flatnonzero(left)
            ends = pa.array(np.concatenate(([0], np.cumsum(left[some]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(some)),
                    pa.array(np.sqrt(squares[some])),
                    pa.ListArray.from_arrays(ends, pa.array(terms)),
                    pa.ListArray.from_arrays(ends, pa.array(impacts)),
                ],
                names=["id", "length", "terms", "impacts"],
            )

    return map_batches(counted, weigh, "id bigint, length double, terms array<bigint>, impacts array<bigint>")


class _Query:
    """A query's coordinates, heaviest first, with its list of the best so far."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, floor: int, top: int):
        order = np.argsort(-weights[terms], kind="stable")
        self.terms, self.weights = terms[order], weights[terms[order]]
        squares = self.weights.astype(float)
        self.length, self.rest = math.sqrt(squares.sum()), math.sqrt(squares[FOCUS:].sum())
        self.floor, self.top = max(floor, 1), top
        self.best = [np.zeros(0, np.int64)] * 3

    def offer(self, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        """Keep the best by score, then id (null last)."""
        scores, ids, unnamed = (np.concatenate(p) for p in zip(self.best, (scores, ids, unnamed)))
        order = np.lexsort((ids, unnamed, -scores))[: self.top]
        self.best = [scores[order], ids[order], unnamed[order]]
        if len(order) == self.top:
            self.floor = max(self.floor, int(scores[order[-1]]))


class _Bucket:
    """Vectors of about one length, by row and by term."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int):
        self.ids = batch.column(0).fill_null(0).to_numpy()
        self.unnamed = batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        self.length = batch.column(1).to_numpy()
        sizes, terms = _flat(batch, 2)
        _, impacts = _flat(batch, 3)
        by_term = np.argsort(terms, kind="stable")
        self._row = np.repeat(np.arange(len(sizes)), sizes)[by_term]
        self._impact = impacts[by_term]
        self._starts = np.searchsorted(terms[by_term], np.arange(n_terms + 1))
        self._largest = np.zeros(n_terms, np.int64)
        np.maximum.at(self._largest, terms, impacts)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        some = slice(self._starts[term], self._starts[term + 1])
        return self._row[some], self._impact[some]

    def search(self, query: _Query) -> None:
        if query.length * self.length.max() * _SLACK < query.floor:
            return
        scores = np.zeros(len(self.length), np.int64)
        seen = np.zeros(len(self.length))
        for term, weight in zip(query.terms[:FOCUS], query.weights[:FOCUS]):
            row, impact = self.of(term)
            scores[row] += weight * impact
            seen[row] += weight * impact.astype(float) ** 2
        left = np.sqrt(np.maximum(self.length**2 * _SLACK - seen, 0)) * query.rest
        most = int((query.weights[FOCUS:] * self._largest[query.terms[FOCUS:]]).sum())
        alive = scores + np.minimum(left * _SLACK, most) >= query.floor
        if not alive.any():
            return
        for term, weight in zip(query.terms[FOCUS:], query.weights[FOCUS:]):
            row, impact = self.of(term)
            scores[row] += weight * impact
        found = np.flatnonzero(alive & (scores >= query.floor))
        if len(found):
            query.offer(scores[found], self.ids[found], self.unnamed[found])


def _best_of(vectors: DataFrame, queries: list[np.ndarray], weights: np.ndarray, floors: list[int], top: int) -> DataFrame:
    """(query, id, score): each task's best of every query, as far as they reach the floor."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [_Query(q, weights, f, top) for q, f in zip(queries, floors)]
        for batch in batches:
            if batch.num_rows:
                bucket = _Bucket(batch, len(weights))
                for query in state:
                    bucket.search(query)
        numbers = np.repeat(np.arange(len(state)), [len(q.best[0]) for q in state])
        scores, ids, unnamed = (np.concatenate([q.best[j] for q in state]) for j in range(3))
        columns = [pa.array(numbers, pa.int64()), pa.array(ids, pa.int64(), mask=unnamed.astype(bool)), pa.array(scores, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score"])

    return map_batches(vectors, search, "query bigint, id bigint, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _search_block(texts: DataFrame, queries: list[tuple], top: int) -> DataFrame | None:
    """The best texts of some queries (id, terms): (query_id, rank, id, score); None if there are none."""
    spark = texts.sparkSession
    numbers = {t: k for k, t in enumerate(sorted(set().union(*(terms for _, terms in queries))))}
    counted = stored(_counted(texts, numbers), "term_counts")
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not numbers or not n_docs:
        return None
    weights = np.zeros(len(numbers), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():
        weights[r["term"]] = _weight(r["df"], n_docs)
    heavy = [np.array([k for k in map(numbers.get, terms) if weights[k] > 0], np.int64) for _, terms in queries]

    by_length = _vectors(counted, weights, n_docs, n_terms).repartitionByRange(F.desc("length"), F.xxhash64("id"))
    vectors = stored(by_length.sortWithinPartitions(F.desc("length")), "vectors")
    cuts = vectors.agg(F.percentile_approx("length", [1 - s for s in ROUND_SHARES], 10_000)).first()[0] or []
    ranges = [F.lit(True)]
    for cut in cuts:
        ranges[-1] = ranges[-1] & (F.col("length") >= cut)
        ranges.append(F.col("length") < cut)
    found, floors = None, [0] * len(queries)
    for range_ in ranges:
        new = _best_of(vectors.filter(range_), heavy, weights, floors, top)
        found = stored(_ranked(new if found is None else new.unionByName(found.drop("rank")), top), "best")
        for r in found.filter(F.col("rank") == top).select("query", "score").collect():
            floors[r["query"]] = r["score"]
    kind = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(queries)], "query bigint, query_id bigint")
    return found.join(kind, "query").select("query_id", "rank", "id", "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: (item id, rank, document id, score).

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lowered. With N documents that have a term, L
    terms in all of them, df of them holding a term, its weight is floor(1000 ln((2 N + 2) / (2 df + 1))). A
    document with n terms, tf of them this one, adds weight * (1000000000 tf div (1000 tf + 20 m)) to its score, where
    m = 50 + (50 n N) div L. An item's terms count once each. Documents score above 0 to be listed;
    equal scores go by ascending id, null last.

    Ids are whole numbers or null. Null texts have no terms. Rows of documents that repeat are documents of their own;
    item rows with one id are one item with all their terms, and an item without terms has no rows. Items are
    searched in blocks of about ``BLOCK_BYTES`` of text, all documents for each block. Every document is scored or
    ruled out by a bound; nothing is sampled.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    texts = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), text.alias("text"))
    asked = items.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    asked = stored(asked.distinct(), "items")
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    parts = []
    for block in range(blocks):
        terms: dict = {}
        for r in asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toLocalIterator():
            terms.setdefault(r["id"], set()).update(terms_of(r["text"].encode("utf-8", "surrogatepass")))
        part = _search_block(texts, [(i, sorted(t)) for i, t in terms.items()], top) if terms else None
        if part is not None:
            parts.append(part)
    if not parts:
        parts = [asked.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.col("query_id").alias(item_id), "rank", F.col("id").alias(doc_id), "score")
