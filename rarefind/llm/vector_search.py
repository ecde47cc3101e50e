"""Exact nearest neighbours by a block matrix join with int8 products.

Vectors are cut into blocks, and blocks are dealt into groups. The join is a grid: candidates are copied to every
group of queries and queries to every group of candidates, so a cell of the grid is a key of its own and no key holds
more than its groups. Each block of candidates in a cell meets each block of queries in one tile. In a tile, vectors quantized to int8 give approximate distances for all pairs at once, with
a bound on the error. A pair whose smallest possible distance is above the k-th best largest possible one
is out; the others are computed from the original vectors in double precision. Every task keeps one bounded
heap for each query it meets, and the heaps' rows are merged by rank.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarefind.llm.common import map_batches, stored

BLOCK_ROWS = 4096
#: Cells that the grid is cut into, about; with fewer tiles than this every tile is a cell.
GRID_CELLS = 10_000
_LEVELS = 127


def _usable(vector: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(rows: DataFrame, blocks: Column, name: str) -> DataFrame:
    """Rows of a dimension gathered in blocks: (dim, <name>, tags, ids, vectors).

    Blocks are dealt out by the hash of the row's tag, so each holds about ``BLOCK_ROWS`` rows, also where an id
    repeats without end.
    """
    return (
        rows.withColumn(name, F.pmod(F.xxhash64("tag"), blocks))
        .groupBy("dim", name)
        .agg(F.collect_list(F.struct("tag", "id", "v")).alias("rows"))
        .select(
            "dim",
            name,
            F.col("rows.tag").alias("tags"),
            F.col("rows.id").alias("ids"),
            F.flatten("rows.v").alias("vectors"),
        )
    )


def _grid(candidates: DataFrame, queries: DataFrame, c_blocks: int, q_blocks: int, cells: int) -> DataFrame:
    """Every block of candidates beside every block of queries, in about ``cells`` partitions at most.

    Groups on both sides have as many blocks, so that what is copied of one side is about what is copied of the other.
    """
    side = math.ceil(math.sqrt(max(1.0, c_blocks * q_blocks / cells)))
    c_groups, q_groups = -(-c_blocks // side), -(-q_blocks // side)

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    key = ["dim", "c_group", "q_group"]
    c_group = F.floor(F.col("c_block") / side).alias("c_group")
    q_group = F.floor(F.col("q_block") / side).alias("q_group")
    left = candidates.select("dim", "tags", "ids", "vectors", c_group, numbers(q_groups).alias("q_group"))
    named = [F.col(c).alias(f"q_{c}") for c in ("tags", "ids", "vectors")]
    right = queries.select("dim", *named, q_group, numbers(c_groups).alias("c_group"))
    parts = c_groups * q_groups
    return left.repartition(parts, *key).join(right.repartition(parts, *key), key)


class _Quantized:
    """int8 codes of rows around a common centre, a scale per row and a bound on each row's error."""

    def __init__(self, x: np.ndarray, centre: np.ndarray):
        y = x - centre
        scale = np.abs(y).max(axis=1) / _LEVELS
        self.scale = np.where(scale > 0, scale, 1.0)
        self.codes = np.rint(y / self.scale[:, None]).astype(np.int8)
        approx = self.codes * self.scale[:, None]
        self.square = np.einsum("ij,ij->i", approx, approx)
        # Distance between a row and its code, with room for rounding in these sums.
        self.error = np.sqrt(np.einsum("ij,ij->i", y - approx, y - approx)) * (1 + 1e-9) + 1e-12


def _distance_bounds(q: _Quantized, c: _Quantized) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible distance of every pair.

    Products of int8 codes are whole numbers, exact in single precision up to 2**24, so up to a thousand
    dimensions are added at a time.
    """
    dims = q.codes.shape[1]
    product = np.zeros((len(q.codes), len(c.codes)))
    for at in range(0, dims, 1024):
        left = q.codes[:, at : at + 1024].astype(np.float32)
        product += left @ c.codes[:, at : at + 1024].astype(np.float32).T
    product *= -2 * q.scale[:, None]
    product *= c.scale[None, :]
    product += q.square[:, None]
    product += c.square[None, :]
    size = np.sqrt(q.square.max(initial=0)) + np.sqrt(c.square.max(initial=0))
    distance = np.sqrt(np.maximum(product, 0))
    error = q.error[:, None] + c.error[None, :] + 1e-7 * size
    return distance - error, distance + error


def _tile(q_tags, q, c_tags, c_ids, c, k: int, heaps: dict[int, list]) -> None:
    """Push the pairs of one tile that can be among the k nearest to the queries' heaps, which are named by tag."""
    centre = c.mean(axis=0)
    own = q_tags[:, None] == c_tags[None, :]
    low, high = _distance_bounds(_Quantized(q, centre), _Quantized(c, centre))
    high[own] = np.inf
    low[own] = np.inf
    if len(c_ids) > k:
        limit = np.partition(high, k - 1, axis=1)[:, k - 1]
    else:
        limit = np.full(len(q_tags), np.inf)
    for i, tag in enumerate(q_tags.tolist()):
        heap = heaps.setdefault(tag, [])
        bound = min(limit[i], -heap[0][0] if len(heap) == k else np.inf)
        at = np.flatnonzero((low[i] <= bound) & ~own[i])
        if not len(at):
            continue
        off = c[at] - q[i]
        exact = np.sqrt(np.einsum("ij,ij->i", off, off))
        if len(at) > k:
            # By distance, ties by id; the rest cannot be among the k nearest.
            first = np.lexsort((c_ids[at], exact))[:k]
            at, exact = at[first], exact[first]
        for score, c_id in zip(exact.tolist(), c_ids[at].tolist()):
            entry = (-score, -c_id)
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    cells: int = GRID_CELLS,
) -> DataFrame:
    """The k nearest rows to every query row: (query_id bigint, rank int, vec_id bigint, score double).

    Nearness is Euclidean distance in double precision, ties go to the smaller id, and a query's own row is
    no candidate. Every candidate is compared, so nothing is missed; fewer candidates give fewer rows. Null
    ids, vectors that are null, empty or zero and vectors with null or non-finite components take no part,
    and only vectors of one dimension are compared. Rows that share an id are rows of their own: each is a candidate,
    also for the others, and each that is a query gets its own ranks.

    Both sides of a tile have about ``block_rows`` rows, and a task holds one tile at a time and a heap for each query
    of its cell.
    """
    v = F.col(vector_col).cast("array<double>")
    usable = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), is_query.alias("q"))
    usable = usable.filter(F.col("id").isNotNull() & _usable(F.col("v"))).select(
        F.monotonically_increasing_id().alias("tag"), "id", F.size("v").alias("dim"), "v", "q"
    )
    usable = stored(usable, "vectors")
    n, n_queries = usable.agg(F.count("*"), F.count_if("q")).first()
    c_blocks, q_blocks = (max(1, -(-m // block_rows)) for m in (n, n_queries))
    candidates = _packed(usable.drop("q"), F.lit(c_blocks), "c_block")
    queries = _packed(usable.filter("q").drop("q"), F.lit(q_blocks), "q_block")
    tiles = _grid(candidates, queries, c_blocks, q_blocks, cells)
    tiles = tiles.select("dim", "q_tags", "q_ids", "q_vectors", "tags", "ids", "vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        id_of: dict[int, int] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                q_tags, q_ids, q, c_tags, c_ids, c = (
                    batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(1, 7)
                )
                id_of.update(zip(q_tags.tolist(), q_ids.tolist()))
                _tile(q_tags, q.reshape(-1, dim), c_tags, c_ids, c.reshape(-1, dim), k, heaps)
        rows = [(tag, id_of[tag], -c, -s) for tag, heap in heaps.items() for s, c in heap]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["tag", "query_id", "vec_id", "score"])

    found = map_batches(tiles, search, "tag bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("tag").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
