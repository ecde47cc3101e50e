"""Prefix trie of conversations: which of them share their first turns, and what sharing saves.

1. *Ranks and prefixes* are running sums over rows dealt to ranges, so one very long conversation is the work
   of many tasks. A prefix is named by the sum of hashes of its (place, turn) pairs, 128 bits; no text
   is moved, and the rows of equal names are one node.
2. *Totals of subtrees* come from parallel tree contraction. In each round all leaves are raked into their
   parents, and in chains of nodes with a single child every node that comes before its neighbours in a fixed order
   is taken out, its child going to its parent. A chain of n nodes is gone after about log n rounds. Then nodes
   that were taken out get their totals back from their child's, last round first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarefind.llm.common import map_batches, stored
from rarefind.operators.skew import repeat_rows

#: Ids of a node's conversations are joined in chunks of at most 2 ** CHUNK_BITS.
CHUNK_BITS = 12
_LANES = ("s1", "s2", "s3", "s4")
_KEY = ("depth", "k1", "k2")
_MAX_ROUNDS = 200


def running_totals(rows: DataFrame, group: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The rows with ``run_<value>``: the sum over the rows of the same group up to this one, in order.

    Rows are dealt to ranges of group and order, so a group larger than a range is cut. Sums run within a range, and
    a range adds what its first group had in earlier ones. Groups are not null, and rows of a group differ in their order
    columns; nulls come first there. The result has a column ``_range``.
    """
    placed = rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id())
    placed = stored(placed, "ranges")
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    of_range = placed.groupBy("_range", *group).agg(*[F.sum(v).alias(v) for v in values])
    carried = of_range.select("_range", *group, *[F.sum(v).over(earlier).alias(f"_before_{v}") for v in values])
    carried = stored(carried.filter(F.col(f"_before_{values[0]}").isNotNull()), "carried")
    within = Window.partitionBy("_range", *group).orderBy(*order)
    summed = placed.withColumns({f"_run_{v}": F.sum(v).over(within) for v in values})
    totals = {f"run_{v}": F.col(f"_run_{v}") + F.coalesce(f"_before_{v}", F.lit(0)) for v in values}
    dropped = [f"_{kind}_{v}" for kind in ("run", "before") for v in values]
    return summed.join(carried, ["_range", *group], "left").withColumns(totals).drop(*dropped)


def ordered_turns(
    table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, place, a, b, bytes): every turn by its place in its conversation, from 1; stored.

    ``a`` and ``b`` are hashes of role and text, null ones empty, and ``bytes`` the length of the text. Turns are
    ordered by number, null first; of turns with one number the order is that of the hashes, and rows that
    repeat are turns of their own. Rows without a conversation id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    conv, turn = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{turn_col}`").cast("bigint")
    turns = table.select(
        conv.alias("conv"),
        turn.alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, F.lit(1), role).alias("b"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    ).filter("conv IS NOT NULL")
    kinds = turns.groupBy(*turns.columns).agg(F.count("*").alias("n"))
    ranked = running_totals(kinds, ["conv"], ["turn", "a", "b"], ["n"])
    each = repeat_rows(ranked.select("conv", "a", "b", "bytes", "n", (F.col("run_n") - F.col("n")).alias("first")), "n", "i")
    return stored(each.select("conv", (F.col("first") + F.col("i") + 1).alias("place"), "a", "b", "bytes"), "turns")


def with_shared_heads(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the turns of another one: (their turns, (conv, length) of all of them).

    Conversation c takes the first h turns of conversation c - c % ``group`` (all if there are fewer, none if it
    is not there), then its own turns after its first h, with h = crc32(c as decimal text) % ``heads``. One left
    without any turn is still listed, with length 0.
    """
    sizes = stored(turns.groupBy("conv").agg(F.max("place").alias("n")), "sizes")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h")
    each = sizes.select("conv", "n", h, (F.col("conv") - F.col("conv") % group).alias("base"))
    of_base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")
    convs = each.join(of_base, "base", "left").select("conv", "base", "n", "h", taken)
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = stored(convs.withColumn("length", length), "conversations")
    kept = ["a", "b", "bytes", "length"]
    head = (
        turns.filter(F.col("place") < heads).withColumnRenamed("conv", "base")
        .join(convs, "base").filter("place <= taken").select("conv", "place", *kept)
    )
    own = turns.join(convs, "conv").filter("place > h").select("conv", (F.expr("place - h + taken")).alias("place"), *kept)
    return head.unionByName(own), convs.select("conv", "length")


def _prefix_key(sums: list[Column]) -> list[Column]:
    return [F.xxhash64(*sums).alias("k1"), F.xxhash64(F.lit(1), *reversed(sums)).alias("k2")]


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, bytes, is_last, k1, k2, p1, p2) of every prefix but the empty one; p is the one before; stored."""
    x, y = F.xxhash64("place", "a", "b"), F.xxhash64("b", "place", "a")
    low = F.lit(0xFFFFFFFF)
    lanes = [x.bitwiseAND(low), F.shiftrightunsigned(x, 32), y.bitwiseAND(low), F.shiftrightunsigned(y, 32)]
    rows = turns.select(
        "conv", "place", "bytes", (F.col("place") == F.col("length")).alias("is_last"),
        *[lane.alias(s) for s, lane in zip(_LANES, lanes)],
    )
    summed = running_totals(rows, ["conv"], ["place"], list(_LANES))
    here = [F.col(f"run_{s}") for s in _LANES]
    before = [F.col(f"run_{s}") - F.col(s) for s in _LANES]
    parent = [c.alias(p) for c, p in zip(_prefix_key(before), ("p1", "p2"))]
    named = summed.select("conv", F.col("place").alias("depth"), "bytes", "is_last", *_prefix_key(here), *parent)
    return stored(named, "prefixes")


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of (depth, k1, k2, conv): hash of the decimal ids, ascending, joined by commas.

    SHA-256 is taken in order, so the text of a node passes one task as a stream, in chunks that were joined
    in parallel before.
    """
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))
    chunks = ends.groupBy(*_KEY, F.shiftright("conv", CHUNK_BITS).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))
    in_order = chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "chunk")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[j] for r in rows], pa.int64()) for j in range(3)]
            columns.append(pa.array([r[3] for r in rows], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=[*_KEY, "ends_sha256"])

        for batch in batches:
            done = []
            for key, text in zip(zip(*(batch.column(j).to_pylist() for j in range(3))), batch.column(3)):
                if key == now:
                    sha.update(b",")
                elif now is not None:
                    done.append((*now, sha.hexdigest()))
                if key != now:
                    now, sha = key, hashlib.sha256()
                sha.update(text.as_buffer())
            yield batch_of(done)
        if now is not None:
            yield batch_of([(*now, sha.hexdigest())])

    schema = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"
    return map_batches(in_order.select(*_KEY, "ids"), digest, schema)


def subtree_totals(tree: DataFrame, values: list[str], order: str) -> DataFrame:
    """(node, values): each value summed over the node and all below it.

    ``tree`` has a row for each node: node, parent (null for a root), the values, and an order column that
    tells neighbours in a chain apart; of three in a row, the one with the smallest goes first. All tables of a
    round are stored; what reaches the driver are counts.
    """
    columns = ["node", "parent", *values, order]
    active = tree.select(*columns)
    leaves, cut = [], []
    for _ in range(_MAX_ROUNDS):
        above = active.select(F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
        flagged = active.join(above.withColumn("_inner", F.lit(True)), "node", "left")
        flagged = stored(flagged.withColumn("_inner", F.coalesce("_inner", F.lit(False))), "contracted")
        leaves.append(flagged.filter("NOT _inner").select("node", *values))
        inner = flagged.filter("_inner")
        if inner.isEmpty():
            break
        raked = (
            flagged.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
                *[F.sum(F.when(~F.col("_inner"), F.col(v)).otherwise(0)).alias(f"_{v}") for v in values],
                F.count_if("_inner").alias("_children"),
                F.min(F.when(F.col("_inner"), F.col("node"))).alias("_child"),
            )
        )
        grown = {v: F.col(v) + F.col(f"_{v}") for v in values}
        state = inner.join(raked, "node").withColumns(grown).select(*columns, "_children", "_child")
        state = stored(state, "raked")

        chain = state.filter("_children = 1 AND parent IS NOT NULL")
        told = [chain.select(F.col(side).alias("node"), F.col(order).alias("_near")) for side in ("parent", "_child")]
        nearest = told[0].unionByName(told[1]).groupBy("node").agg(F.min("_near").alias("_near"))
        first = chain.join(nearest, "node", "left").filter(F.col("_near").isNull() | (F.col(order) < F.col("_near")))
        out = stored(first.select("node", "parent", "_child", *values), "compressed")
        cut.append(out)

        zero = [F.lit(0).cast("bigint").alias(f"_{v}") for v in values]
        nobody = F.lit(None).cast(tree.schema["parent"].dataType).alias("_to")
        changes = [
            out.select("node", F.lit(True).alias("_gone"), nobody, *zero),
            out.select(F.col("_child").alias("node"), F.lit(False).alias("_gone"), F.col("parent").alias("_to"), *zero),
            out.select(
                F.col("parent").alias("node"), F.lit(False).alias("_gone"), nobody, *[F.col(v).alias(f"_{v}") for v in values]
            ),
        ]
        change = reduce(DataFrame.unionByName, changes).groupBy("node").agg(
            F.max("_gone").alias("_gone"), F.max("_to").alias("_to"), *[F.sum(f"_{v}").alias(f"_{v}") for v in values]
        )
        left = state.join(change, "node", "left").filter("NOT coalesce(_gone, false)")
        after = {v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}
        active = left.withColumns({"parent": F.coalesce("_to", "parent"), **after}).select(*columns)
    else:
        raise RuntimeError(f"nodes are left after {_MAX_ROUNDS} rounds")

    totals = leaves.pop()
    for out, raked in zip(reversed(cut), reversed(leaves)):
        below = totals.select(F.col("node").alias("_child"), *[F.col(v).alias(f"_{v}") for v in values])
        sums = [(F.col(v) + F.col(f"_{v}")).alias(v) for v in values]
        back = stored(out.join(below, "_child").select("node", *sums), "expanded")
        totals = totals.unionByName(back).unionByName(raked)
    return totals


def conversation_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The prefix trie of conversations, a row for each node.

    ``turns`` has (conv, place, a, b, bytes, length), see ``ordered_turns``, places from 1 without gaps; ``convs`` has
    (conv, length) of every conversation, also of those without turns. Nodes are the distinct sequences of
    first d turns, the empty one included; members are the conversations that start with it.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, (n_convs - 1) times the
    bytes of the node's last text) and ends_sha256 (of the ids of members that end here, ascending, joined by
    commas). Without conversations there are no nodes.
    """
    prefixes = _prefixes(turns)
    empty = _prefix_key([F.lit(0).cast("bigint")] * len(_LANES))
    zero = F.lit(0).cast("bigint")
    grouped = prefixes.groupBy(*_KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        zero.alias("depth"), *empty, "conv", "n_convs", zero.alias("bytes"), *[F.lit(None).cast("bigint").alias(p) for p in ("p1", "p2")]
    )
    named = stored(grouped.unionByName(root), "trie_nodes")
    above = named.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv").alias("parent_conv"),
    )
    parent = F.when(F.col("parent_conv").isNotNull(), F.struct(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")))
    linked = named.join(above, ["depth", "p1", "p2"], "left").select(
        F.struct("conv", "depth").alias("node"), parent.alias("parent"), "k1", "k2", "n_convs", "bytes"
    )
    linked = stored(linked, "trie_links")
    children = linked.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    tree = linked.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero))
    tree = stored(tree, "trie")

    halving = F.col("node.depth").bitwiseAND(-F.col("node.depth"))
    totals = subtree_totals(
        tree.select(
            "node", "parent",
            F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
            F.struct(halving, F.xxhash64("node")).alias("turn_to_go"),
        ),
        ["n_leaves", "saved_tokens"],
        "turn_to_go",
    )
    ends = prefixes.filter("is_last").select(*_KEY, "conv").unionByName(
        convs.filter("length = 0").select(zero.alias("depth"), *empty, "conv")
    )
    digests = _ends_digests(ends)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        tree.withColumn("depth", F.col("node.depth"))
        .join(totals, "node")
        .join(digests, list(_KEY), "left")
        .select(
            F.col("node.conv").alias("conv_id"), "depth", F.col("parent.conv").alias("parent_conv_id"),
            "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )
