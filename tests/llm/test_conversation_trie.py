"""The prefix trie against a plain one, and its parts."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from rarefind.llm import conversation_trie as trie
from rarefind.llm.conversation_trie import conversation_trie, ordered_turns, running_totals, subtree_totals, with_shared_heads

TURNS = "conv_id bigint, turn bigint, role string, text string, conv int, place string, n int"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 1) for r in rows], TURNS)


def _result(spark, rows, **options):
    return conversation_trie(*with_shared_heads(ordered_turns(_table(spark, rows)), **options))


def _plain(rows, group=5, heads=9):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = tuple(own.get(c - c % group, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, totals = {}, {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in children.get(p, [])]
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == p)
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), parent, len(m), len(children.get(p, [])), *totals[p], digest))
    return sorted(out)


def _rows():
    random.seed(13)
    words = ["", "a", "é" * 3, "hello there", None]
    rows = []
    for c in range(60):
        for t in range(random.randint(1, 12)):
            rows.append((c, t, random.choice(["user", "bot", None]), random.choice(words)))
    rows += [(100 + c, t, "user", "same") for c in range(40) for t in range(3)]  # many equal conversations
    rows += [(300, t, "user", f"t{t}") for t in range(400)]  # one long chain
    rows += [(305, t, "user", f"t{t}" if t < 250 else "other") for t in range(300)]
    rows += [(400, None, "user", "null turn"), (400, 5, "user", "b"), (400, -1, "bot", "minus")]
    rows += [(403, 7, "user", "again")] * 5 + [(None, 1, "user", "nobody's")]
    rows += [(10**12 + 1, 0, "user", "no base")]
    random.shuffle(rows)
    return rows


def test_trie_like_a_plain_one(spark, monkeypatch):
    """Long chains, equal and turnless conversations, null turns, rows that repeat, columns with clashing names."""
    monkeypatch.setattr(trie, "CHUNK_BITS", 3)
    rows = _rows()
    got = sorted(tuple(r) for r in _result(spark, rows).collect())
    assert got == _plain(rows)
    assert any(h % 9 == 8 for h in (zlib.crc32(str(c).encode()) for c in (300, 305, 400, 403, *range(100))))


def test_empty_and_turnless(spark):
    assert _result(spark, []).collect() == []
    assert _result(spark, [(None, 1, "user", "x")]).collect() == []
    short = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(short, 0, "user", "x"), (short, 1, "user", "y")]
    assert [tuple(r) for r in _result(spark, rows).collect()] == _plain(rows)


def test_running_totals_cross_ranges(spark):
    """One group with nearly all rows is dealt to several ranges."""
    rows = [("a", i, 1) for i in range(500)] + [("b", None, 5), ("b", 1, 6)]
    df = spark.createDataFrame(rows, "g string, i int, v bigint").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_totals(df, ["g"], ["i"], ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["g"], r["i"]): r["run_v"] for r in got} == {
        **{("a", i): i + 1 for i in range(500)}, ("b", None): 5, ("b", 1): 11
    }
    assert len({r["_range"] for r in got if r["g"] == "a"}) > 1


def test_subtree_totals_of_random_trees(spark):
    """Forests with long chains and wide nodes."""
    random.seed(31)
    parent = {0: None, 1: None}
    for i in range(2, 220):
        parent[i] = i - 1 if random.random() < 0.85 else random.randrange(i)
    parent |= {i: 7 for i in range(220, 260)}
    value = {i: random.randint(-5, 9) for i in parent}
    df = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "node bigint, parent bigint, v bigint")
    expected = dict(value)
    for i in sorted(parent, reverse=True):
        if parent[i] is not None:
            expected[parent[i]] += expected[i]
    # Children have larger numbers than parents here, so that the sums are whole when they are passed on.
    got = subtree_totals(df.withColumn("o", F.xxhash64("node")), ["v"], "o").collect()
    assert {r["node"]: r["v"] for r in got} == expected and len(got) == len(parent)
