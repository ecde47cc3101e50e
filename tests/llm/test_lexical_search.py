"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rarefind.llm import lexical_search
from rarefind.llm.lexical_search import _Bucket, _Query, ranked_search, terms_of

DOCS = "doc_id bigint, text string, id string, score double, rank int"
ITEMS = "item_id bigint, text string, query int, id int"
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@given(st.text())
def test_terms(text):
    text = text.encode("utf-8", "replace").decode()
    assert [t.decode() for t in terms_of(text.encode())] == _terms(text)


def _plain(docs, items, top):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    n_terms = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_terms(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in terms if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if none else i, -score))
    return sorted(out, key=str)


def _run(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x", 0.5, 3) for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS)
    return sorted((tuple(r) for r in ranked_search(d, i, **options).collect()), key=str)


def _corpus():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "日本語", "a1"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]

    def text(n):
        return "".join(w + random.choice([" ", ", ", "\n", "_", "."]) for w in random.choices(vocabulary, weights, k=n))

    items = [(k, text(random.randint(1, 25))) for k in range(12)] + [(12, None), (13, "?!"), (14, "nowhere"), (None, "w1 W2")]
    items += [(3, "w3 w5"), (3, "w3 w5")]
    docs = [(i, text(random.choice([1, 5, 40, 200]))) for i in range(300)]
    docs += [(1000 + i, items[1][1]) for i in range(80)] + [(2, "w1"), (2, "w1"), (None, "w1 w2 w3"), (None, items[2][1])]
    docs += [(5000, None), (5001, ""), (5002, " -- "), (5003, text(9000) + items[0][1].upper())]
    return docs, items


def test_like_plain_scoring(spark, monkeypatch):
    """Ties over a list's end, copies, null ids and texts, ids that repeat, several blocks of items."""
    docs, items = _corpus()
    assert _run(spark, docs, items) == _plain(docs, items, 50)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 600)
    monkeypatch.setattr(lexical_search, "FOCUS", 2)
    assert _run(spark, docs, items, top=3) == _plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = _corpus()
    assert _run(spark, [], items) == [] and _run(spark, docs, []) == []
    assert _run(spark, [(1, None), (2, "")], items) == [] and _run(spark, docs, [(1, None)]) == []


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_lose_nothing(seed):
    """Buckets searched longest first give the lists that scoring everything gives."""
    rng = np.random.default_rng(seed)
    n_terms = int(rng.integers(3, 30))
    weights = rng.integers(1, 9000, n_terms)
    rows = []
    for i in range(120):
        terms = np.flatnonzero(rng.random(n_terms) < rng.choice([0.1, 0.5]))
        if len(terms):
            impacts = rng.integers(1, 10**6, len(terms)) if rng.random() < 0.8 else np.full(len(terms), 1000)
            rows.append((i, float(np.sqrt((weights[terms] * impacts.astype(float) ** 2).sum())), terms, impacts))
    rows.sort(key=lambda r: -r[1])
    query_terms = np.flatnonzero(rng.random(n_terms) < 0.6)
    query = _Query(query_terms, weights, 0, 5)
    for at in range(0, len(rows), 16):
        some = rows[at : at + 16]
        lists = [pa.array([r[j].tolist() for r in some], pa.list_(pa.int64())) for j in (2, 3)]
        columns = [pa.array([r[0] for r in some]), pa.array([r[1] for r in some]), *lists]
        _Bucket(pa.RecordBatch.from_arrays(columns, names=["id", "length", "terms", "impacts"]), n_terms).search(query)
    asked = set(query_terms.tolist())
    scores = [(-sum(int(weights[t] * x) for t, x in zip(r[2], r[3]) if t in asked), r[0]) for r in rows]
    expected = sorted(s for s in scores if s[0] < 0)[:5]
    assert [(-s, i) for s, i in zip(*(a.tolist() for a in query.best[:2]))] == expected
