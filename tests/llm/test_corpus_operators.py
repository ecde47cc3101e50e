"""Operators over a whole table against brute force: packing, url filters, repeats, near duplicates, search."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rarefind.llm import byte_windows, jaccard_join, packing, suffix_dedup
from rarefind.llm.components import connected_components
from rarefind.llm.queries import ORACLE_SQL, REGISTRY
from rarefind.llm.rows import drop_rows, row_key
from rarefind.llm.url_filter import Rule, build_cascade, build_split_cascade, filter_urls
from rarefind.llm.vector_search import _grid, nearest_neighbours

TOKENS = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " ", "a  ", "\n\n \t x", "日本語 🙂 é", "<|endoftext|> x", "x" * 20_000, "word " * 9_000, "same", "same"]


def _docs(spark, texts):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# ---- packing ----


@settings(max_examples=200)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_sweeps_place_every_item_once_and_pack_like_best_fit(counts):
    plan = packing.best_fit_sweeps(counts, 20)
    used, ranks = defaultdict(list), defaultdict(list)
    for p in plan:
        for r in range(p.first, p.last):
            i = r - p.first
            used[p.sequence + i // p.each].append((p.offset + i % p.each * p.length, p.length))
            ranks[p.length].append(r)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 20
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(20 - length)
    assert len(used) == len(gaps)


def test_pack_texts(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(150).collect()
    texts = [*ODD, *[r["text"] for r in real]]
    tokenizer = Tokenizer.from_file(TOKENS)
    rows = packing.pack_texts(_docs(spark, texts).withColumn("length", F.lit("clash")), TOKENS).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == 1024 or (k == 0 and 0 < r["length"] < 1024)
            data = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(data)
            at += r["length"]
        assert at == len(ids)
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024
    assert len(filled) <= 1.02 * -(-sum(filled.values()) // 1024) + 1


SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=1)
def _tokenizer():
    return Tokenizer.from_file(TOKENS)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(SPACES + "  \x1c\x1f\u180e\u200b\ufeffab'slt1\u0663\u65e5.<"), max_size=30))
def test_text_ids_of_white_space_runs(text):
    ids = packing._text_ids(TOKENS).of(text)
    assert np.frombuffer(ids, "<u4").tolist() == _tokenizer().encode(text, add_special_tokens=False).ids


def test_text_ids_take_a_text_at_once_and_long_runs_of_white_space():
    ids, calls = packing._text_ids(TOKENS), []
    text = " ".join(f"{i:x}th" for i in range(3000))
    encode, ids._encode = ids._encode, lambda t: calls.append(t) or encode(t)
    try:
        got = np.frombuffer(ids.of(text), "<u4").tolist()
    finally:
        ids._encode = encode
    assert calls == [text]
    assert got == _tokenizer().encode(text, add_special_tokens=False).ids
    run = np.frombuffer(ids.of(" " * 1_200_000 + "a"), "<u4").tolist()
    assert run == np.frombuffer(ids.of(" " * 1_199_999) + ids.of(" a"), "<u4").tolist()
    assert set(run[:-1]) == set(_tokenizer().encode(" ").ids)


def test_pack_ids_and_edges(spark):
    pieces = packing.token_pieces(_docs(spark, ["a b"]), TOKENS, with_ids=True).first()
    assert pieces["ids"] == [*Tokenizer.from_file(TOKENS).encode("a b").ids, 2]
    assert packing.pack_texts(_docs(spark, ["x"]).limit(0), TOKENS).collect() == []
    same = spark.range(1000).select(F.lit(1).alias("k"), F.lit(300).cast("bigint").alias("length"))
    packed = packing.pack(same, ["k"], 1000)
    assert packed.select("sequence_id").distinct().count() == 334
    assert packed.select("sequence_id", "offset").distinct().count() == 1000
    with pytest.raises(ValueError):
        packing.pack(same, ["k"], 299)


# ---- url filter ----


def _judge(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.key), r.verdict == "block"))
        return host, path, best.key, best.verdict
    return host, path, None, "block" if host in blocked else "allow"


RULES = [
    Rule("block", "net"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "a.example.net", "/en/x"),
    Rule("allow", "org", "/fr/"),
    Rule("block", "org", "/fr/"),
]


def test_filter_urls(spark):
    random.seed(1)
    hosts = ["net", "example.net", "EXAMPLE.net", "a.example.net", "b.a.example.net", "xexample.net", "x.org", "q.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/xy/z", "/fr/1", "?q=/en/", "#/fr/", "/fr/?u=http://a.net/"]
    urls = [f"http://{random.choice(hosts)}{random.choice(paths)}" for _ in range(300)]
    urls += [None, "", "no scheme", "://", "http://", "x://.net/", "http://" + "a." * 3000 + "net/", *urls[:20]]
    urls += [f"https://h{i}.com/" for i in range(400)]
    blocked = {f"h{i}.com" for i in range(0, 400, 3)} | {"q.com", "not.there"}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    listed = spark.createDataFrame([(b,) for b in [*blocked, None]], "host string")
    rows = filter_urls(pages.withColumn("host", F.lit("clash")), RULES, listed).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in rows} == {i: _judge(u, RULES, blocked) for i, u in enumerate(urls)}
    empty = listed.limit(0)
    assert {r["verdict"] for r in filter_urls(pages.filter("page_id > 400"), [], empty).collect()} == {"allow"}
    assert filter_urls(pages.limit(0), RULES, empty).collect() == []


@pytest.mark.parametrize("share", [0, 1, 7, 500, 1000])
def test_cascade_is_exact(spark, share):
    keys = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") < share).alias("listed"))
    cascade = build_cascade(keys)
    assert keys.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


@pytest.mark.parametrize(("share", "max_bits", "parts"), [(600, 512, 2), (600, 1 << 30, 1), (0, 64, 1)])
def test_a_long_list_is_split(spark, share, max_bits, parts):
    """Limits far below the list: several cascades, no level above the limit, every answer right."""
    keys = spark.range(1000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") < share).alias("listed"))
    cascade = build_split_cascade(keys, max_bits)
    assert len(cascade.parts) >= parts and (parts > 1) == (len(cascade.parts) > 1)
    assert all(level.size <= max_bits for part in cascade.parts for level in part.levels)
    assert keys.filter(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_url_query_is_native_and_equals_its_sql(spark, sf_dir):
    ours = REGISTRY["op4_url_filter"](spark, sf_dir)
    assert not re.search("Python|Arrow|Pandas", ours._jdf.queryExecution().executedPlan().toString())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    theirs = duck.execute(ORACLE_SQL["op4_url_filter"]).fetchall()
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(theirs, key=str)


# ---- repeated windows ----


def _repeats(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, x in zip(d, gone) if not x)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_op6_tells_passages_of_over_50_words(spark, tmp_path):
    """Passages of 51 short words are under 400 bytes: nothing is removed, and columns of their own tell them."""
    fresh = (f"w{i}" for i in range(100_000))

    def some(n):
        return " ".join(next(fresh) for _ in range(n))

    passage, short, long = some(51), some(50), some(90)
    texts = [f"{some(9)} {passage} {some(7)}", f"{some(30)} {passage.replace(' ', '  ')}", f"{short} {some(5)}", f"{some(5)} {short}"]
    texts += [f"{some(3)} {long} x", f"{some(4)} {long} {some(80)} {passage}", some(200), "", None]
    _docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(REGISTRY["op6_suffix_dedup"](spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    both = len(long) + len(passage)
    expected = [(1, len(passage)), (1, len(passage) + 50), (0, 0), (0, 0), (1, len(long)), (2, both), (0, 0), (0, 0), (0, 0)]
    assert len(passage) < 400 < len(long)
    assert [(r["n_passages"], r["n_passage_bytes"]) for r in rows] == expected
    assert [r["n_removed"] > 0 for r in rows] == [False] * 4 + [True] * 2 + [False] * 3
    assert [r["n_bytes"] for r in rows] == [len(t or "") for t in texts]


@pytest.mark.parametrize("window", [40, 400])
def test_remove_repeats(spark, monkeypatch, window):
    monkeypatch.setattr(byte_windows, "CHUNK", 1500)
    random.seed(window)
    vocabulary = ["".join(random.choices("abcdeé", k=random.randint(1, 8))) for _ in range(300)]
    passage = lambda n: " ".join(random.choices(vocabulary, k=n))
    shared = [passage(window // 3) for _ in range(6)]
    texts = []
    for _ in range(60):
        text = passage(random.randint(0, window // 2))
        for _ in range(random.randint(0, 4)):
            p, k = random.choice(shared), random.randint(0, len(text))
            text = text[:k] + p[random.randint(0, len(p) // 2) : random.randint(len(p) // 2, len(p))] + text[k:]
        texts.append(text)
    texts += [*texts[:4], "ab " * window, "x" * window * 5, None, "", "y" * window, *ODD]
    docs = _docs(spark, texts).unionByName(_docs(spark, ["twin " * window]).withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = suffix_dedup.remove_repeats(docs.withColumn("runs", F.lit(1)), window=window, with_kept=True).collect()
    expected = _repeats([*texts, "twin " * window], window)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert [found[i] for i in [*range(len(texts)), None]] == expected
    assert all(r["row"]["doc_id"] == r["doc_id"] for r in rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_equal_rows_count_as_copies(spark):
    docs = spark.createDataFrame([(1, "z" + "q" * 450), (1, "z" + "q" * 450), (2, "y" * 399)], "doc_id bigint, text string")
    assert sorted(r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()) == [0, 451, 451]


# ---- near duplicates ----


def _components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, set(zip(w, w[1:], w[2:])) if len(w) > 2 else ({tuple(w)} if w else set())))
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                u, v = sorted((root(i), root(j)))
                parent[v] = u
    return {i: (len(x), root(i)) for i, x in sets}


def _near_copies(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "X"]
    texts = []
    for _ in range(30):
        base = random.choices(vocabulary, k=random.choice([1, 2, 3, 5, 8, 12, 13, 14, 20, 30, 60, 100, 300]))
        for _ in range(random.randint(1, 8)):
            words = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                at = random.randrange(len(words) + 1)
                if random.random() < 0.4:
                    words.insert(at, random.choice(vocabulary))
                elif words:
                    words.pop(min(at, len(words) - 1))
            texts.append(" ".join(words))
    return [*texts, "a b", "A B", "a b c", "A b C", "x x x x x", "x x x x", *ODD]


def test_similar_components(spark):
    texts = _near_copies(3)
    docs = _docs(spark, texts).withColumn("size", F.lit("clash"))
    found = {r[0]: tuple(r)[1:] for r in jaccard_join.similar_components(docs).collect()}
    assert found == _components(list(enumerate(texts)))
    assert jaccard_join.similar_components(docs.limit(0)).collect() == []


def test_small_tiles_give_the_same_components(spark, monkeypatch):
    """One family of many texts, cut into many tiles."""
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 7)
    random.seed(9)
    base = [f"v{i}" for i in range(200)]
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(random.randint(0, 4)):
            words[random.randrange(200)] = random.choice(["p", "q", "r"])
        texts.append(" ".join(words))
    found = {r[0]: tuple(r)[1:] for r in jaccard_join.similar_components(_docs(spark, texts)).collect()}
    assert found == _components(list(enumerate(texts)))


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_similar_sets_share_a_first_ngram(percent):
    """Over sets that differ as much as the bound allows, whatever the table of frequencies says of them."""
    random.seed(percent)
    classes = jaccard_join.SizeClasses(percent, 1 << 40)
    for _ in range(400):
        n = random.choice([1, 2, 3, 9, 10, 11, 15, 19, 20, 40, 100, 500])
        common = np.array([random.getrandbits(64) for _ in range(n)], np.uint64)
        most = int(n * (100 - percent) / percent)
        split = random.randint(0, most)
        new = np.array([random.getrandbits(64) for _ in range(most)], np.uint64)
        x, y = np.unique(np.concatenate([common, new[:split]])), np.unique(np.concatenate([common, new[split:]]))
        cells = np.array([random.choice([0, 0, 1, 2, 9]) for _ in range(1 << 10)], np.uint8)
        rarity = jaccard_join.Rarity(cells)
        cells[common >> np.uint64(54)] |= 1  # they are in two sets, and so of class 1 or above
        if 100 * n >= percent * (len(x) + len(y) - n):
            assert set(jaccard_join.first_ngrams(x, rarity, percent)) & set(jaccard_join.first_ngrams(y, rarity, percent))
            assert set(classes.of(len(x))) & set(classes.of(len(y)))


def test_rarity_counts_sets(spark, monkeypatch):
    """Class 0 only for n-grams of one set, also when they are sent in many lists; frequent ones come last."""
    monkeypatch.setattr(jaccard_join, "SORTED_NGRAMS", 50)
    monkeypatch.setattr(jaccard_join, "SENT_COPIES", 3)
    random.seed(5)
    texts = [" ".join(random.choices([f"w{i}" for i in range(12)], k=30)) for _ in range(80)] + ["a b c d e f"] * 9
    texts += [f"a b c d e f g{i} h" for i in range(40)] + [None, "", "one"]
    rows = spark.createDataFrame([(i, i, t or "") for i, t in enumerate(texts)], "_id bigint, _hash bigint, _text string")
    rarity = jaccard_join.ngram_rarity(rows.repartition(5), 3)
    numbers = jaccard_join.Memo(jaccard_join._word_number, 1000)
    sets = {tuple(jaccard_join.ngram_set(t, 3, numbers).tolist()) for t in texts}
    times = Counter(g for s in sets for g in s)
    grams = np.array(list(times), np.uint64)
    level = dict(zip(times, rarity.of(grams).tolist()))
    assert all(level[g] >= 1 for g, n in times.items() if n > 1)
    assert np.mean([level[g] == 0 for g, n in times.items() if n == 1]) > 0.5
    assert max(level.values()) == level[max(times, key=times.get)] >= 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(1, 30), min_size=1), min_size=2, max_size=12), st.sampled_from([50, 80, 90]))
def test_products_find_exactly_the_pairs(sets, percent):
    grams = [np.array(sorted(s), np.uint64) for s in sets]
    expected = {
        (i, j)
        for i in range(len(sets))
        for j in range(i + 1, len(sets))
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    }
    assert set(jaccard_join.linked_pairs(grams, percent, columns=5)) == expected
    assert set(jaccard_join.linked_pairs(grams, percent, 1, columns=5)) == {p for p in expected if p[0] == 0}


def test_connected_components(spark):
    random.seed(4)
    links = [(i, i + 1) for i in range(300)] + [(random.randrange(1000, 1400), random.randrange(1000, 1400)) for _ in range(250)]
    links += [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[root(a)] = root(b)
    rows = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    mine, theirs = defaultdict(set), defaultdict(set)
    for r in rows:
        mine[r["label"]].add(r["node"])
    for x in list(parent):
        theirs[root(x)].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


# ---- nearest neighbours ----


def _nearest(rows, k):
    usable = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted(usable):
        if q % 10 == 0:
            near = sorted(
                (float(np.sqrt(((v - usable[q]) ** 2).sum())), i)
                for i, v in usable.items()
                if i != q and len(v) == len(usable[q])
            )
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    return out


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_nearest_neighbours(spark, block_rows):
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    rows += [(i, rows[10][1]) for i in range(200, 240)]  # one vector very often: ties go by id
    rows += [(i, [x * 1e-7 for x in rows[i - 240][1]]) for i in range(240, 260)]
    rows += [(260, None), (270, [0.0] * 8), (280, [1.0, None] * 4), (290, [float("nan")] * 8), (300, []), (310, [1.0, 2.0]), (311, [1.0, 3.0])]
    df = spark.createDataFrame([*rows, (None, [1.0] * 8)], "vec_id bigint, embedding array<double>")
    found = nearest_neighbours(df.withColumn("dim", F.lit("clash")), F.col("vec_id") % 10 == 0, block_rows=block_rows).collect()
    expected = _nearest(rows, 10)
    got = sorted(map(tuple, found))
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected], rtol=1e-12, atol=0)
    assert nearest_neighbours(df.limit(0), F.lit(True)).collect() == []


@pytest.mark.parametrize(("block_rows", "cells"), [(1, 10_000), (2, 3), (4096, 10_000)])
def test_rows_that_share_an_id_are_all_candidates(spark, block_rows, cells):
    rows = [(0, [1.0]), (1, [2.0]), (1, [9.0]), (2, [2.0]), (2, [2.0]), (0, [4.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = nearest_neighbours(df, F.col("vec_id") == 0, k=4, block_rows=block_rows, cells=cells).collect()
    expected = []
    for at, (_, q) in [(0, rows[0]), (5, rows[5])]:
        near = sorted((abs(v[0] - q[0]), i) for j, (i, v) in enumerate(rows) if j != at)
        expected += [(0, n + 1, i, d) for n, (d, i) in enumerate(near[:4])]
    assert sorted(map(tuple, found)) == sorted(expected)


def test_every_tile_is_a_cell_until_there_are_many(spark):
    """Blocks on both sides meet once each, in partitions that grow with the tiles and not with one side alone."""
    blocks = spark.createDataFrame([(2, b, [b], [b], [0.0, 0.0]) for b in range(12)], "dim int, b bigint, tags array<bigint>, ids array<bigint>, vectors array<double>")
    for cells, fewest, most in ((10_000, 30, 60), (15, 6, 15), (1, 1, 2)):
        grid = _grid(blocks.withColumnRenamed("b", "c_block"), blocks.filter("b < 5").withColumnRenamed("b", "q_block"), 12, 5, cells)
        pairs = grid.select(F.get("tags", F.lit(0)).alias("c"), F.get("q_tags", F.lit(0)).alias("q"), F.spark_partition_id().alias("p"))
        rows = pairs.collect()
        assert sorted((r["c"], r["q"]) for r in rows) == [(c, q) for c in range(12) for q in range(5)]
        assert fewest <= len({r["p"] for r in rows}) <= most


# ---- pipeline ----


def test_drop_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, None), (3, "c")], "doc_id bigint, text string")
    keys = docs.select(row_key().alias("key"), "doc_id", "text")
    gone = keys.filter("doc_id IS NULL OR text = 'c'").select("key")
    twins = keys.filter("text = 'a' AND doc_id = 1").select("key").distinct()
    rows = drop_rows(docs, gone, twins=twins).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "a"), (1, "b"), (2, None)]


def test_drop_rows_keeps_any_column_name(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6), (2, "b", 7, 8)], "doc_id bigint, text string, key int, `row.x` int")
    gone = docs.filter("doc_id = 1").select(row_key().alias("key"))
    left = drop_rows(docs, gone)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "b", 7, 8)]


def test_stages_on_odd_tables(spark):
    """Empty tables, null ids and texts, and columns that clash with names used inside."""
    sf_dir = "/root/testdata/sf0.001"
    schema = DOCS + ", kept string, key int, row string, _id string"
    text = "der hund und die katze sind heute nicht im garten, weil es den ganzen tag geregnet hat. " * 3
    rows = [(None, text, None, None, None), (1, None, "de", "s", 4), (2, "", "de", "s", 4), (3, text + "x y z", "de", "s", 9)]
    full = spark.createDataFrame([(*r, "k", 1, "r", "i") for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (full, full.limit(0)):
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
            out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, full.limit(0), sf_dir).collect() == []
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, full, sf_dir).collect()} == {None, 1, 2, 3}


def test_whole_run(spark):
    """All stages one after the other: every packed document is one of the table's, and sequences have no gaps."""
    sf_dir = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} <= ids and len({r["doc_id"] for r in rows}) > len(ids) / 2
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in placed.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages(spark):
    """Each stage on hand-made rows: what it has to drop goes, and clean documents stay as they are."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    clean = [r for r in docs.orderBy("doc_id").collect() if r["text"]][:300]

    def more(*rows):
        return docs.limit(0).unionByName(spark.createDataFrame([*clean, *rows], docs.schema))

    junk = "Thre### anor*** inger%%% of&&& " * 40
    kept = stages["quality_rules"](spark, more((9001, junk, "en", "s", 1), (9002, None, None, None, None)), sf_dir)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns and not ids & {9001, 9002}

    good = [r for r in clean if r["doc_id"] in ids]
    assert len(good) > 200
    clean = good
    kept = stages["language_id"](spark, more((9003, "кью дзз жщж фыв " * 60, "en", "s", 1)), sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in good}

    base = [f"u{i}" for i in range(300)]
    copies = [(9010 + i, " ".join([*base[:150], f"new{i}", *base[151:]]), "en", "s", 1) for i in range(4)]
    kept = stages["jaccard_join"](spark, more(*copies, copies[0], copies[0]), sf_dir)
    expected = _linked_by_shingles([*((r["doc_id"], r["text"]) for r in good), *((c[0], c[1]) for c in copies)], 5, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))

    passage = " ".join(f"p{i}" for i in range(150))
    rows = [(9020, "one " + passage + " uno", "en", "s", 1), (9021, "two\n" + passage + " due", "en", "s", 1)]
    cut = stages["suffix_dedup"](spark, more(*rows), sf_dir)
    texts = {r["doc_id"]: r for r in cut.collect()}
    assert texts[9020]["text"].split() == ["one", "uno"] and texts[9021]["text"].split() == ["two", "due"]
    assert texts[9020]["n_chars"] == len(texts[9020]["text"]) and cut.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "jaccard_join", "suffix_dedup", "pack"]


def _linked_by_shingles(rows, n, percent):
    """The least id linked with each, over every pair."""
    split = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()) for i, t in rows]
    sets = [(i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()) for i, w in split]
    least = {i: i for i, _ in sets}
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    return least


def test_near_duplicate_stage_links_at_five_words_and_80(spark):
    """Two edited words in 104 leave 90 of 110 5-grams, and 3-grams at 0.887; three edited words are too many."""
    random.seed(80)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for base in range(6):
        words = random.sample(vocabulary, 104)
        for edits in ([], [20, 60], [30, 80], [15, 50, 90]):
            rows.append((len(rows), " ".join(f"new{base}.{len(rows)}" if i in edits else w for i, w in enumerate(words))))
    columns = [*rows, *((100 + i, t) for i, t in enumerate(_near_copies(4)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in columns], DOCS)
    kept = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(_linked_by_shingles(columns, 5, 80).values()))
    assert {r["doc_id"] for r in kept if r["doc_id"] < 100} == {i for i in range(24) if i % 4 in (0, 3)}


def _word_repeats(texts, window):
    """The words of each text that no repeated window of words covers."""
    split = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append([x for j, x in enumerate(w) if j not in gone])
    return out


def test_repeat_stage_takes_passages_of_51_words(spark, monkeypatch):
    """Passages of short words, far below 400 bytes; what is shared in 50 words or fewer stays as it is."""
    monkeypatch.setattr(byte_windows, "CHUNK", 130)
    random.seed(51)
    own = iter(range(10**6))
    fresh = lambda n: [f"{next(own)}é" for _ in range(n)]
    long, short, many = fresh(51), fresh(50), fresh(300)
    texts = [" ".join([*fresh(9), *long, *fresh(9)]), " \n".join([*fresh(90), *long]), " ".join(long)]
    texts += [" ".join([*fresh(7), *short, *fresh(7)]) for _ in range(3)]
    for _ in range(30):
        at, n = random.randrange(250), random.randint(20, 60)
        texts.append(" ".join([*fresh(random.randint(0, 80)), *many[at : at + n], *fresh(3)]))
    texts += ["a b " * 60, "c " * 51, None, "", " \t", "日本語" * 60 + "x", "日本語" * 60 + "y"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    rows = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["suffix_dedup"](spark, docs, "").collect()}
    expected = _word_repeats(texts, 51)
    by_bytes = len(texts) - 2
    assert [rows[i].split() for i in range(by_bytes)] == expected[:by_bytes]
    assert all(rows[i] == texts[i] for i in (3, 4, 5)) and rows[2] == ""
    assert [len(rows[i]) for i in (by_bytes, by_bytes + 1)] == [1, 1]


def test_entry_registers_every_query():
    from __spark_entry__ import oracle_sql, queries

    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in queries()}
    assert "pipeline" in queries() and "op4_url_filter" in oracle_sql()


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    outside = [p for p in (root / "rarefind").rglob("*.py") if "llm" not in p.relative_to(root / "rarefind").parts]
    assert not [p for p in outside if "rarefind.llm" in p.read_text()]
