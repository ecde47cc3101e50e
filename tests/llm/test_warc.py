"""WARC archives: a plain sequential reader against the one that reads splits, and rows that go round."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarefind.llm.warc import _trees, base32_of_hex, read_warc, with_originals, write_warc
from rarefind.sources.scratch import fresh_path

PAGES = "page_id bigint, url string, html string, file string, value string, id int"


def _digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _fake(payload, length=None):
    n = len(payload) if length is None else length
    return f"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {n}\r\n\r\n{payload}"


def _odd_payloads():
    random.seed(12)
    texts = [None, "", "\r\n", "\r\n\r\n", "x", "日本語 🙂", "WARC/1.1\r\n", "\r\nWARC/1.", "\r\nWARC/1.1\r\n", _fake("ab")]
    texts += [_fake("ab") + "\r\n\r\n" + _fake("cd"), _fake("", 10**6), _fake("x" * 3000, 5), "\r\nWARC/1.WARC/1.1\r\n\r\n"]
    texts += ["HTTP/1.1 200 OK\r\n\r\nbody", "a\r\n\r\nWARC/1.1\r\nContent-Length: zz\r\n\r\n", "same", "same", "same"]
    for _ in range(60):
        parts = [random.choice([_fake("q" * random.randint(0, 90)), "\r\nWARC/1.1\r\n", "p" * random.randint(0, 700)])]
        texts.append("".join(parts * random.randint(1, 4)) + str(random.random()))
    return texts


def _expected(rows, min_bytes=0):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    top, seen, out = {}, set(), []
    for i, p in payloads:
        top[p] = max(top.get(p, -1), i)
    for i, p in sorted(payloads, key=lambda r: -r[0]):
        first = len(p) < min_bytes or p not in seen
        seen.add(p)
        out.append((str(i), len(p), _digest(p), "response" if first else "revisit", None if first else str(top[p])))
    return Counter(out)


@pytest.fixture
def small_splits(spark):
    changed = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "200"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _pages(spark, rows, partitions=3):
    full = [(i, f"http://h.org/{i}\r\nX: y" if i % 3 else None, h, "f", "v", 1) for i, h in rows]
    return spark.createDataFrame(full, PAGES).repartition(partitions)


def _counted(records):
    fields = ("record_id", "payload_bytes", "payload_digest", "record_type")
    return Counter((*(r[f] for f in fields), r["refers_to"] or None) for r in records)


def test_rows_go_round_in_small_splits(spark, small_splits):
    """Payloads with magic, whole records and wrong lengths; archives of many splits; columns with clashing names."""
    rows = list(enumerate(_odd_payloads()))
    path = fresh_path(spark, "warc")
    write_warc(_pages(spark, rows), path)
    got = with_originals(read_warc(spark, path, with_payload=True)).collect()
    assert _counted(got) == _expected(rows)
    payloads = {int(r["record_id"]): bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
    assert payloads == {i: rows[i][1] or "" for i in payloads}
    assert {int(r["record_id"]): r["target_uri"] for r in got} == {
        i: f"http://h.org/{i}%0D%0AX: y" if i % 3 else None for i, _ in rows
    }


def test_repeated_rows_and_short_payloads(spark):
    rows = [(1, "x"), (7, "long one"), (7, "long one"), (7, "x"), (9, "long one"), (9, "long one"), (9, None), (8, "long one")]
    path = fresh_path(spark, "warc")
    write_warc(_pages(spark, rows, 1), path, min_bytes=5)
    assert _counted(with_originals(read_warc(spark, path)).collect()) == _expected(rows, 5)


def _plain_reader(data):
    """(offset, type, payload) of the records of a file, one after the other."""
    at, out = 0, []
    while re.match(rb"WARC/1\.[01]\r\n", data[at:]):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        start = at + len(head) + 4
        if start + size + 4 > len(data):
            break
        out.append((at, re.search(rb"(?im)^warc-type:\s*([^\r]*)", head)[1].decode(), data[start : start + size]))
        at = start + size + 4
    return out


def _written(spark, parts):
    path = fresh_path(spark, "foreign")
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "i int, value string")
    for i in range(len(parts)):
        rows.filter(F.col("i") == i).select("value").coalesce(1).write.mode("append").option("lineSep", "!").text(path)
    return path


def test_foreign_archives(spark, small_splits):
    """Both versions, odd header case, blocks without HTTP, a truncated last record, a broken length, no file start."""
    random.seed(3)

    def record(kind, block, version=1, size=None):
        n = len(block.encode()) if size is None else size
        return f"WARC/1.{version}\r\nWARC-TYPE: {kind}\r\ncontent-length:  {n}\r\nX-Note: a\r\n\r\n{block}\r\n\r\n"

    good = "".join(record(random.choice(["warcinfo", "resource"]), _fake("é" * random.randint(0, 800)), i % 2) for i in range(40))
    files = [
        good + record("metadata", "x" * 50)[:-20],
        good + record("metadata", "x" * 50, size=49) + record("resource", "lost"),
        "junk" + good,
        "",
        record("resource", ""),
    ]
    path = _written(spark, files)
    got = Counter((r["offset"], r["record_type"], r["payload_digest"]) for r in read_warc(spark, path).collect())
    data = [f.encode() + b"!" for f in files]
    data[4] = files[4].encode()
    expected = Counter()
    for d in data:
        expected += Counter((at, kind, _digest(block)) for at, kind, block in _plain_reader(d))
    assert got == expected


def test_empty_table_and_null_ids(spark):
    path = fresh_path(spark, "warc")
    write_warc(_pages(spark, []), path)
    assert read_warc(spark, path).collect() == []
    path = fresh_path(spark, "warc")
    rows = [(None, None, "a", "f", "v", 1), (None, None, "a", "f", "v", 1), (4, "u", "a", "f", "v", 1)]
    write_warc(spark.createDataFrame(rows, PAGES), path)
    got = sorted((r["record_type"], r["record_id"], r["refers_to"]) for r in with_originals(read_warc(spark, path)).collect())
    assert got == [("response", "4", None), ("revisit", "", "4"), ("revisit", "", "4")] or got == [
        ("response", "4", ""), ("revisit", "", "4"), ("revisit", "", "4")
    ]


def test_revisit_of_a_missing_original(spark):
    head = "WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Refers-To: <urn:page:2>\r\n"
    path = _written(spark, [f"{head}WARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n\r\n\r\n"])
    (row,) = with_originals(read_warc(spark, path)).collect()
    assert (row["payload_bytes"], row["payload_digest"], row["refers_to"]) == (None, None, "2")


def test_trees_tell_what_lies_on_a_chain():
    random.seed(1)
    for _ in range(50):
        places = sorted(random.sample(range(200), 40))
        at = np.array(places)
        nxt = np.array([random.choice([random.choice(places[i + 1 :] or [300]), 300, 205]) for i in range(40)])
        exits, tin, tout = _trees(at, nxt, 220)
        for e in range(40):
            chain, i = set(), e
            while i is not None:
                chain.add(i)
                last, i = i, next((k for k, p in enumerate(places) if p == nxt[i]), None)
            assert chain == {c for c in range(40) if tin[c] <= tin[e] < tout[c]}
            assert exits[e] == (nxt[last] if nxt[last] >= 213 else -1)


def test_base32(spark):
    texts = ["", "a", "page"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", base32_of_hex(F.sha1("t")).alias("d"))
    assert {r["t"]: r["d"] for r in df.collect()} == {t: _digest(t.encode()) for t in texts}
