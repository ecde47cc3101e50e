r"""WARC archives: pages written as records, archives read back record by record from any split of a file.

Writing takes text partitions whose line end is a record's end, so a partition is an archive and no page is moved
to write it. Of equal payloads one becomes a ``response``; the others are ``revisit`` records without a block.

Reading does not trust the magic. Files are cut at every ``\r\nWARC/1.``, which payloads may hold as well:

1. *Candidates.* A task walks the pieces of its split and emits, for each piece that starts like a record, its place
   and that of its successor, as told by its Content-Length. It follows chains within the split, so a candidate
   also has the first place outside the split that its chain comes to.
2. *Pointer jumping.* The places where chains cross splits form a small graph. From the start of each file, known
   places double with every round of joins, as do the lengths of the pointers.
3. *Verification.* A split has at most one place where the chain from the file's start enters it. Records
   on the way from there are kept, all other magic is payload.

A record that is one piece has its payload hashed where it was read. Records with magic inside are put together
from their pieces once it is known that they are records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rarefind.llm.common import map_batches, stored
from rarefind.llm.rows import drop_rows, row_key
from rarefind.operators.skew import repeat_rows

_END = "\r\n\r\n"
_MAGIC = "WARC/1."
_CUT = "\r\n" + _MAGIC
_CUT_BYTES, _MAGIC_BYTES = len(_CUT), len(_MAGIC)
_ID = "urn:page:"
_HTTP = "application/http"
_HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MAX_ROUNDS = 64


def base32_of_hex(digest: Column) -> Column:
    """40 hexadecimal digits (SHA-1) as 32 base32 letters."""
    parts = [F.conv(F.substring(digest, at, 10), 16, 32) for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*[F.lpad(p, 8, "0") for p in parts]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


# ---- writing ----


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _record(kind: str, date: str, more: list[Column], length: Column) -> Column:
    """The header of a record of (id, url, digest), up to the empty line."""
    name = _one_line(F.coalesce(F.col("id").cast("string"), F.lit("")))
    lines = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {date}"),
        F.concat(F.lit(f"WARC-Record-ID: <{_ID}"), name, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        *more,
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """One WARC record for each row, in archives under ``path``.

    Of rows with equal payloads of ``min_bytes`` or more, the one with the largest id (then url) is a response and
    the others are revisits that refer to it; shorter payloads are all responses. Rows that repeat are
    records of their own. A null payload is empty, a null id is an empty name, a null url has no target line;
    line ends in ids and urls are percent-encoded. Other columns are not looked at. An empty table makes empty
    archives. Payloads stay where they are, except for rows that a Bloom filter of fixed size takes for revisits.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    digest, size = base32_of_hex(F.sha1("payload")), F.octet_length("payload").cast("bigint")
    light = stored(rows.select("id", "url", digest.alias("digest"), size.alias("bytes")), "payloads")
    top = F.struct("id", "url")
    classes = (
        light.filter(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max(top).alias("top"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "bytes", "top")
    )
    classes = stored(classes, "payload_classes")
    copies = light.join(classes, ["digest", "bytes"])
    first = copies.filter(top == F.col("top")).groupBy("id", "url", "digest", "top").agg(F.count("*").alias("n"))
    again = first.filter("n > 1").withColumn("n", F.col("n") - 1)
    fields = ["id", "url", "digest", "top"]
    revisits = stored(copies.filter(top != F.col("top")).select(*fields), "revisits")
    repeated = stored(again.select(*fields, "n"), "repeated_responses")

    mark = F.concat_ws(" ", "digest", "url").alias("mark")
    key = row_key("id", "mark").alias("key")
    responses = drop_rows(
        rows.withColumn("digest", digest).withColumn("mark", mark),
        revisits.select("id", mark).select(key),
        "id",
        "mark",
        twins=repeated.select("id", mark).select(key),
    )
    head = F.concat(F.lit(_HTTP_HEAD), F.octet_length("payload").cast("string"), F.lit(_END))
    block = F.concat(head, F.col("payload"))
    kind = F.lit(f"Content-Type: {_HTTP};msgtype=response")
    written = responses.select(F.concat(_record("response", date, [kind], F.octet_length(block)), block).alias("value"))

    refers = F.concat(
        F.lit(f"WARC-Refers-To: <{_ID}"), _one_line(F.coalesce(F.col("top.id").cast("string"), F.lit(""))), F.lit(">")
    )
    profile = F.lit(f"WARC-Profile: {_PROFILE}")
    others = revisits.unionByName(repeat_rows(repeated, "n"))
    empty = others.select(_record("revisit", date, [profile, refers], F.lit(0)).alias("value"))
    written.unionByName(empty).write.option("lineSep", _END).text(path)


# ---- reading ----


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what stands between cuts; the block is the start of the split it was read in."""
    return spark.read.option("lineSep", _CUT).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _payload(block: Column, is_http: Column) -> Column:
    """A record's payload out of its block: what stands behind the HTTP header, if it has one."""
    head = F.octet_length(F.substring_index(block.cast("string"), _END, 1))
    return F.when(is_http, F.substring(block, head + len(_END) + 1, F.octet_length(block))).otherwise(block)


_FIELDS = {
    "record_type": "string", "record_id": "string", "target_uri": "string", "refers_to": "string",
    "declared_digest": "string", "is_http": "boolean", "payload_bytes": "bigint", "payload_digest": "string",
}
_PLACES = ("at", "content", "next", "exit", "tin", "tout")


def _parsed(pieces: DataFrame, with_payload: bool) -> DataFrame:
    """(file, block, size, at_start, content, length, fields); no length for pieces that start no record.

    ``content`` is where the block starts within the piece. A payload is hashed here if the piece is one whole
    record, as far as the piece can tell.
    """
    at_start = F.col("value").startswith(_MAGIC)
    skip = F.when(at_start, _MAGIC_BYTES).otherwise(0)
    binary = F.col("value").cast("binary")
    body = F.when(at_start, F.substring(binary, F.lit(_MAGIC_BYTES + 1), F.octet_length("value")).cast("string"))
    head = F.substring_index(F.coalesce(body, F.col("value")), _END, 1)
    starts = F.substring(F.col("value"), skip + 1, F.lit(3)).isin("0\r\n", "1\r\n")
    headed = pieces.select("*", at_start.alias("at_start"), skip.alias("skip"), F.when(starts, head).alias("head"))
    size, content = F.octet_length("value"), F.col("skip") + F.octet_length("head") + len(_END)
    length = F.regexp_extract("head", r"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", 1)
    measured = headed.select(
        "*",
        size.cast("bigint").alias("size"),
        content.cast("bigint").alias("content"),
        F.when(size >= content, length.try_cast("bigint")).alias("length"),
    )
    rest = F.col("size") - F.col("content") - F.col("length")
    is_http = F.coalesce(F.lower(_field("content-type")).startswith(_HTTP), F.lit(False))
    block = F.substring(binary, (F.col("content") + 1).cast("int"), F.col("length").cast("int"))
    whole = F.when(rest.isin(len(_END) - 2, len(_END)), _payload(block, is_http))
    return measured.select(
        "file", "block", "size", "at_start", "content", "length",
        _field("warc-type").alias("record_type"),
        F.regexp_extract(_field("warc-record-id"), rf"^<{_ID}(.*)>", 1).alias("record_id"),
        _field("warc-target-uri").alias("target_uri"),
        F.regexp_extract(_field("warc-refers-to"), rf"^<{_ID}(.*)>", 1).alias("refers_to"),
        F.regexp_extract(_field("warc-payload-digest"), r"(?i)^sha1:([A-Z2-7]+)", 1).alias("declared_digest"),
        is_http.alias("is_http"),
        F.octet_length(whole).cast("bigint").alias("payload_bytes"),
        F.sha1(whole).alias("payload_digest"),
        *[whole.alias("payload")] * with_payload,
    )


def _trees(at: np.ndarray, following: np.ndarray, end: int) -> tuple[list[int], list[int], list[int]]:
    """For candidates by place, in a split that ends at ``end``: exit (or -1), tin and tout."""
    n = len(at)
    above = np.searchsorted(at, following)
    inside = above < n
    inside[inside] = at[above[inside]] == following[inside]
    exits = np.where(following >= end - _MAGIC_BYTES, following, -1).tolist()
    above, inside = above.tolist(), inside.tolist()
    size, tin, free, roots = [1] * n, [0] * n, [0] * n, 0
    for i in range(n):
        if inside[i]:
            size[above[i]] += size[i]
    for i in range(n - 1, -1, -1):
        if inside[i]:
            up = above[i]
            exits[i], tin[i] = exits[up], free[up]
            free[up] += size[i]
        else:
            tin[i] = roots
            roots += size[i]
        free[i] = tin[i] + 1
    return exits, tin, [t + s for t, s in zip(tin, size)]


class _Split:
    """The candidates of one split while its pieces come in."""

    def __init__(self, file: str, block: int):
        self.file, self.block, self.end = file, block, 0
        self._numbers, self._fields = [], []

    def add(self, batch: pa.RecordBatch, fields: list[str]) -> None:
        size, content, length = (pc.fill_null(batch.column(i), -1).to_numpy() for i in (2, 4, 5))
        start = self.end + np.concatenate(([0], np.cumsum(size + _CUT_BYTES)))
        first = np.zeros(len(size), bool)
        first[0] = self.end == 0 and self.block == 0
        at_start = batch.column(3).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero((length >= 0) & (at_start == first))
        content = start[rows] + content[rows]
        at = np.where(first[rows], 0, start[rows] - _MAGIC_BYTES)
        self._numbers.append((at, content, content + length[rows] + len(_END)))
        self._fields.append(batch.select(fields).take(pa.array(rows, pa.int64())))
        self.end = int(start[-1])

    def rows(self) -> Iterator[pa.RecordBatch]:
        at, content, following = map(np.concatenate, zip(*self._numbers))
        exits, tin, tout = _trees(at, following, self.end)
        known = pa.array([x if x >= 0 else None for x in exits], pa.int64())
        places = [pa.array(at), pa.array(content), pa.array(following), known, *(pa.array(x, pa.int64()) for x in (tin, tout))]
        done = 0
        for part in self._fields:
            n = part.num_rows
            yield self._named(n, [p.slice(done, n) for p in places], part)
            done += n
        total = [pa.array([self.end if p == "next" else None], pa.int64()) for p in _PLACES]
        nothing = [pa.nulls(1, f.type) for f in self._fields[0].schema]
        yield self._named(1, total, pa.RecordBatch.from_arrays(nothing, names=self._fields[0].schema.names))

    def _named(self, n: int, places: list, fields: pa.RecordBatch) -> pa.RecordBatch:
        key = [pa.array([self.file] * n, pa.string()), pa.array([self.block] * n, pa.int64())]
        names = ["file", "block", *_PLACES, *fields.schema.names]
        return pa.RecordBatch.from_arrays([*key, *places, *fields.columns], names=names)


def _candidates(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row for each candidate, with places counted from the split's first piece, and a row for each split.

    Columns: file, block, at, content (where the record's block starts), next, exit, tin, tout and the fields. A
    split's own row has a null ``at`` and its bytes in ``next``. ``exit`` is the first place outside the split on
    the chain from here, null if the chain ends. Chains within a split are trees that grow together towards
    its end: a candidate is on the chain from an entry if the entry's ``tin`` is in [``tin``, ``tout``).
    """
    fields = {**_FIELDS, **({"payload": "binary"} if with_payload else {})}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column(0), batch.column(1).to_numpy()
            moved = pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
            bounds = [0, *(np.flatnonzero(moved) + 1).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                name = (file[a].as_py(), int(block[a]))
                if split is None or (split.file, split.block) != name:
                    if split is not None:
                        yield from split.rows()
                    split = _Split(*name)
                split.add(batch.slice(a, b - a), list(fields))
        if split is not None:
            yield from split.rows()

    kinds = {"file": "string", "block": "bigint", **dict.fromkeys(_PLACES, "bigint"), **fields}
    return map_batches(_parsed(_pieces(spark, path), with_payload), walk, ", ".join(map(" ".join, kinds.items())))


def _entries(candidates: DataFrame) -> DataFrame:
    """(file, at) of the start of each file and of the places where the chain from there enters a split.

    Places known so far take a step along pointers that are twice as long each round.
    """
    there = candidates.select("file", F.col("at").alias("exit"))
    crossed = candidates.select("file", "exit").filter("exit IS NOT NULL").distinct().join(there, ["file", "exit"])
    crossed = stored(crossed, "crossings")
    known = stored(candidates.filter("at = 0").select("file", "at"), "entries")
    nodes = crossed.select("file", F.col("exit").alias("at")).unionByName(known).distinct()
    pointers = candidates.select("file", "at", "exit").join(nodes, ["file", "at"])
    pointers = stored(pointers.join(crossed, ["file", "exit"]).select("file", "at", "exit"), "pointers")
    for _ in range(_MAX_ROUNDS):
        step = known.join(pointers, ["file", "at"]).select("file", F.col("exit").alias("at"))
        new = stored(step.join(known, ["file", "at"], "left_anti"), "entries")
        if new.isEmpty():
            return known
        known = stored(known.unionByName(new), "entries")
        onward = pointers.select("file", F.col("at").alias("exit"), F.col("exit").alias("far"))
        longer = pointers.join(onward, ["file", "exit"]).select("file", "at", F.col("far").alias("exit"))
        pointers = stored(longer, "pointers")
    raise RuntimeError(f"a chain crosses more than 2 ** {_MAX_ROUNDS} splits")


def _put_together(
    spark: SparkSession, path: str, records: DataFrame, splits: DataFrame, with_payload: bool
) -> DataFrame:
    """Records of several pieces: (file, at, payload_bytes, payload_digest), with the payload if asked for.

    Pieces are numbered as the scan reads them. Those of splits that such a record touches are moved, placed by
    running sums, and given to the last record that starts before them.
    """
    spans = splits.select("file", F.col("block").alias("of_block"), "base", "bytes")
    touched = records.select("file", "at", "content", "next", "is_http").join(spans, "file")
    touched = stored(touched.filter("base < next AND base + bytes > at"), "touched")
    blocks = touched.select("file", F.col("of_block").alias("block"), "base").distinct()
    numbered = _pieces(spark, path).withColumn("seq", F.monotonically_increasing_id())
    before = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.octet_length("value") + _CUT_BYTES).over(before), F.lit(0))
    record = F.struct("at", "content", "next", "is_http")
    pieces = numbered.join(blocks, ["file", "block"]).select(
        "file", "block", (F.col("base") + shift).alias("start"), F.col("value").cast("binary").alias("value")
    )
    starts = touched.select(
        "file", F.col("of_block").alias("block"), F.greatest("at", "base").alias("start"), record.alias("record")
    )
    in_order = Window.partitionBy("file", "block").orderBy("start", F.col("value").isNotNull())
    given = pieces.unionByName(starts, allowMissingColumns=True).withColumn(
        "record", F.last("record", ignorenulls=True).over(in_order)
    )
    mine = given.filter("value IS NOT NULL AND start < record.next").groupBy("file", "record").agg(
        F.collect_list(F.struct("start", "value")).alias("pieces")
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                about = batch.column(1)[i].as_py()
                parts = sorted((p["start"], p["value"]) for p in batch.column(2)[i].as_py())
                data = _CUT.encode().join(v for _, v in parts)
                first = about["content"] - parts[0][0]
                payload = data[first : first + about["next"] - len(_END) - about["content"]]
                if about["is_http"]:
                    payload = payload.partition(_END.encode())[2]
                rows.append((about["at"], len(payload), hashlib.sha1(payload).hexdigest(), payload))
            columns = [batch.column(0)]
            columns += [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            columns += [pa.array([r[3] for r in rows], pa.binary())] * with_payload
            names = ["file", "at", "payload_bytes", "payload_digest", *["payload"] * with_payload]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "file string, at bigint, payload_bytes bigint, payload_digest string" + ", payload binary" * with_payload
    return map_batches(mine, join, schema)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the uncompressed archives at ``path``, each file read in splits.

    Columns: file, offset, record_type, record_id and refers_to (names given by ``write_warc``, else empty),
    target_uri, declared_digest, payload_bytes, payload_digest (base32 SHA-1 of what was read), and the payload if
    asked for. The payload of an HTTP block is what stands behind its header. A record counts if it is
    reached from the file's start through the lengths of the records before it, and if it is complete;
    magic inside payloads, with whatever length it claims, does not count, and behind a broken length nothing more
    of that file does. Empty files have no records.
    """
    found = stored(_candidates(spark, path, with_payload), "candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = found.filter("at IS NULL").select(
        "file", "block", F.coalesce(F.sum("next").over(before), F.lit(0)).alias("base"), F.col("next").alias("bytes")
    )
    splits = stored(splits, "splits")
    placed = found.filter("at IS NOT NULL").join(splits.drop("bytes"), ["file", "block"])
    placed = placed.withColumns({c: F.col(c) + F.col("base") for c in ("at", "content", "next", "exit")})
    chain = placed.select("file", "block", "at", "exit", "tin")
    entered = _entries(chain).join(chain, ["file", "at"]).select("file", "block", F.col("tin").alias("entry"))
    entered = stored(entered, "entered")
    ends = splits.groupBy("file").agg((F.sum("bytes") - _CUT_BYTES).alias("file_end"))
    on_chain = (F.col("entry") >= F.col("tin")) & (F.col("entry") < F.col("tout")) & (F.col("next") <= F.col("file_end"))
    records = placed.join(entered, ["file", "block"]).join(ends, "file").filter(on_chain)
    measured = ["payload_bytes", "payload_digest", *["payload"] * with_payload]
    cut = records.filter("payload_digest IS NULL").drop(*measured)
    cut = stored(cut.select("file", "at", "content", "next", *list(_FIELDS)[:6]), "cut_records")
    whole = records.filter("payload_digest IS NOT NULL")
    columns = ["file", F.col("at").alias("offset"), *list(_FIELDS)[:5], *measured]
    out = whole.select(*columns)
    if not cut.isEmpty():
        out = out.unionByName(
            cut.join(_put_together(spark, path, cut, splits, with_payload), ["file", "at"]).select(*columns)
        )
    return out.withColumn("payload_digest", base32_of_hex(F.col("payload_digest")))


def with_originals(records: DataFrame) -> DataFrame:
    """Revisits with bytes and digest of the payload that they refer to; null if it is not there.

    The original is the record of that name whose payload has the digest that the revisit declares.
    """
    records = stored(records, "warc_records")
    is_revisit = F.col("record_type") == "revisit"
    originals = records.filter(~is_revisit).groupBy(
        F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("declared_digest")
    )
    originals = stored(originals.agg(F.first("payload_bytes").alias("original_bytes")), "originals")
    found = records.filter(is_revisit).join(originals, ["refers_to", "declared_digest"], "left")
    known = F.col("original_bytes").isNotNull()
    revisits = found.withColumns(
        {"payload_bytes": F.col("original_bytes"), "payload_digest": F.when(known, F.col("declared_digest"))}
    )
    return records.filter(~is_revisit).unionByName(revisits.select(*records.columns))
