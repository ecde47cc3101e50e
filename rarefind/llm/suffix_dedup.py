"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes are bucketed digit by digit, the most significant first, and no deeper than the window. What is
alone in its bucket is unique and drops out; suffixes still together after the last digit start equal
windows. Buckets hold hashes of digits, and each pass is a Spark aggregate.

1. *Anchors.* Of the suffixes, one in a hundred or so stands for its neighbours: windows are grouped in runs
   by their anchor, the slice of ``CORE`` bytes with the least hash inside them. Equal windows have equal
   anchors. The first digit is the anchor's slice: a run whose slice occurs once holds no repeated window.
2. *Whole runs.* Where all runs of a bucket are equal, all their windows are repeated. In other buckets,
   runs are counted by their bytes, and one of each kind goes on.
3. *Blocks.* Windows at ``BLOCK`` neighbouring places before the anchor share most bytes. These are the next
   digit; blocks that share them with none drop out, and blocks that are equal throughout are repeated.
4. *Windows.* What is left is compared by all bytes of each window.

Hashes have 64 bits and every bucket is keyed by the digits before as well, so that windows are told apart
by 128 bits or more.

The same passes find repeated windows of words: places are then words, each a 64-bit hash, instead of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefind.llm.bloom import build_bloom
from rarefind.llm.byte_windows import CHUNK, SliceHashes, anchors
from rarefind.llm.common import Memo, discard, map_batches, stored

WINDOW = 400
CORE_SHARE = 0.32
BLOCK = 32
#: Words of the shortest passage that counts as more than 50.
WORD_WINDOW = 51
_FILTER_BITS = 1 << 27
_MEMO_WORDS = 200_000
_BYTE, _WORD = np.dtype(np.uint8), np.dtype(np.uint64)


class _Reader:
    """What the windows of a text are made of: its bytes, or its words as numbers.

    Words are runs without ASCII white space, told apart by case.
    """

    def __init__(self, unit: np.dtype):
        self._unit, self._numbers = unit, Memo(xxhash.xxh3_64_intdigest, _MEMO_WORDS)

    def places(self, data: bytes) -> np.ndarray:
        if self._unit == _BYTE:
            return np.frombuffer(data, np.uint8)
        found = data.split()
        return np.fromiter(map(self._numbers.__getitem__, found), np.uint64, len(found))


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and stop, in bytes."""
    x = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = ~((x == 32) | ((x >= 9) & (x <= 13)))
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Rows as (_id, _hash, _text): the id with a hash of the text names a row or equal ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"), *more)


def _same_row(left: str, right: str) -> Column:
    """Null-safe on the id; an equi-join all the same."""
    a, b = F.col(f"{left}._id"), F.col(f"{right}._id")
    return a.eqNullSafe(b) & (F.col(f"{left}._hash") == F.col(f"{right}._hash"))


def _runs(texts: DataFrame, window: int, core: int, unit: np.dtype) -> DataFrame:
    """Pass 1's rows, a run of windows each: (_id, _hash, first, count, inside, core, whole)."""
    fields = ("first", "count", "inside", "core", "whole")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(unit)
        for batch in batches:
            source, found = [], {f: [] for f in fields}
            for i in range(batch.num_rows):
                for part in anchors(reader.places(batch.column(2)[i].as_buffer().to_pybytes()), window, core):
                    source.append(np.full(len(part.first), i))
                    for f in fields:
                        found[f].append(getattr(part, f))
            rows = pa.array(np.concatenate(source) if source else [], pa.int64())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows)]
            columns += [pa.array(np.concatenate(v) if v else [], pa.int64()) for v in found.values()]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_hash", *fields])

    kind = texts.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _hash bigint, " + ", ".join(f"{f} bigint" for f in fields)
    return map_batches(texts, find, schema)


def _bytes_of_runs(texts: DataFrame, kinds: DataFrame, window: int, unit: np.dtype) -> DataFrame:
    """One run of each kind with its bytes, cut out of its text: (_id, _hash, first, count, inside, core, data)."""
    mine = kinds.groupBy("_id", "_hash").agg(
        F.collect_list(F.struct("first", "count", "inside", "core")).alias("runs")
    )
    joined = texts.alias("t").join(mine.alias("m"), _same_row("t", "m")).select("t._id", "t._hash", "_text", "runs")
    fields = ("first", "count", "inside", "core")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(unit)
        for batch in batches:
            source, rows, data = [], [], []
            for i in range(batch.num_rows):
                places = reader.places(batch.column(2)[i].as_buffer().to_pybytes())
                for run in batch.column(3)[i].as_py():
                    source.append(i)
                    rows.append([run[f] for f in fields])
                    data.append(places[run["first"] : run["first"] + run["count"] + window - 1].tobytes())
            at = pa.array(source, pa.int64())
            columns = [batch.column(0).take(at), batch.column(1).take(at)]
            columns += [pa.array([r[j] for r in rows], pa.int64()) for j in range(len(fields))]
            columns.append(pa.array(data, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_hash", *fields, "data"])

    kind = texts.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _hash bigint, " + ", ".join(f"{f} bigint" for f in fields) + ", data binary"
    # Rows that are equal in id and text come more than once, and their windows do occur more than once.
    return map_batches(joined, cut, schema)


def _in_slabs(
    batch: pa.RecordBatch, column: int, unit: np.dtype
) -> Iterator[tuple[np.ndarray, SliceHashes, np.ndarray]]:
    """Rows of a batch in groups whose places fit a chunk: (row numbers, hashes, where each row's places start)."""
    sizes = [v.as_buffer().size // unit.itemsize for v in batch.column(column)]
    at = 0
    while at < len(sizes):
        to, total = at, 0
        while to < len(sizes) and (to == at or total + sizes[to] <= CHUNK):
            total += sizes[to]
            to += 1
        data = b"".join(batch.column(column)[i].as_buffer().to_pybytes() for i in range(at, to))
        starts = np.concatenate(([0], np.cumsum(sizes[at:to])[:-1])).astype(np.int64)
        yield np.arange(at, to), SliceHashes(np.frombuffer(data, unit)), starts
        at = to


def _repeat_each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with n parts each: the row and the number within the row of every part."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _blocks(kinds: DataFrame, window: int, block: int, unit: np.dtype) -> DataFrame:
    """Pass 3's rows: (ref, core, place, shared, union, start, windows), with ``start`` relative to the run."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, inside = (batch.column(i).to_numpy() for i in (2, 3))
            for rows, hashes, begin in _in_slabs(batch, 4, unit):
                last, first = inside[rows], inside[rows] - count[rows] + 1
                row, number = _repeat_each(last // block - first // block + 1)
                place = first[row] // block + number
                far = np.minimum(last[row], block * place + block - 1)
                near = np.maximum(first[row], block * place)
                start, windows = last[row] - far, far - near + 1
                shared_from = begin[row] + last[row] - block * place
                shared_to = shared_from - (block - 1) + window
                union_from = begin[row] + start
                names = ["ref", "core", "place", "shared", "union", "start", "windows"]
                arrays = [
                    batch.column(0).take(pa.array(rows[row])),
                    batch.column(1).take(pa.array(rows[row])),
                    *map(pa.array, (
                        place,
                        hashes.of(shared_from, shared_to).view(np.int64),
                        hashes.of(union_from, union_from + windows - 1 + window).view(np.int64),
                        start,
                        windows,
                    )),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "ref bigint, core bigint, place bigint, shared bigint, union bigint, start bigint, windows bigint"
    return map_batches(kinds.select("ref", "core", "count", "inside", "data"), split, schema)


def _windows(blocks: DataFrame, window: int, unit: np.dtype) -> DataFrame:
    """Pass 4's rows, single windows: (ref, core, at, bytes_hash), with ``at`` relative to the run."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            start = batch.column(3).to_numpy()
            for rows, hashes, begin in _in_slabs(batch, 4, unit):
                row, number = _repeat_each(n[rows])
                at = begin[row] + number
                arrays = [
                    batch.column(0).take(pa.array(rows[row])),
                    batch.column(1).take(pa.array(rows[row])),
                    pa.array(start[rows][row] + number),
                    pa.array(hashes.of(at, at + window).view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["ref", "core", "at", "bytes_hash"])

    schema = "ref bigint, core bigint, at bigint, bytes_hash bigint"
    return map_batches(blocks.select("ref", "core", "windows", "start", "data"), split, schema)


def _buckets(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Buckets with more than one row: the key, and whether all values are equal; stored.

    Rows then meet a stored table of keys in a plain join, which Spark splits where a bucket is large.
    """
    counted = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min(value).alias("_a"), F.max(value).alias("_b"))
    return stored(counted.filter(F.col("_n") > 1).select(*key, (F.col("_a") == F.col("_b")).alias("alike")), "buckets")


def repeated_runs(
    docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, in_words: bool = False
) -> DataFrame:
    """Runs of windows that also start elsewhere: (_id, _hash, first, count), stored.

    ``_hash`` is ``xxhash64`` of the text. Places count UTF-8 bytes, or words. A run may come more than once.
    """
    unit = _WORD if in_words else _BYTE
    block = min(BLOCK, window)
    texts = _texts(docs, id_col, text_col)
    core = max(1, round(window * CORE_SHARE))
    runs = stored(_runs(texts, window, core, unit), "runs")
    of_core = _buckets(runs, ["core"], "whole")
    tied = stored(runs.join(of_core, "core"), "tied_runs")
    discard(runs, of_core)

    place = ["_id", "_hash", "first", "count"]
    alike = tied.filter("alike").select(*place)
    mixed = tied.filter("NOT alike")
    kinds = mixed.groupBy("core", "whole").agg(
        F.count("*").alias("copies"), F.min(F.struct(*place, "inside")).alias("run")
    )
    kinds = stored(kinds, "run_kinds")
    copied = mixed.join(kinds.filter("copies > 1").select("core", "whole"), ["core", "whole"]).select(*place)

    one_each = kinds.select("core", "run.*")
    cut = _bytes_of_runs(texts, one_each, window, unit).withColumn("ref", F.monotonically_increasing_id())
    cut = stored(cut, "run_bytes")
    blocks = stored(_blocks(cut, window, block, unit), "blocks")
    of_block = _buckets(blocks, ["core", "place", "shared"], "union")
    met = blocks.join(of_block, ["core", "place", "shared"])
    met = stored(met.select("ref", "core", "start", "windows", "alike"), "met_blocks")
    discard(blocks, of_block)
    even = met.filter("alike").select("ref", F.col("start").alias("at"), F.col("windows").alias("n"))

    width = unit.itemsize
    begin, length = F.col("start") * width + 1, (F.col("windows") + window - 1) * width
    bytes_of_block = F.substring(F.col("data"), begin.cast("int"), length.cast("int"))
    open_blocks = met.filter("NOT alike").join(cut.select("ref", "data"), "ref").withColumn("data", bytes_of_block)
    single = stored(_windows(open_blocks, window, unit), "windows")
    equal = single.groupBy("core", "bytes_hash").count().filter("count > 1").select("core", "bytes_hash")
    equal = stored(equal, "equal_windows")
    last = single.join(equal, ["core", "bytes_hash"]).select("ref", "at", F.lit(1).cast("bigint").alias("n"))

    compared = even.unionByName(last).join(cut.select("ref", "_id", "_hash", "first"), "ref").select(
        "_id", "_hash", (F.col("first") + F.col("at")).alias("first"), F.col("n").alias("count")
    )
    found = stored(alike.unionByName(copied).unionByName(compared), "repeated")
    discard(tied, kinds, cut, met, single, equal)
    return found


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    with_kept: bool = False,
    word_window: int | None = None,
    passage_words: int | None = None,
) -> DataFrame:
    """Remove every byte covered by a window of ``window`` bytes that also starts anywhere else.

    With ``word_window``, also every window of so many words that also starts anywhere else, from its first
    word to its last; what stands between words is not compared. With ``passage_words`` such windows are found and
    counted in columns of their own, and stay in the text: n_passages (maximal stretches) and n_passage_bytes.

    Columns: id, n_bytes, n_removed, n_spans (maximal removed stretches), kept_sha256. With ``with_kept``
    also ``kept``, the text that is left (a character cut in two goes; one space stands where a cut would join two
    words), and ``row``, a struct of the input columns. Texts are UTF-8; a null text counts as empty. Both copies of a window go, within one text or
    across texts; windows are judged on the input. Rows that are equal in id and text count as separate
    texts. Ids may be null or repeat. Texts shorter than the window stay whole.

    Texts are read in place. Only those that a fixed-size Bloom filter takes for ones with a repeated window
    are moved to meet their runs.
    """
    if word_window and passage_words:
        raise ValueError("windows of words are either removed or counted")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns] if with_kept else [F.lit(0).alias("none")]).alias("row")
    texts = _texts(docs, id_col, text_col, row)
    runs = repeated_runs(docs, id_col, text_col, window).withColumn("in_words", F.lit(False))
    words_each = word_window or passage_words
    if words_each:
        of_words = repeated_runs(docs, id_col, text_col, words_each, in_words=True)
        runs = runs.unionByName(of_words.withColumn("in_words", F.lit(True)))
    mine = runs.groupBy("_id", "_hash").agg(F.collect_set(F.struct("first", "count", "in_words")).alias("runs"))
    rows = runs.select("_id", "_hash").distinct()
    hit = build_bloom(rows, rows.count(), 0.02, max_bits=_FILTER_BITS).may_contain(F.col("_id"), F.col("_hash"))

    numbers = ["n_bytes", "n_removed", "n_spans", "n_passages", "n_passage_bytes"]
    more = [id_col, *numbers, "kept_sha256", "kept", "row"]
    names = [id_col, *numbers[:3], "kept_sha256"]
    names += numbers[3:] if passage_words else []
    names += ["kept", "row"] if with_kept else []
    zero = F.lit(0).cast("bigint")
    clean = texts.filter(~hit).select(
        F.col("_id").alias(id_col),
        F.octet_length("_text").cast("bigint").alias("n_bytes"),
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        zero.alias("n_passages"),
        zero.alias("n_passage_bytes"),
        F.sha2(F.col("_text").cast("binary"), 256).alias("kept_sha256"),
        F.col("_text").alias("kept"),
        "row",
    )
    met = texts.filter(hit).alias("t").join(mine.alias("m"), _same_row("t", "m"), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_buffer().to_pybytes()
                runs = batch.column(2)[i].as_py() or []
                of_words = [r for r in runs if r["in_words"]]
                cut = runs if word_window else [r for r in runs if not r["in_words"]]
                parts = parts_without_runs(data, cut, window, word_window)
                around = parts_without_runs(data, of_words, window, words_each) if passage_words else [data]
                kept = b"".join(parts)
                text = with_words_apart(parts).decode("utf-8", "ignore") if with_kept else ""
                digest = hashlib.sha256(kept).hexdigest()
                passages = len(around) - 1, len(data) - sum(map(len, around))
                rows.append((len(data), len(data) - len(kept), len(parts) - 1, *passages, digest, text))
            columns = [batch.column(0), *[pa.array([r[j] for r in rows], pa.int64()) for j in range(5)]]
            columns += [pa.array([r[j] for r in rows], pa.string()) for j in (5, 6)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(3)], names=more)

    types = dict(clean.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in more)
    removed = map_batches(met.select("t._id", "_text", "runs", "row"), remove, schema)
    return clean.unionByName(removed).select(*names)


def parts_without_runs(data: bytes, runs: list[dict], window: int, word_window: int | None = None) -> list[bytes]:
    """The bytes before, between and after the maximal stretches that windows of the runs cover."""
    stretches = [(r["first"], r["first"] + r["count"] + window - 1) for r in runs if not r["in_words"]]
    of_words = [r for r in runs if r["in_words"]]
    if of_words:
        starts, stops = word_bounds(data)
        stretches += [
            (int(starts[r["first"]]), int(stops[r["first"] + r["count"] + word_window - 2])) for r in of_words
        ]
    kept, at, end = [], 0, -1
    for first, stop in sorted(stretches):
        if first > end:
            kept.append(data[at:first])
            end = at = stop
        elif stop > end:
            end = at = stop
    kept.append(data[at:])
    return kept


def with_words_apart(parts: list[bytes]) -> bytes:
    """The parts joined, with a space where two words would meet."""
    out = bytearray(parts[0])
    for part in parts[1:]:
        if out and part and not out[-1:].isspace() and not part[:1].isspace():
            out += b" "
        out += part
    return bytes(out)
