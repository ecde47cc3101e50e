"""Best-fit packing of texts into token sequences of a fixed capacity.

Texts become pieces of at most ``capacity`` tokens in one pass. Packing is bulk-synchronous: items of
one length are alike, and so are open sequences with one gap, so a sweep deals with whole classes.
Sweeps go from the longest items down. In each, the items of a length look up their successor, the
smallest gap that holds them, and the items and gaps of a class are matched in rank order, so no
conflict is left; gaps shrink, items without a gap open sequences, and the next sweep follows.

A sweep needs only counts per length and per gap (at most ``capacity`` of each, whatever the data), and
leaves intervals of ranks. The items themselves are ranked within their length and matched to those
intervals by Spark; no item reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import astuple, dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarefind.llm.common import map_batches, stored

CAPACITY = 1024
END_ID = 2
_ROWS_PER_BUCKET = 100_000


class TextIds:
    """Token ids of a text as little-endian 32-bit numbers.

    The merges run on the vocabulary's ranks, which give the same ids as the tokenizer file several
    times as fast. A text with a special token of the file goes through the tokenizer itself.

    Look-ahead makes the pattern several times as slow and fails on very long runs of white space. Its
    one use is that such a run leaves its last character to what follows, so a text is cut there instead.
    """

    def __init__(self, tokenizer_file: str):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(tokenizer_file)
        special = {t.content for t in self._tokenizer.get_added_tokens_decoder().values()}
        letters = _byte_letters(pre_tokenizers.ByteLevel.alphabet())
        ranks = {
            bytes([letters[c] for c in token]): i
            for token, i in self._tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in special
        }
        self._encode = tiktoken.Encoding(
            "ranks", pat_str=_CUT_TEXT_PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._special = special

    def of(self, text: str) -> bytes:
        """The ids of a text."""
        if any(token in text for token in self._special):
            return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        cuts = [0, *[m.end() for m in _BEFORE_LAST_SPACE.finditer(text)], len(text)]
        return b"".join([array("I", self._encode(text[a:b])).tobytes() for a, b in zip(cuts, cuts[1:])])


# How the byte-level pre-tokenizer splits text, but for the look-ahead in its ``\s+(?!\S)|\s+``, and
# the characters that it takes as white space (``\s`` of Python has four more).
_CUT_TEXT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEFORE_LAST_SPACE = re.compile(f"[{_SPACE}](?=[{_SPACE}][^{_SPACE}])")


def _byte_letters(alphabet: Sequence[str]) -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on, in order.
    """
    own = [b for b in range(256) if chr(b) in set(alphabet)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _text_ids(tokenizer_file: str) -> TextIds:
    return TextIds(tokenizer_file)


def token_pieces(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Each text as pieces of at most ``capacity`` ids: (id, piece, start, length, ids_crc32[, ids]).

    A text's ids are followed by ``end_id``. Only longer ones are cut: all pieces are full but the first,
    which takes what is left over. A null text counts as empty and is one piece of one id. Null ids and
    repeated rows are kept as they are. No shuffle.
    """
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, end = _text_ids(tokenizer_file).of, array("I", [end_id]).tobytes()
        for batch in batches:
            rows, source = [], []
            for place, text in enumerate(batch.column(1).to_pylist()):
                data = of(text or "") + end
                n = len(data) // 4
                at = piece = 0
                to = n % capacity or min(n, capacity)
                while at < n:
                    ids = data[4 * at : 4 * to]
                    rows.append((piece, at, to - at, zlib.crc32(ids), ids if with_ids else None))
                    source.append(place)
                    piece, at, to = piece + 1, to, to + capacity
            columns = [
                batch.column(0).take(pa.array(source, pa.int64())),
                pa.array([r[0] for r in rows], pa.int32()),
                *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)],
            ]
            if with_ids:
                lists = [array("I", r[4]).tolist() for r in rows]
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(
        docs.select(id_col, text_col), cut, schema + ", ids array<int>" * with_ids
    )


@dataclass(frozen=True)
class Placement:
    """Items of a length with ranks [first, last) go ``each`` to a sequence, from ``sequence`` on."""

    length: int
    first: int
    last: int
    each: int
    sequence: int
    offset: int


def best_fit_sweeps(counts: Mapping[int, int], capacity: int) -> list[Placement]:
    """Best-fit decreasing over classes: item counts per length to intervals of ranks.

    ``gaps[g]`` holds runs (first sequence, how many) of sequences with a gap of g. An interval is made
    only where a run of gaps is used up or a class of items ends.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    out: list[Placement] = []
    opened = 0

    for length in sorted(counts, reverse=True):
        total, rank = counts[length], 0

        def place(start: int, n: int, gap: int) -> int:
            """Fill n sequences with this gap from ``start`` on; returns how many stay unused."""
            nonlocal rank
            fits, offset = gap // length, capacity - gap
            full = min(n, (total - rank) // fits)
            if full:
                out.append(Placement(length, rank, rank + full * fits, fits, start, offset))
                rank += full * fits
                gaps[gap - fits * length].append((start, full))
            rest = total - rank
            if full < n and rest:
                out.append(Placement(length, rank, total, rest, start + full, offset))
                gaps[gap - rest * length].append((start + full, 1))
                rank, full = total, full + 1
            return n - full

        for gap in sorted(g for g in gaps if g >= length):
            runs = gaps.pop(gap)
            while runs and rank < total:
                start, n = runs.pop()
                unused = place(start, n, gap)
                if unused:
                    runs.append((start + n - unused, unused))
            if runs:
                gaps[gap].extend(runs)
            if rank == total:
                break
        if rank < total:
            new = -(-(total - rank) // (capacity // length))
            place(opened, new, capacity)
            opened += new
    return out


def _ranked(items: DataFrame, length: str, order: Sequence[str]) -> DataFrame:
    """Add ``_rank``, 0, 1, ... within each length, fixed by the rows themselves.

    Rows of a length are dealt into hash buckets of bounded size, so that a length that most items have
    is ranked by many tasks; a running sum of bucket counts gives where each bucket starts.
    """
    n = items.count()
    buckets = max(1, -(-n // _ROWS_PER_BUCKET))
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("_bucket")
    dealt = items.select("*", bucket)
    before = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy(length, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(length, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(length, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, [length, "_bucket"])
        .withColumn("_rank", F.col("_base") + F.col("_inside"))
        .drop("_bucket", "_base", "_inside")
    )


def pack(
    items: DataFrame, order: Sequence[str], capacity: int = CAPACITY, length: str = "length"
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every item: best-fit decreasing into sequences.

    ``order`` names columns that tell items of a length apart; rows equal in all of them share what is
    interchangeable. Items longer than ``capacity`` are an error; empty or null lengths likewise. Offsets
    run from 0 without gaps in each sequence. An empty table stays empty.

    ``items`` is read three times (counts, bucket sizes, rows): pass a stored table. The intervals are
    broadcast; there is at most one for each pair of a length and a gap.
    """
    spark = items.sparkSession
    counts = {r[length]: r["n"] for r in items.groupBy(length).agg(F.count("*").alias("n")).collect()}
    wrong = [x for x in counts if x is None or not 1 <= x <= capacity]
    if wrong:
        raise ValueError(f"lengths must be from 1 to {capacity}: {wrong[:5]}")
    plan = [astuple(p) for p in best_fit_sweeps(counts, capacity)]
    fields = ("_length", "_first", "_last", "_each", "_sequence", "_offset")
    intervals = spark.createDataFrame(plan, ", ".join(f"{f} bigint" for f in fields))
    ranked = _ranked(items, length, order)
    inside = F.col("_rank") - F.col("_first")
    hit = (
        (F.col(length) == F.col("_length"))
        & (F.col("_rank") >= F.col("_first"))
        & (F.col("_rank") < F.col("_last"))
    )
    return (
        ranked.join(F.broadcast(intervals), hit)
        .withColumn("sequence_id", F.col("_sequence") + F.floor(inside / F.col("_each")))
        .withColumn("offset", F.col("_offset") + inside % F.col("_each") * F.col("_length"))
        .drop("_rank", *fields)
    )


def pack_texts(
    docs: DataFrame,
    tokenizer_file: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of every whole text with their place in a sequence.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset. Pieces are stored once in the
    shared folder (a few numbers each), so texts are read and tokenized once.
    """
    pieces = stored(
        token_pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col), "pieces"
    )
    return pack(pieces, [id_col, "piece", "start", "ids_crc32"], capacity)
