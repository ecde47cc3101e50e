"""Byte-level BPE through sentencepiece: a BPE model is written straight from a rank file.

Byte b is mapped to the letter U+0100 + b, so each vocabulary entry is a text of such letters. A
piece's score is its negative rank, so sentencepiece merges in rank order; normalisation is the
identity. Pre-tokens are encoded one by one and decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from rarefind.llm.common import RecentMemo, in_chunks, map_batches, spaced_parts

_BASE = 0x100
_MEMO_PIECES = 250_000

# Field numbers and enums of the sentencepiece model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_PIECE_TEXT, _PIECE_SCORE, _PIECE_TYPE = 1, 2, 3
_TYPE_NORMAL, _TYPE_UNKNOWN = 1, 2
_TRAINER_MODEL_TYPE, _MODEL_TYPE_BPE = 3, 2
_NORMALIZER_NAME, _ADD_DUMMY_PREFIX, _REMOVE_EXTRA_SPACE, _ESCAPE_SPACE = 1, 3, 4, 5


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


_LETTERS = [chr(_BASE + b) for b in range(256)]


def as_letters(data: bytes) -> str:
    return "".join(map(_LETTERS.__getitem__, data))


def as_bytes(letters: str) -> bytes:
    return bytes([ord(c) - _BASE for c in letters])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A serialized sentencepiece BPE model whose piece ids are the ranks.

    Ranks have to run from 0 without gaps. The format wants an unknown piece; it comes last, and
    cannot occur as every byte is a piece.
    """
    in_order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in in_order] != list(range(len(in_order))):
        raise ValueError("ranks must run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must have a rank")
    out = bytearray()
    for rank, token in enumerate(in_order):
        piece = (
            _block(_PIECE_TEXT, as_letters(token).encode())
            + _varint(_PIECE_SCORE << 3 | 5)
            + struct.pack("<f", -float(rank))
            + _number(_PIECE_TYPE, _TYPE_NORMAL)
        )
        out += _block(_PIECES, piece)
    unknown = _block(_PIECE_TEXT, b"<unk>") + _number(_PIECE_TYPE, _TYPE_UNKNOWN)
    out += _block(_PIECES, unknown)
    out += _block(_TRAINER, _number(_TRAINER_MODEL_TYPE, _MODEL_TYPE_BPE))
    identity = _block(_NORMALIZER_NAME, b"identity") + b"".join(
        _number(field, 0) for field in (_ADD_DUMMY_PREFIX, _REMOVE_EXTRA_SPACE, _ESCAPE_SPACE)
    )
    out += _block(_NORMALIZER, identity)
    return bytes(out)


class ByteBpe:
    """Encodes pre-tokens with sentencepiece and decodes ids by the inverse mapping."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor()
        self._model.LoadFromSerializedProto(model_proto(ranks))
        self._pattern = regex.compile(pattern)
        self._token_bytes = [
            as_bytes(self._model.id_to_piece(i)) for i in range(self._model.get_piece_size() - 1)
        ]
        self._whole = ranks

    def pre_tokens(self, text: str) -> list[str]:
        return self._pattern.findall(text)

    def encode_pre_token(self, pre_token: str) -> list[int]:
        """A pre-token that is itself in the vocabulary is that token; all others are merged."""
        data = pre_token.encode("utf-8", "surrogatepass")
        whole = self._whole.get(data)
        return [whole] if whole is not None else self._model.encode(as_letters(data))

    def _pre_tokens_of_parts(self, parts: list[str]) -> list[list[str]]:
        """Pre-tokens of each part, the pattern run over all of them at once.

        A part that starts with a space and another character cannot be joined to what precedes it.
        """
        plain = [len(p) > 1 and p[0] == " " and not p[1].isspace() for p in parts]
        joined = iter(self.pre_tokens("".join([p for p, ok in zip(parts, plain) if ok])))
        cut = []
        for part, ok in zip(parts, plain):
            tokens, left = [], len(part)
            while ok and left:
                tokens.append(token := next(joined))
                left -= len(token)
            cut.append(tokens if ok else self.pre_tokens(part))
        return cut

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """The ids of each part; pre-tokens of all parts go to the model together, each once."""
        cut = self._pre_tokens_of_parts(parts)
        distinct = list({t for tokens in cut for t in tokens})
        data = [t.encode("utf-8", "surrogatepass") for t in distinct]
        merged = self._model.encode([as_letters(d) for d in data], num_threads=1)
        ids = {
            t: m if (whole := self._whole.get(d)) is None else [whole]
            for t, d, m in zip(distinct, data, merged)
        }
        return [ids[t[0]] if len(t) == 1 else [i for x in t for i in ids[x]] for t in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self._token_bytes[i] for i in ids])


class TextCodec:
    """Per text: number of ids, hash of the ids, hash of the decoded bytes.

    Texts are cut into parts that pre-tokens never cross (see ``spaced_parts``); each distinct part is
    encoded and its ids are decoded again. A part's ids are kept as text.
    """

    def __init__(self, bpe: ByteBpe, limit: int):
        self._bpe = bpe
        self._memo = RecentMemo(self._encode, limit)

    def _encode(self, parts: list[str]) -> list[tuple[str, bytes | None]]:
        """Ids as text, and the decoded bytes where they are not the part's own."""
        rows = []
        for part, ids in zip(parts, self._bpe.encode_parts(parts)):
            decoded = self._bpe.decode(ids)
            own = decoded == part.encode("utf-8", "surrogatepass")
            rows.append((",".join(map(str, ids)), None if own else decoded))
        return rows

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        cut = [spaced_parts(text) for text in texts]
        known = self._memo.lookup(set().union(*cut))
        altered = {part: data for part, (_, data) in known.items() if data is not None}
        of, rows = {part: ids for part, (ids, _) in known.items()}, []
        for text, parts in zip(texts, cut):
            ids = ",".join(filter(None, [of[p] for p in parts]))
            decoded = text.encode("utf-8", "surrogatepass")
            if altered and not altered.keys().isdisjoint(parts):
                decoded = b"".join(
                    [altered.get(p, p.encode("utf-8", "surrogatepass")) for p in parts]
                )
            rows.append(
                (
                    ids.count(",") + 1 if ids else 0,
                    hashlib.sha256(ids.encode()).hexdigest(),
                    hashlib.sha256(decoded).hexdigest(),
                )
            )
        return rows


@lru_cache(maxsize=2)
def _bpe(rank_file: str, pattern: str) -> ByteBpe:
    return ByteBpe(load_ranks(rank_file), pattern)


@lru_cache(maxsize=2)
def _codec(rank_file: str, pattern: str, limit: int) -> TextCodec:
    return TextCodec(_bpe(rank_file, pattern), limit)


def encode_texts(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The ids of every whole text: (id, ids array<int>). A null text has no ids; no shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(rank_file, pattern)
        for batch in batches:
            ids = [
                [i for p in bpe.pre_tokens(text or "") for i in bpe.encode_pre_token(p)]
                for text in batch.column(1).to_pylist()
            ]
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), encode, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(
    encoded: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """The bytes of every list of ids: (id, data binary). Null lists give no bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(rank_file, pattern)
        for batch in batches:
            data = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "data"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(id_col, ids_col), decode, f"`{id_col}` {kind}, data binary")


def codec_digests(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    memo_pieces: int = _MEMO_PIECES,
) -> DataFrame:
    """Encode and decode every whole text and return (id, n_tokens, ids_sha256, decoded_sha256).

    Works where the row lies: no shuffle, and a worker holds one batch and a bounded memo of
    pre-tokens. A null text counts as empty: 0 tokens and the hash of nothing. Null ids, repeated
    rows and further columns do no harm; only the id is carried over.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(rank_file, pattern, memo_pieces)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            rows = [r for some in in_chunks(texts) for r in codec.digests(some)]
            columns = [
                batch.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string()),
            ]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(id_col, text_col),
        digest,
        f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
