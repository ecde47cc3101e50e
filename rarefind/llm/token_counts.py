"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over characters. Each node carries a failure link, as in Aho-Corasick, and
the number of tokens that greedy matching has finished when that link is taken. Walking a word
through the automaton adds up those numbers: one step per character and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from rarefind.llm.common import Memo, map_batches, words

WORD_START = "▁"
_MEMO_WORDS = 200_000
_ROOT = 0


class LongestMatchCounter:
    """Counts the pieces of greedy longest matching without making them.

    A character that no piece starts with costs as many tokens as it has UTF-8 bytes, as with byte
    fallback. Every character of the vocabulary is made a piece of its own (at that cost if it is not
    listed), so that matching never gets stuck inside a word.
    """

    def __init__(self, pieces: Iterable[str]):
        self._next: list[dict[str, int]] = [{}]
        cost: list[int] = [0]  # tokens a node stands for if it is a piece, else 0

        def node(text: str) -> int:
            at = _ROOT
            for c in text:
                if c not in self._next[at]:
                    self._next[at][c] = len(self._next)
                    self._next.append({})
                    cost.append(0)
                at = self._next[at][c]
            return at

        listed = [p for p in pieces if p]
        for p in listed:
            cost[node(p)] = 1
        for c in sorted({c for p in listed for c in p}):
            single = node(c)
            cost[single] = cost[single] or len(c.encode())

        n = len(self._next)
        self._link, self._popped, self._left = [_ROOT] * n, [0] * n, [0] * n
        queue = deque([_ROOT])
        while queue:
            u = queue.popleft()
            for c, v in self._next[u].items():
                queue.append(v)
                if cost[v]:
                    self._popped[v] = cost[v]
                else:
                    z, popped = self._link[u], self._popped[u]
                    while c not in self._next[z]:
                        popped += self._popped[z]
                        z = self._link[z]
                    self._link[v], self._popped[v] = self._next[z][c], popped
                self._left[v] = self._popped[v] + self._left[self._link[v]]

    def count(self, text: str) -> int:
        """Tokens of one word."""
        following, link, popped = self._next, self._link, self._popped
        at = total = 0
        for c in text:
            to = following[at].get(c)
            while to is None and at != _ROOT:
                total += popped[at]
                at = link[at]
                to = following[at].get(c)
            if to is None:
                total += len(c.encode("utf-8", "surrogatepass"))
            else:
                at = to
        return total + self._left[at]


@lru_cache(maxsize=2)
def _word_counts(model_file: str, memo_words: int) -> Memo:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    counter = LongestMatchCounter(pieces)
    return Memo(lambda word: counter.count(WORD_START + word), memo_words)


def token_counts(
    docs: DataFrame,
    model_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    memo_words: int = _MEMO_WORDS,
) -> DataFrame:
    """Words and greedy word-piece tokens of every whole text: (id, n_words, n_tokens).

    ``model_file`` names a sentencepiece model whose pieces mark a word's start with U+2581. Words
    are runs without ASCII white space. One row per input row, in its own partition: no shuffle.
    A null or empty text has 0 words and 0 tokens; a null id is kept; other columns are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_word = _word_counts(model_file, memo_words)
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                found = words(text) if text else []
                n_words.append(len(found))
                n_tokens.append(sum(map(of_word.__getitem__, found)))
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(id_col, text_col), count, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint"
    )
