"""Licence scans: phrases and tags by Aho-Corasick, licence expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from rarefind.llm.common import lower_ascii, map_batches

#: Phrases (as words) and labels that every scan counts.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Notices, beyond the base phrases, that name a licence.
NOTICES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license version 2": "mpl-2",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "permission to use copy modify and distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license version 1": "bsl-1",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "business source license": "busl",
    "server side public license": "sspl",
}

#: Words that keep every right. They say so only where nothing else in the text grants any: the usual headers of free
#: licences start with them.
RESERVATIONS = {"all rights reserved": "proprietary"}

TAG = "spdx license identifier"

#: Labels of identifiers in tags, and how freely each licence lets a text be used (1: freely).
IDENTIFIERS = {
    "0bsd": "0bsd",
    "agpl-1.0": "agpl",
    "agpl-3.0": "agpl",
    "apache-1.1": "apache-1",
    "apache-2.0": "apache-2",
    "artistic-2.0": "artistic-2",
    "bsd-2-clause": "bsd",
    "bsd-3-clause": "bsd",
    "bsd-3-clause-clear": "bsd",
    "bsd-4-clause": "bsd",
    "bsl-1.0": "bsl-1",
    "busl-1.1": "busl",
    "cc-by-3.0": "cc-by",
    "cc-by-4.0": "cc-by",
    "cc-by-nc-3.0": "cc-by-nc",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nc-nd-4.0": "cc-by-nc",
    "cc-by-nc-sa-4.0": "cc-by-nc",
    "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-sa-3.0": "cc-by-sa",
    "cc-by-sa-4.0": "cc-by-sa",
    "cc0-1.0": "cc0",
    "cddl-1.0": "cddl",
    "cddl-1.1": "cddl",
    "epl-1.0": "epl",
    "epl-2.0": "epl",
    "eupl-1.2": "eupl",
    "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3",
    "isc": "isc",
    "lgpl-2.0": "lgpl",
    "lgpl-2.1": "lgpl",
    "lgpl-3.0": "lgpl",
    "mit": "mit",
    "mit-0": "mit",
    "mpl-1.1": "mpl-1",
    "mpl-2.0": "mpl-2",
    "ms-pl": "ms-pl",
    "ncsa": "ncsa",
    "odbl-1.0": "odbl",
    "ofl-1.1": "ofl",
    "postgresql": "postgresql",
    "psf-2.0": "python",
    "python-2.0": "python",
    "sspl-1.0": "sspl",
    "unlicense": "unlicense",
    "wtfpl": "wtfpl",
    "x11": "mit",
    "zlib": "zlib",
}
FREEDOM = {
    "0bsd": 1.0,
    "cc0": 1.0,
    "unlicense": 1.0,
    "wtfpl": 1.0,
    "mit": 1.0,
    "bsd": 1.0,
    "isc": 1.0,
    "zlib": 1.0,
    "bsl-1": 1.0,
    "ncsa": 1.0,
    "postgresql": 1.0,
    "python": 0.95,
    "apache-1": 0.95,
    "apache-2": 0.95,
    "cc-by": 0.9,
    "artistic-2": 0.8,
    "ofl": 0.8,
    "ms-pl": 0.7,
    "mpl-1": 0.7,
    "mpl-2": 0.7,
    "cddl": 0.65,
    "epl": 0.65,
    "eupl": 0.6,
    "cc-by-sa": 0.6,
    "lgpl": 0.6,
    "odbl": 0.6,
    "gpl-2": 0.4,
    "gpl-3": 0.4,
    "agpl": 0.3,
    "sspl": 0.2,
    "busl": 0.2,
    "cc-by-nd": 0.2,
    "cc-by-nc": 0.2,
    "proprietary": 0.0,
}
UNKNOWN_FREEDOM = 0.5
#: A licence WITH an exception is freer by this share of what it lacks.
EXCEPTION_GAIN = 0.5

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TAG_HIT = re.compile(r"spdx-license-identifier:[ \t]*")
_LINE_END = re.compile(r"[\n\r]")
_EXPRESSION_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


#: Labels and freedom of a part of an expression.
_Operand = tuple[set[str], float]


@dataclass(frozen=True)
class Terms:
    """What an expression comes to: the licences it names and how freely the text may be used."""

    labels: frozenset[str]
    freedom: float


def _labelled(label: str) -> Terms:
    return Terms(frozenset([label]), FREEDOM.get(label, UNKNOWN_FREEDOM))


def _licence(identifier: str) -> Terms:
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier)
    return _labelled(IDENTIFIERS.get(name, name))


def _apply(operator: str, left: _Operand, right: _Operand) -> _Operand:
    """AND binds to the stricter side, OR leaves the choice, WITH loosens by an exception.

    The larger of two sets of labels takes in the other, so that long expressions stay cheap.
    """
    (names, freedom), (others, other) = left, right
    if operator == "with":
        return names, freedom + EXCEPTION_GAIN * (1 - freedom)
    small, large = sorted((names, others), key=len)
    large |= small
    return large, (min if operator == "and" else max)(freedom, other)


def evaluate_expression(text: str, start: int = 0, end: int | None = None) -> Terms | None:
    """The value of a licence expression, or of its longest well-formed beginning; None if there is none.

    Identifiers are pushed on one stack and operators wait on another while tighter ones go first.
    Reading stops where neither an operand nor an operator can follow, or at ``end``; what comes after is
    not looked at.
    """
    operands: list[_Operand] = []
    operators: list[str] = []

    def reduce() -> None:
        right, left = operands.pop(), operands.pop()
        operands.append(_apply(operators.pop(), left, right))

    want_operand = True
    for found in _EXPRESSION_TOKEN.finditer(text, start, len(text) if end is None else end):
        token = found[0].lower()
        if want_operand:
            if token == "(":
                operators.append(token)
            elif token == ")" or token in _PRECEDENCE:
                break
            else:
                terms = _licence(token)
                operands.append((set(terms.labels), terms.freedom))
                want_operand = False
        elif token in _PRECEDENCE:
            while operators and _PRECEDENCE.get(operators[-1], 0) >= _PRECEDENCE[token]:
                reduce()
            operators.append(token)
            want_operand = True
        elif token == ")":
            while operators and operators[-1] != "(":
                reduce()
            if not operators:
                break
            operators.pop()
        else:
            break
    if want_operand:
        while operators and operators[-1] == "(":
            operators.pop()
        if operators:
            operators.pop()
    while operators:
        if operators[-1] == "(":
            operators.pop()
        else:
            reduce()
    return Terms(frozenset(operands[0][0]), operands[0][1]) if operands else None


def tag_expressions(text: str) -> Iterator[Terms]:
    """The value of the expression after every tag of a text in lower case, also of several on one line.

    An expression ends with its line or where the next tag starts, so no character is read for two tags.
    """
    hits = list(_TAG_HIT.finditer(text))
    for hit, following in zip(hits, [*(h.start() for h in hits[1:]), len(text)]):
        line_end = _LINE_END.search(text, hit.end(), following)
        value = evaluate_expression(text, hit.end(), line_end.start() if line_end else following)
        if value is not None:
            yield value


class LicenceScanner:
    """Finds phrases in the words of a text.

    Words are joined by single spaces, with one before and after, so a phrase between spaces is a run of
    whole words, and counting spaces before a hit gives its word number.
    """

    def __init__(self, base: dict[str, str], notices: dict[str, str], reservations: dict[str, str] = RESERVATIONS):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for phrase in {*base, *notices, *reservations, TAG}:
            self._automaton.add_word(f" {phrase} ", phrase)
        self._automaton.make_automaton()
        self._base, self._labels, self._reservations = base, {**notices, **base}, reservations

    def _granting(self, hits: list[tuple[int, str]]) -> set[str]:
        """Phrases of (end, phrase) that grant something, without notices inside a longer one."""
        granting, start = set(), None
        for end, phrase in sorted(hits, key=lambda h: (-h[0], -len(h[1]))):
            own = end - len(phrase)
            inside = start is not None and start <= own
            if not inside:
                start = own
            if phrase in self._base or not inside:
                granting.add(phrase)
        return granting

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)"""
        lowered = lower_ascii(text or "")
        found = _WORD.findall(lowered)
        joined = f" {' '.join(found)} "
        base_at, hits, phrases = [], [], set()
        at, place = 0, 0
        for end, phrase in self._automaton.iter(joined):
            phrases.add(phrase)
            if phrase in self._labels:
                hits.append((end, phrase))
            if phrase in self._base:
                start = end - len(phrase) - 1
                if start >= place:
                    at += joined.count(" ", place, start)
                    place = start
                    base_at.append(at)
                else:
                    base_at.append(joined.count(" ", 0, start))
        terms = list(tag_expressions(lowered)) if TAG in phrases else []
        tagged = {label for t in terms for label in t.labels}
        terms += [_labelled(x) for x in {self._labels[p] for p in self._granting(hits)} - tagged]
        if not terms:
            terms = [_labelled(self._reservations[p]) for p in phrases if p in self._reservations]
        labels = sorted({label for t in terms for label in t.labels})
        base_labels = sorted({self._base[p] for p in phrases if p in self._base})
        return (
            len(found),
            len(base_at),
            min(base_at, default=None),
            max(base_at, default=None),
            ",".join(base_labels),
            ",".join(labels),
            min((t.freedom for t in terms), default=UNKNOWN_FREEDOM),
        )


def scan_licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: dict[str, str] = BASE_PHRASES,
    notices: dict[str, str] = NOTICES,
) -> DataFrame:
    """Licence notices and tags of every whole text.

    Columns: id, n_words, n_base, first_word, last_word, base_labels, labels, score. Words are runs of
    ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. ``score`` is how freely
    the strictest notice or tag lets the text be used; 0.5 where nothing is known. A notice inside a longer one does not
    count, a licence that a tag's expression names counts through that expression, and reserved rights count only in a
    text that grants nothing. Base phrases always give their label. A null or empty text has
    no words, empty labels and null places. No shuffle; ids may be null or repeat.
    """
    fields = [
        ("n_words", pa.int64(), "bigint"),
        ("n_base", pa.int64(), "bigint"),
        ("first_word", pa.int64(), "bigint"),
        ("last_word", pa.int64(), "bigint"),
        ("base_labels", pa.string(), "string"),
        ("labels", pa.string(), "string"),
        ("score", pa.float64(), "double"),
    ]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner(base, notices)
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], f[1]) for i, f in enumerate(fields)]
            names = [id_col, *[f[0] for f in fields]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *[f"{name} {t}" for name, _, t in fields]])
    return map_batches(docs.select(id_col, text_col), scan, schema)
