"""Language identification by fusing evidence with Bayes' rule.

Four kinds of evidence meet in one posterior for every page or document:

- the text, by character trigram likelihoods learnt from texts whose language is known;
- the language that the markup declares;
- the suffix of the address, such as a country domain or a language folder;
- the host, as a prior. A host's own counts are smoothed by those of its domain, these by those of its
  suffix, and these by all.

How far declarations, suffixes and hosts can be trusted is not assumed but counted, by grouped aggregates
over the whole table, against what the texts alone say. A text's own vote is taken out of its prior. The trigram
model, though, may have been trained on the texts that it judges; train it on others to measure it.

Labels and declarations are compared by their primary subtag in lower case: ``EN``, ``en`` and ``en-GB`` are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarefind.llm.common import map_batches, stored
from rarefind.llm.url_filter import host_of, path_of
from rarefind.operators.sample import exact_split

#: Most texts of each language that the trigram model is trained on, and fewest texts that make a language.
MAX_TRAINING_TEXTS = 10_000
MIN_LANGUAGE_TEXTS = 3
#: A trigram shares letters with its neighbours, so it counts as this part of an independent one.
TRIGRAM_WEIGHT = 1 / 3
#: How many counts the next wider level is worth in a smoothed share.
SMOOTHING = 5.0
MIN_POSTERIOR = 0.5
#: The class of texts that no known language explains better than chance does.
NONE = "und"

_BUCKET_BITS = 16
_CHUNK = 1 << 20
_HIDDEN_START = re.compile(r"(?i)<(?:(script|style)\b|!--)")
_HIDDEN_END = {
    "script": re.compile(r"(?i)</script\s*>"),
    "style": re.compile(r"(?i)</style\s*>"),
    "": re.compile("-->"),
}
_HTML_TAG = re.compile(r"<[^>]*>")
_HTML_START = r"(?i)<html\b([^>]*)"
_HTML_LANG = r"(?is)^.*\blang\s*=\s*[\"']?([a-zA-Z]+)"


def language_code(label: Column) -> Column:
    """The primary subtag of a language label in lower case; null for null or nothing."""
    return F.nullif(F.lower(F.regexp_extract(label, r"^\s*([^\s_-]*)", 1)), F.lit(""))


def visible_text(html: str) -> str:
    """A page without scripts, styles, comments and tags, each replaced by a space.

    What is never closed stays. Every character is looked at a few times at most, also where nothing is closed.
    """
    parts, at, unclosed = [], 0, set()
    while (start := _HIDDEN_START.search(html, at)) is not None:
        kind = (start[1] or "").lower()
        end = None if kind in unclosed else _HIDDEN_END[kind].search(html, start.end())
        if end is None:
            unclosed.add(kind)
            parts.append(html[at : start.end()])
            at = start.end()
        else:
            parts += [html[at : start.start()], " "]
            at = end.end()
    text = "".join([*parts, html[at:]])
    # Behind the last ">" no tag ends, and before it every "<" finds one.
    closed = text.rfind(">") + 1
    return _HTML_TAG.sub(" ", text[:closed]) + text[closed:]


def _trigrams(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the trigrams of letters and word breaks, in lower case, chunk by chunk."""
    text = text.lower()
    for at in range(0, len(text), _CHUNK):
        x = np.frombuffer(text[max(0, at - 2) : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((x >= 97) & (x <= 122)) | (x >= 0xAA)
        x = np.where(letter, x, 32).astype(np.uint64)
        x = x[letter | np.concatenate(([True], letter[:-1]))]
        if len(x) > 2:
            h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + x[2:]
            h *= np.uint64(0x9E3779B97F4A7C15)
            yield (h >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


@dataclass
class TextModel:
    """Log probabilities of trigrams: a row per bucket, a column per language and one for none."""

    languages: list[str]
    table: np.ndarray

    def evidence(self, text: str) -> tuple[np.ndarray, int]:
        """Log likelihood under each language and under none, and the number of trigrams."""
        total, n = np.zeros(len(self.languages) + 1), 0
        for grams in _trigrams(text):
            total += self.table[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        return total * TRIGRAM_WEIGHT, n


def train_text_model(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_texts: int = MAX_TRAINING_TEXTS,
) -> TextModel:
    """Trigram shares of each language from at most ``max_texts`` texts of that language, drawn by hash of the id.

    A language is drawn from by itself: with three texts or more in the whole table it has a class, however
    large the table and the other languages are.

    A trigram counts once for a text, and only if three texts of the language have it, so that one text
    with a wrong label teaches nothing.

    Null languages, texts and ids take no part, and labels count by ``language_code``. Languages with fewer than three texts, or without a trigram in
    any drawn text, are left out; without any, all texts come out as none. Counts are summed in Spark: at most
    65,536 for a language.
    """
    known = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), language_code(F.col(lang_col)).alias("lang")
    ).filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    wanted = F.least("_total", F.lit(max(max_texts, MIN_LANGUAGE_TEXTS)))
    texts, _ = exact_split(known, ["id"], wanted, by="lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One language after another, so that only one holds counts at a time.
            rows_of: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column(0).to_pylist()):
                rows_of.setdefault(lang, []).append(i)
            for lang, rows in rows_of.items():
                counts = np.zeros(1 << _BUCKET_BITS, np.int64)
                for i in rows:
                    text = batch.column(1)[i].as_py()
                    counts[np.unique(np.concatenate([*_trigrams(text), np.zeros(0, np.int64)]))] += 1
                used = np.flatnonzero(counts)
                columns = [
                    pa.array([lang] * (len(used) + 1), pa.string()),
                    pa.array(np.concatenate(([-1], used))),
                    pa.array(np.concatenate(([len(rows)], counts[used]))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    counted = map_batches(texts.select("lang", "text"), count, "lang string, bucket bigint, n bigint")
    by_lang: dict[str, np.ndarray] = {}
    n_texts: dict[str, int] = {}
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["bucket"] < 0:
            n_texts[r["lang"]] = r["n"]
        else:
            counts = by_lang.setdefault(r["lang"], np.zeros(1 << _BUCKET_BITS))
            counts[r["bucket"]] = r["n"] if r["n"] >= MIN_LANGUAGE_TEXTS else 0
    languages = sorted(x for x in by_lang if n_texts[x] >= MIN_LANGUAGE_TEXTS)
    size = 1 << _BUCKET_BITS
    shares = [np.log((by_lang[x] + 0.1) / (by_lang[x].sum() + 0.1 * size)) for x in languages]
    table = np.column_stack([*shares, np.full(size, -np.log(size))]).astype(np.float32)
    return TextModel(languages, table)


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, declared, suffix, host) of web pages.

    The text is the page without scripts, styles, comments and tags. The suffix is the last label of the host
    with the first folder of the path if that has two letters, as in ``com/en``.
    """
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    folder = F.lower(F.regexp_extract(path_of(url), r"^(/[a-zA-Z]{2})(/|$)", 1))
    return pages.select(
        F.col(id_col).alias("id"),
        html.alias("text"),
        language_code(F.regexp_extract(F.regexp_extract(html, _HTML_START, 1), _HTML_LANG, 1)).alias("declared"),
        F.concat(F.substring_index(host_of(url), ".", -1), folder).alias("suffix"),
        host_of(url).alias("host"),
        F.lit(True).alias("markup"),
    )


def document_evidence(
    docs: DataFrame,
    id_col: str | Column = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    host_col: str = "source",
) -> DataFrame:
    """(id, text, declared, suffix, host) of plain documents: the language column declares, the source hosts."""
    return docs.select(
        (F.col(id_col) if isinstance(id_col, str) else id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        language_code(F.col(lang_col)).alias("declared"),
        F.lit("").alias("suffix"),
        F.coalesce(F.col(host_col), F.lit("")).alias("host"),
        F.lit(False).alias("markup"),
    )


def _text_evidence(evidence: DataFrame, model: TextModel) -> DataFrame:
    """Replace the text by its log likelihoods, number of trigrams and best class."""
    names = [*model.languages, NONE]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likelihoods, grams, best = [], [], []
            for text, markup in zip(batch.column("text"), batch.column("markup").to_pylist()):
                text = text.as_py()
                if markup:
                    text = visible_text(text)
                total, n = model.evidence(text)
                likelihoods.append((total - total.max()).tolist())
                grams.append(n)
                best.append(names[int(total.argmax())] if n else NONE)
            columns = [
                *[batch.column(c) for c in ("id", "declared", "suffix", "host")],
                pa.array(likelihoods, pa.list_(pa.float64())),
                pa.array(grams, pa.int64()),
                pa.array(best, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=out)

    out = ["id", "declared", "suffix", "host", "likelihoods", "trigrams", "text_lang"]
    kinds = dict(evidence.dtypes) | {"likelihoods": "array<double>", "trigrams": "bigint", "text_lang": "string"}
    return map_batches(evidence, score, ", ".join(f"{c} {kinds[c]}" for c in out))


def _votes(scored: DataFrame, keys: Sequence[str], names: Sequence[str], alias: str) -> DataFrame:
    """How many texts of each class the texts alone put under a key, as an array in the order of names.

    Counted by key and class first, so the work follows the classes that occur and not the number of names.
    """
    counted = scored.groupBy(*keys, "text_lang").agg(F.count("*").cast("double").alias("n"))
    found = F.map_from_entries(F.collect_list(F.struct("text_lang", "n")))
    by_class = F.transform(F.lit(list(names)), lambda x: F.coalesce(F.try_element_at(F.col("_found"), x), F.lit(0.0)))
    return counted.groupBy(*keys).agg(found.alias("_found")).select(*keys, by_class.alias(alias))


def _domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def identify_languages(evidence: DataFrame, model: TextModel) -> DataFrame:
    """The language of every row of ``evidence``: (id, text_lang, declared, host, lang, posterior, accepted).

    ``lang`` is the class with the highest posterior among the languages and ``und``. A row is accepted if that is
    a language, with a posterior of at least ``MIN_POSTERIOR``, and it has a trigram of text at all. Null ids are
    kept; null declarations, hosts and suffixes are no evidence.

    Texts are read once, into a stored table of a few numbers per row. The counts come from grouped aggregates
    over it, with partial sums before the shuffle; they are joined by host, domain and suffix, which are not
    broadcast. Tables by declaration and of all rows have a row per language at most.
    """
    names = [*model.languages, NONE]
    scored = stored(_text_evidence(evidence, model), "text_evidence")
    scored = scored.withColumn("domain", _domain(F.col("host")))
    zeros = F.array_repeat(F.lit(0.0), len(names))
    n_of = {r["text_lang"]: float(r["count"]) for r in scored.groupBy("text_lang").count().collect()}
    counts = [n_of.get(x, 0.0) for x in names]
    shares = F.lit([(n + 1) / (sum(counts) + len(names)) for n in counts])
    own = F.transform(F.lit(names), lambda x: (F.col("text_lang") == x).cast("double"))

    def smoothed(votes: Column, wider: Column) -> Column:
        """Votes without the row's own, drawn towards the wider level's shares."""
        others = F.zip_with(votes, own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
        size = F.aggregate(others, F.lit(0.0), lambda s, x: s + x)
        return F.zip_with(others, wider, lambda n, w: (n + SMOOTHING * w) / (size + SMOOTHING))

    joined = scored
    for keys, alias in ((["suffix"], "by_suffix"), (["domain"], "by_domain"), (["host"], "by_host")):
        joined = joined.join(_votes(scored, keys, names, alias), keys, "left")
    declared = _votes(scored.filter("declared IS NOT NULL"), ["declared"], names, "by_declared")
    known = F.col("declared").isin(model.languages) if model.languages else F.lit(False)
    joined = joined.join(F.broadcast(declared.filter(known)), ["declared"], "left")

    everyone = shares
    prior = everyone
    for level in ("by_suffix", "by_domain", "by_host"):
        prior = smoothed(F.coalesce(level, zeros), prior)
    # P(declared | language), from P(language | declared) by Bayes' rule; constants of the row fall away.
    said = F.zip_with(smoothed(F.coalesce("by_declared", zeros), everyone), everyone, lambda a, b: a / b)
    logs = F.zip_with("likelihoods", prior, lambda a, b: a + F.ln(b))
    logs = F.zip_with(logs, said, lambda a, b: a + F.ln(b))
    found = F.col("_logs")
    weights = F.transform(found, lambda x: F.exp(x - F.array_max(found)))
    best = F.array_position(found, F.array_max(found)).cast("int")
    posterior = F.lit(1.0) / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    lang = F.element_at(F.lit(names), best)
    accepted = (lang != NONE) & (F.col("trigrams") > 0) & (F.col("posterior") >= MIN_POSTERIOR)
    return (
        joined.withColumn("_logs", logs)
        .withColumn("lang", lang)
        .withColumn("posterior", posterior)
        .select("id", "text_lang", "declared", "host", "lang", "posterior", accepted.alias("accepted"))
    )
