"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefind.llm.byte_bpe import codec_digests
from rarefind.llm.common import read_table
from rarefind.llm.conversation_trie import conversation_trie, ordered_turns, with_shared_heads
from rarefind.llm.jaccard_join import similar_components
from rarefind.llm.language_id import (
    document_evidence,
    identify_languages,
    page_evidence,
    train_text_model,
)
from rarefind.llm.lexical_search import ranked_search
from rarefind.llm.licenses import scan_licences
from rarefind.llm.packing import pack_texts
from rarefind.llm.quality import quality_rules
from rarefind.llm.suffix_dedup import WORD_WINDOW, remove_repeats
from rarefind.llm.token_counts import token_counts
from rarefind.llm.url_filter import Rule, filter_urls, hosts_with_terms
from rarefind.llm.vector_search import nearest_neighbours
from rarefind.llm.warc import read_warc, with_originals, write_warc
from rarefind.sources.scratch import fresh_path

REGISTRY = {}
ORACLE_SQL = {}


def _query(function):
    REGISTRY[function.__name__] = function
    return function


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word-piece tokens of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens packed into sequences of 1024."""
    docs = read_table(spark, sf_dir, "documents")
    return pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document."""
    judged = quality_rules(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


URL_RULES = [
    Rule("block", "net"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]
BLOCKED_TERMS = ["ads", "adult", "bets", "casino", "pills", "spam"]


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rules, and against the hosts that carry a blocked term."""
    pages = read_table(spark, sf_dir, "pages")
    return filter_urls(pages, URL_RULES, hosts_with_terms(pages, BLOCKED_TERMS))


ORACLE_SQL["op4_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules AS (
  SELECT * FROM (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)})
    AS r(action, rule_host, rule_path)
), fitting AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(action, length(rule_host || rule_path)) AS action
  FROM parts, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(action,
  CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(BLOCKED_TERMS)})([.-]|$)') THEN 'block' ELSE 'allow' END
) AS verdict
FROM parts p LEFT JOIN fitting f ON p.page_id = f.page_id
"""


@_query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    docs = read_table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return codec_digests(docs, ranks, public_tokenizers.PATTERN)


@_query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 400-byte windows that occur elsewhere.

    Passages of more than 50 words that occur elsewhere may be shorter; they have columns of their own.
    """
    return remove_repeats(read_table(spark, sf_dir, "documents"), passage_words=WORD_WINDOW)


@_query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of 3-word shingles, Jaccard 0.9 or more."""
    return similar_components(read_table(spark, sf_dir, "documents"))


@_query
def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and tags of every document."""
    return scan_licences(read_table(spark, sf_dir, "documents"))


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page and of every document, with a text model learnt from the documents.

    A row has either a page_id or a doc_id. Pages and documents are judged apart, each with priors of its own.
    """
    docs = read_table(spark, sf_dir, "documents")
    model = train_text_model(docs)
    nothing = F.lit(None).cast("bigint")
    pages = identify_languages(page_evidence(read_table(spark, sf_dir, "pages")), model)
    documents = identify_languages(document_evidence(docs), model)
    of_pages = pages.withColumns({"page_id": F.col("id"), "doc_id": nothing}).drop("id")
    of_documents = documents.withColumns({"page_id": nothing, "doc_id": F.col("id")}).drop("id")
    return of_pages.unionByName(of_documents)


@_query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, F.col("vec_id") % 100 == 0)


@_query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that rank highest for every benchmark item."""
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE_SQL["op11_ranked_search"] = f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id, {_TERMS_SQL} AS terms FROM documents
), words AS (
  SELECT doc, unnest(terms) AS term FROM docs
), item_words AS (
  SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark
), counts AS (
  SELECT doc, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM item_words) GROUP BY ALL
), sizes AS (
  SELECT doc, doc_id, len(terms)::BIGINT AS n, count_if(len(terms) > 0) OVER () AS n_docs, sum(len(terms)) OVER () AS n_terms
  FROM docs
), weights AS (
  SELECT term, floor(1000 * ln((2 * (SELECT any_value(n_docs) FROM sizes) + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts GROUP BY term
), scores AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM item_words JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (doc)
  GROUP BY item_id, doc, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""


@_query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back from them."""
    archives = fresh_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), archives)
    found = with_originals(read_warc(spark, archives))
    return found.select(
        F.col("record_id").try_cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast("bigint").alias("refers_to"),
    )


_BASE32_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(hex, {5 * k + 1}, 5))::BIGINT >> {shift} & 31)::BIGINT + 1, 1)"
    for k in range(8)
    for shift in (15, 10, 5, 0)
)
ORACLE_SQL["op12_warc"] = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), tops AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex,
    max(page_id) OVER (PARTITION BY payload) AS top,
    row_number() OVER (PARTITION BY payload ORDER BY page_id DESC) AS n
  FROM payloads
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32_SQL} AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN top END AS refers_to
FROM tops
"""


@_query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, with heads shared in groups of five."""
    turns = ordered_turns(read_table(spark, sf_dir, "conversations"))
    return conversation_trie(*with_shared_heads(turns))


# 3988292384 is the reversed polynomial of CRC-32.
ORACLE_SQL["op13_conversation_trie"] = """
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT DISTINCT c, c::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS v FROM turns
  UNION ALL
  SELECT c, s, k + 1, xor(w >> 1, CASE WHEN w & 1 = 1 THEN 3988292384 ELSE 0 END)::BIGINT
  FROM (
    SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(s, k // 8 + 1, 1))) ELSE v END::BIGINT AS w FROM crc
    WHERE k < 8 * length(s)
  )
), convs AS (
  SELECT c, c - c % 5 AS base, xor(v, 4294967295) % 9 AS h FROM crc WHERE k = 8 * length(s)
), heads AS (
  SELECT v.c, place, t FROM convs v JOIN turns ON turns.c = base WHERE place <= h
), taken AS (
  SELECT c, max(place) AS n FROM heads GROUP BY c
), rebuilt AS (
  SELECT c, place, t FROM heads
  UNION ALL
  SELECT v.c, place - h + coalesce(n, 0), t
  FROM convs v JOIN turns ON turns.c = v.c LEFT JOIN taken ON taken.c = v.c WHERE place > h
), prefixes AS (
  SELECT c, 0 AS depth, []::STRUCT(role VARCHAR, "text" VARCHAR)[] AS p, 0 AS bytes FROM convs
  UNION ALL
  SELECT c, place, list(t) OVER (PARTITION BY c ORDER BY place), strlen(t.text) FROM rebuilt
), members AS (
  SELECT c, depth, p, bytes, min(c) OVER (PARTITION BY depth, p) AS node,
    depth = max(depth) OVER (PARTITION BY c) AS ends FROM prefixes
), nodes AS (
  SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * min(bytes) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), linked AS (
  SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN members m ON m.c = n.node AND m.depth = n.depth - 1
), children AS (
  SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY ALL
), counted AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children
  FROM linked l LEFT JOIN children k ON k.parent = l.node AND k.depth = l.depth
), totals AS (
  SELECT m.node, m.depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM counted n JOIN members m ON m.c = n.node AND m.depth <= n.depth GROUP BY m.node, m.depth
)
SELECT c.node AS conv_id, c.depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, n_children::BIGINT AS n_children,
  n_leaves, saved_tokens, ends_sha256
FROM counted c JOIN totals t ON t.node = c.node AND t.depth = c.depth
"""
