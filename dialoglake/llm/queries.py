"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoglake.llm import attention_quality, fingerprints, language_id, licenses, mixing, packing, quality_rules, simhash_neardup, spelling, substring_dedup, toxicity, warc, whitening
from dialoglake.llm.common import freeze, read

TOKENIZER = "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=2048)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.near_duplicate_components(read(spark, sf_dir, "documents"), shingle_words=3, radius=2)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_count: for every doc_id divisible by 20, the documents with a fingerprint within 3 bits of its own."""
    marked = freeze(fingerprints.with_edited_text(read(spark, sf_dir, "documents")), "fingerprints")
    return fingerprints.neighbours(marked, F.col("doc_id") % 20 == 0, radius=3)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("rejected_by")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(read(spark, sf_dir, "documents")).drop("row")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains are the classes of the labels table; the weights ask for mostly clean text."""
    labelled = mixing.domains_of_labels(read(spark, sf_dir, "labels"))
    return mixing.mix(read(spark, sf_dir, "documents"), labelled, {"clean": 0.9, "low": 0.07, "toxic": 0.03}, anchor="clean").drop("row", "digest")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(read(spark, sf_dir, "pages"), min_bytes=0)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return attention_quality.score(docs, attention_quality.fit(docs, read(spark, sf_dir, "labels")), threshold=0.7)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"), most=32)


_ALL = (
    op1_best_fit_packing, op2_simhash_near_dedup, op3_document_fingerprints, op4_quality_rules, op5_substring_dedup,
    op6_toxicity, op7_source_mixing, op8_warc, op9_language_id, op10_license_scans,
    op11_quality_classifier, op12_spelling_variants, op13_embedding_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_OP8_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + CAST(floor(CAST('0x' || substr(h, 1 + 5 * CAST(k // 4 AS INTEGER), 5) AS INTEGER) / power(32, 3 - k % 4)) AS INTEGER) % 32, 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""


def _op10_sql() -> str:
    """Brute force: every run of words of every paragraph against every template."""
    names, limit = list(licenses.TEMPLATES), licenses.THRESHOLD
    templates = ", ".join(
        f"({k}, '{licenses.TEMPLATES[t]}', {licenses._template_words(t)!r}, {licenses._need(t, limit)}, {licenses._longest_run(t, limit)}, {[j for j, u in enumerate(names) if licenses._near(t, u, limit)]!r}::INT[])"
        for k, t in enumerate(names)
    )
    phrases = ", ".join(f"('{label}', '{p}', {p.split()!r})" for p, label in licenses.PHRASES.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH t(k, label, words, need, long, near) AS (VALUES {templates}),
ph(label, phrase, words) AS (VALUES {phrases}),
d AS (
    SELECT row_number() OVER () AS r, doc_id,
        list_filter(regexp_split_to_array({lower}, '{gap}'), lambda x: x <> '') AS w,
        regexp_split_to_array({lower}, '{licenses.PARAGRAPH}') AS paragraphs
    FROM documents
), places AS (
    SELECT r, label, unnest(list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + len(words)) = words)) AS pos
    FROM d, ph WHERE list_has_all(w, words)
), base AS (
    SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_distinct(list(label)) AS labels FROM places GROUP BY r
), para AS (
    SELECT r, generate_subscripts(paragraphs, 1) AS p, unnest(paragraphs) AS body FROM d
), said AS (
    SELECT r, p, list_filter(regexp_split_to_array(body, '{gap}'), lambda x: x <> '') AS w FROM para
), met AS (
    SELECT r, p, w, t.* FROM said, t WHERE len(list_intersect(list_distinct(w), words)) >= need
), counted AS (
    SELECT r, p, k, label, len(words) AS size, near, need,
        list_max(list_transform(range(greatest(1, len(w) - long + 1)), lambda i: len(list_intersect(list_distinct(list_slice(w, i + 1, i + long)), words)))) AS overlap
    FROM met
), hits AS (
    SELECT *, overlap / size AS share FROM counted WHERE overlap >= need
), kept AS (
    SELECT * FROM hits m WHERE NOT EXISTS (
        SELECT 1 FROM hits o WHERE o.r = m.r AND o.p = m.p AND list_contains(m.near, o.k)
            AND (o.share > m.share OR o.share = m.share AND (o.size > m.size OR o.size = m.size AND o.k < m.k)))
), method AS (
    SELECT r, list_distinct(list(label)) AS labels, max(share) AS best FROM kept GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(method.labels, [])))), ','), '') AS labels,
    CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN method USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": _OP8_SQL, "op10_license_scans": _op10_sql()}
