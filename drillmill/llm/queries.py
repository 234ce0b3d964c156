"""Queries of the llm operators: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from drillmill.llm import addresses, canonical, mixing, names, pii, spans, tokenizer
from drillmill.sources.tables import read_table


def p1_found(spark, folder):
    return names.found(read_table(spark, folder, "forms"))


def p2_found(spark, folder):
    return canonical.found(read_table(spark, folder, "forms"), read_table(spark, folder, "canonical_values"))


def p2_unmatched(spark, folder):
    return canonical.unmatched(read_table(spark, folder, "forms"), read_table(spark, folder, "canonical_values"))


def p3_found(spark, folder):
    return pii.found(read_table(spark, folder, "forms"))


def p3_redacted(spark, folder):
    return pii.redacted(read_table(spark, folder, "forms"))


def p6_found(spark, folder):
    return addresses.found(read_table(spark, folder, "forms"))


def p6_open(spark, folder):
    return addresses.open_addresses(read_table(spark, folder, "forms"))


def p7_ids(spark, folder):
    return tokenizer.encode_documents(read_table(spark, folder, "documents"))


def p7_round_trip(spark, folder):
    return tokenizer.round_trip(read_table(spark, folder, "documents"))


def p8_mix(spark, folder):
    return mixing.mixed_rows(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))


def p8_shares(spark, folder):
    return mixing.mix(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"))[1]


def p8_shares_all(spark, folder):
    return mixing.mix(read_table(spark, folder, "documents"), read_table(spark, folder, "mix_targets"), everything=True)[1]


def p9_found(spark, folder):
    return spans.found(read_table(spark, folder, "documents"))


def p9_shared(spark, folder):
    return spans.shared_report(read_table(spark, folder, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_unmatched": p2_unmatched, "p3_found": p3_found, "p3_redacted": p3_redacted, "p6_found": p6_found, "p6_open": p6_open, "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_shares_all": p8_shares_all, "p9_found": p9_found, "p9_shared": p9_shared}
# Every stretch of 200 characters against every other: the exact answer, for inputs that such a join still fits.
_GRAMS = f"""grams AS (SELECT doc_id, p, md5(substr(text, p, {spans.MIN_CHARS})) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - {spans.MIN_CHARS - 2})) AS p FROM documents WHERE length(text) >= {spans.MIN_CHARS})),
    often AS (SELECT g FROM grams GROUP BY g HAVING count(DISTINCT doc_id) > 1), hits AS (SELECT * FROM grams WHERE g IN (SELECT g FROM often))"""
_STARTS = "starts AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS next_p FROM (SELECT DISTINCT doc_id, p FROM hits))"

SQL: dict[str, str] = {
    "p9_found": f"WITH {_GRAMS}, d AS (SELECT DISTINCT doc_id, g FROM hits) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b USING (g) WHERE a.doc_id < b.doc_id",
    "p9_shared": f"WITH {_GRAMS}, {_STARTS}, c AS (SELECT doc_id, CAST(sum(least({spans.MIN_CHARS}, coalesce(next_p - p, {spans.MIN_CHARS}))) AS INT) AS shared FROM starts GROUP BY doc_id), "
    f"k AS (SELECT text, count(*) - 1 AS copies FROM documents WHERE length(text) >= {spans.MIN_CHARS} GROUP BY text), "
    "r AS (SELECT d.doc_id, CAST(coalesce(length(d.text), 0) AS INT) AS n_chars, CAST(coalesce(c.shared, 0) AS INT) AS shared_chars, CAST(coalesce(k.copies, 0) AS BIGINT) AS copies FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN k ON d.text = k.text) "
    "SELECT doc_id, n_chars, shared_chars, copies, round(CASE WHEN n_chars = 0 THEN 0.0 ELSE CAST(shared_chars AS DOUBLE) / n_chars END, 6) AS shared_share FROM r",
}
