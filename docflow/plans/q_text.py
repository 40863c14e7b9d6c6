"""Registered queries: token functions, PII redaction, validation, safety (C4, E3, J1, J2,
V1, V10, V11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow import contracts
from docflow.functions import pii
from docflow.functions.text import count_tokens, keyword_set, truncate, word_tokens
from docflow.operators import guardrails
from docflow.plans.registry import register
from docflow.plans.sql_snippets import kwset, words
from docflow.session import spread, table

# DuckDB (RE2) has no look-around: the phone rule is written with capture groups and
# applied twice (two phones can share one separator character).
_PHONE_RE2 = r"(^|\D)(?:\+?\d[\s\-()]?){9,14}\d(\D|$)"
_EMAIL_RE2 = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_CARD_RE2 = r"\b(?:\d[ -]*?){13,16}\b"


def _sql_email(x):
    return f"regexp_replace({x}, '{_EMAIL_RE2}', '[EMAIL]', 'g')"


def _sql_card(x):
    return f"regexp_replace({x}, '{_CARD_RE2}', '[CARD]', 'g')"


def _sql_phone(x):
    once = f"regexp_replace({x}, '{_PHONE_RE2}', '\\1[PHONE]\\2', 'g')"
    return f"regexp_replace({once}, '{_PHONE_RE2}', '\\1[PHONE]\\2', 'g')"


def _docs(spark, sf):
    return table(spark, sf, "documents")


@register("token_counts", "C3 C4 E3 R2", rf"""
SELECT doc_id,
       len(string_split(text, ' '))::BIGINT AS n_space_tokens,
       len({words('text')})::BIGINT AS n_words,
       len({kwset('text')})::BIGINT AS n_keywords
FROM documents WHERE text IS NOT NULL""")
def token_counts(spark, sf):
    d = spread(_docs(spark, sf).select("doc_id", "text")).where(F.col("text").isNotNull())
    return d.select("doc_id", count_tokens("text").alias("n_space_tokens"),
                    F.size(word_tokens("text")).cast("bigint").alias("n_words"),
                    F.size(keyword_set("text")).cast("bigint").alias("n_keywords"))


@register("pii_redact", "J1 J2 U7", rf"""
SELECT doc_id, substr(r, 1, 2000) AS query_text, md5(r) AS redacted_md5, r <> text AS changed FROM (
  SELECT doc_id, text, {_sql_phone(_sql_card(_sql_email('text')))} AS r FROM documents)""")
def pii_redact(spark, sf):
    d = spread(_docs(spark, sf).select("doc_id", "text")).select("doc_id", "text", pii.redact("text").alias("r"))
    return d.select("doc_id", truncate("r", 2000).alias("query_text"), F.md5("r").alias("redacted_md5"),
                    (F.col("r") != F.col("text")).alias("changed"))


@register("pii_counts", "J1 A12", rf"""
SELECT source, count(*)::BIGINT AS n_docs,
       count_if(e <> text)::BIGINT AS n_email, count_if(c <> e)::BIGINT AS n_card,
       count_if(p <> c)::BIGINT AS n_phone, count_if(p <> text)::BIGINT AS n_changed
FROM (SELECT source, text, e, c, {_sql_phone('c')} AS p FROM (
        SELECT source, text, e, {_sql_card('e')} AS c FROM (
          SELECT source, text, {_sql_email('text')} AS e FROM documents)))
GROUP BY source""")
def pii_counts(spark, sf):
    d = spread(_docs(spark, sf).select("source", "text")).select(
        "source", "text", pii.mask_email("text").alias("e"))
    d = d.withColumn("c", pii.mask_card("e")).withColumn("p", pii.mask_phone("c"))
    cnt = lambda cond: F.count_if(cond).cast("bigint")
    return d.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        cnt(F.col("e") != F.col("text")).alias("n_email"),
        cnt(F.col("c") != F.col("e")).alias("n_card"),
        cnt(F.col("p") != F.col("c")).alias("n_phone"),
        cnt(F.col("p") != F.col("text")).alias("n_changed"))


def _doc_rules_extra():
    return [
        ("n_chars_mismatch",
         F.col("n_chars").isNull() | (F.col("n_chars") != F.char_length("text"))),
        ("lang_unknown", ~F.coalesce(F.col("lang").isin("en", "fr", "de", "es"), F.lit(False))),
    ]


@register("doc_validation", "V1", r"""
SELECT doc_id, array_to_string(errs, ',') AS error_codes, len(errs)::BIGINT AS n_errors,
       len(errs) = 0 AS valid
FROM (SELECT doc_id, list_filter([
        CASE WHEN doc_id IS NULL THEN 'doc_id_null' END,
        CASE WHEN text IS NULL OR length(text) < 1 THEN 'text_empty' END,
        CASE WHEN n_chars IS NULL OR n_chars <> length(text) THEN 'n_chars_mismatch' END,
        CASE WHEN coalesce(lang IN ('en', 'fr', 'de', 'es'), false) THEN NULL ELSE 'lang_unknown' END
      ], lambda x: x IS NOT NULL) AS errs FROM documents)""")
def doc_validation(spark, sf):
    d = contracts.with_errors(_docs(spark, sf),
                              contracts.document_rules() + _doc_rules_extra())
    return d.select("doc_id", F.array_join("errors", ",").alias("error_codes"),
                    F.size("errors").cast("bigint").alias("n_errors"),
                    (F.size("errors") == 0).alias("valid"))


# A second, parameter blocklist: licence lines found in the corpus.
CUSTOM_BLOCKLIST = ("mit license", "apache license", "general public license")


@register("safety_flags", "V10", r"""
SELECT doc_id,
       coalesce(regexp_matches(text, '(?i)kill |harm |destroy the |attack the '), false) AS unsafe_default,
       coalesce(regexp_matches(text, '(?i)mit license|apache license|general public license'), false)
         AS unsafe_custom
FROM documents""")
def safety_flags(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", guardrails.unsafe("text").alias("unsafe_default"),
                    guardrails.unsafe("text", CUSTOM_BLOCKLIST).alias("unsafe_custom"))


@register("severity_block", "V11", """
SELECT doc_id, max_severity, max_severity >= 4 AS blocked FROM (
  SELECT doc_id, max(coalesce(sev, 0))::BIGINT AS max_severity FROM (
    SELECT doc_id, toxic * 4 + quality AS sev FROM labels
    UNION ALL SELECT doc_id, quality * 2 FROM labels
    UNION ALL SELECT doc_id, NULL FROM labels) GROUP BY doc_id)""")
def severity_block(spark, sf):
    """Category severities derived from labels (toxic -> hate severity toxic*4+quality,
    quality -> spam severity quality*2, plus a category with no severity)."""
    lab = table(spark, sf, "labels")
    cats = F.array(
        F.struct(F.lit("hate").alias("category"),
                 (F.col("toxic") * 4 + F.col("quality")).alias("severity")),
        F.struct(F.lit("spam").alias("category"), (F.col("quality") * 2).alias("severity")),
        F.struct(F.lit("other").alias("category"), F.lit(None).cast("int").alias("severity")))
    sc = lab.select("doc_id", cats.alias("categories"))
    # V11 per label row, then per document over all its rows with partial aggregates
    # (max / bool_or) - never a gathered list, however many rows a document has
    row_max = F.aggregate("categories", F.lit(0),
                          lambda acc, c: F.greatest(acc, F.coalesce(c["severity"], F.lit(0))))
    return sc.groupBy("doc_id").agg(
        F.max(row_max).cast("bigint").alias("max_severity"),
        F.bool_or(guardrails.severity_blocked("categories")).alias("blocked"))
