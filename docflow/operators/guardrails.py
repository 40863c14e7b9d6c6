"""Guardrails: output safety (V10, V11) and citation grounding (A14, JN4, J6)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.functions.text import contains_normalized

# The default output blocklist (case-insensitive substrings).
BLOCK_KEYWORDS = ("kill ", "harm ", "destroy the ", "attack the ")
SEVERITY_BLOCK_AT = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blocklist_pattern(keywords=BLOCK_KEYWORDS) -> str:
    return "|".join(re.escape(k).replace("\\ ", " ") for k in keywords)


def unsafe(text, keywords=BLOCK_KEYWORDS) -> Column:
    """True when any keyword occurs as a case-insensitive substring."""
    return F.coalesce(_c(text).rlike("(?iu)" + blocklist_pattern(keywords)), F.lit(False))


def severity_blocked(categories, threshold: int = SEVERITY_BLOCK_AT) -> Column:
    """Any category with severity >= threshold (missing severity counts as 0)."""
    return F.coalesce(
        F.exists(_c(categories), lambda c: F.coalesce(c["severity"], F.lit(0)) >= threshold),
        F.lit(False))


def all_citations(citations, fields) -> Column:
    """Own citations followed by those of every extracted field, in order."""
    own = F.coalesce(_c(citations), F.array().cast("array<struct<chunk_id:string,quote:string>>"))
    nested = F.flatten(F.transform(
        F.coalesce(_c(fields), F.array().cast(
            "array<struct<name:string,value:string,citations:array<struct<chunk_id:string,quote:string>>>>")),
        lambda f: F.coalesce(f["citations"], F.array().cast(
            "array<struct<chunk_id:string,quote:string>>"))))
    return F.concat(own, nested)


def citation_verdict(responses: DataFrame, passages: DataFrame, key: str = "request_id") -> DataFrame:
    """Per response, ``ok`` and the first violation.

    Violations: 'no_citations' (intent other than 'other' with no citation at all),
    'unknown_chunk' (cited chunk not among *this request's* passages), 'quote_not_found'
    (normalised quote not in the normalised chunk text). The first failing citation in
    order decides ``violation``.

    responses: key, intent, citations, extracted_fields. passages: key, chunk_id, text.
    Output: key, n_citations BIGINT, ok BOOLEAN, violation STRING.
    """
    r = responses.select(key, "intent",
                         all_citations("citations", "extracted_fields").alias("_all"))
    ex = r.select(key, "intent", F.size("_all").cast("bigint").alias("n_citations"),
                  F.posexplode_outer("_all").alias("_pos", "_cit"))
    p = passages.select(F.col(key).alias("_pkey"), F.col("chunk_id").alias("_pcid"),
                        F.col("text").alias("_ptext"))
    j = ex.join(p, (F.col(key) == F.col("_pkey")) & (F.col("_cit.chunk_id") == F.col("_pcid")),
                "left")
    code = (F.when(F.col("_cit").isNull(), F.lit(None))
             .when(F.col("_pcid").isNull(), F.lit("unknown_chunk"))
             .when(~contains_normalized("_ptext", F.col("_cit.quote")), F.lit("quote_not_found")))
    per = j.select(key, "intent", "n_citations", "_pos", code.alias("_code"))
    agg = per.groupBy(key, "intent", "n_citations").agg(
        F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col("_pos"))).alias("_first"))
    violation = (F.when((F.col("intent") != "other") & (F.col("n_citations") == 0),
                        F.lit("no_citations"))
                  .otherwise(F.col("_first")))
    return agg.select(key, "n_citations", violation.isNull().alias("ok"),
                      violation.alias("violation"))
