"""Registered queries: citation grounding and prompt rendering (A14, JN4, J6, J2, J4, P1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import chunking, guardrails, prompts, retrieval
from docflow.plans.q_retrieval import blended_ctes
from docflow.plans.registry import register
from docflow.plans.sql_snippets import fixed3_sql, keyword_topk_ctes, norm_sql, redact_sql
from docflow.session import saved, table


def _requests(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _passages(spark, sf):
    """Top-5 keyword passages per benchmark item, with the chunk text."""
    chunks = chunking.chunk_documents(table(spark, sf, "documents").select("doc_id", "text"))
    top = retrieval.keyword_topk(_requests(spark, sf), chunks, 5)
    return top.join(chunks.select("chunk_id", "text"), "chunk_id")


@register("citation_verdict", "A14 JN4 J6", f"""
WITH {keyword_topk_ctes("SELECT item_id AS query_id, text FROM benchmark")},
cits AS (
  SELECT b.item_id AS query_id, 0 AS pos, CASE WHEN b.item_id % 5 = 3 THEN 'none_' || t.chunk_id ELSE t.chunk_id END AS chunk_id,
         CASE WHEN b.item_id % 5 = 2 THEN substr(b.text, 1, 100) || '#' ELSE substr(t.chunk_text, 1, 90) END AS quote
  FROM benchmark b JOIN top t ON t.query_id = b.item_id AND t.rank = 1 WHERE b.item_id % 5 NOT IN (0, 1)
  UNION ALL
  SELECT query_id, rank::INTEGER - 1, chunk_id, replace(substr(chunk_text, 1, 80), ' ', '  ') FROM top
  WHERE rank BETWEEN 2 AND 5 AND query_id % 5 NOT IN (0, 1)),
chk AS (SELECT c.query_id, c.pos,
               CASE WHEN p.chunk_id IS NULL THEN 'unknown_chunk'
                    WHEN NOT contains({norm_sql('p.chunk_text')}, {norm_sql('c.quote')}) THEN 'quote_not_found'
               END AS code
        FROM cits c LEFT JOIN top p ON p.query_id = c.query_id AND p.chunk_id = c.chunk_id),
v AS (SELECT b.item_id AS query_id, count(chk.pos)::BIGINT AS n_citations,
             CASE WHEN b.item_id % 5 = 1 THEN 'no_citations'
                  ELSE arg_min(code, pos) FILTER (WHERE code IS NOT NULL) END AS violation
      FROM benchmark b LEFT JOIN chk ON chk.query_id = b.item_id GROUP BY b.item_id)
SELECT query_id AS request_id, n_citations, violation IS NULL AS ok, violation FROM v""")
def citation_verdict(spark, sf):
    """Benchmark requests against their own top passages. By id modulo 5 a response has no
    citation and intent 'other' (0) or 'nda' (1), or cites its first passage with an invented
    quote (2), under an unknown id (3) or rightly (4); the other passages are quoted with
    doubled blanks in extracted fields."""
    req = _requests(spark, sf)
    p = saved(_passages(spark, sf), "passages")
    kind = F.col("query_id") % 5
    one = req.join(p.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.col("text").alias("ctext")))).alias("p")),
                   "query_id", "left")
    first = F.try_element_at("p", F.lit(1))
    quote = F.when(kind == 2, F.concat(F.substring("text", 1, 100), F.lit("#"))).otherwise(F.substring(first["ctext"], 1, 90))
    cited = F.when(kind == 3, F.concat(F.lit("none_"), first["chunk_id"])).otherwise(first["chunk_id"])
    none = (kind <= 1) | F.col("p").isNull()
    fields = F.transform(F.slice("p", 2, 4), lambda x: F.struct(
        F.lit("passage").alias("name"), x["chunk_id"].alias("value"),
        F.array(F.struct(x["chunk_id"].alias("chunk_id"), F.replace(F.substring(x["ctext"], 1, 80), F.lit(" "), F.lit("  ")).alias("quote"))).alias("citations")))
    resp = one.select(F.col("query_id").alias("request_id"), F.when(kind == 0, "other").otherwise("nda").alias("intent"),
                      F.when(~none, F.array(F.struct(cited.alias("chunk_id"), quote.alias("quote")))).alias("citations"),
                      F.when(~none, fields).alias("extracted_fields"))
    return guardrails.citation_verdict(resp, p.select(F.col("query_id").alias("request_id"), "chunk_id", "text"))


@register("render_prompt", "P1 J2 J4 J1 R3", f"""
WITH {blended_ctes("SELECT item_id AS query_id, substr(" + redact_sql("text") + ", 1, 2000) AS text FROM benchmark")},
red AS (SELECT item_id AS doc_id, {redact_sql("text")} AS text FROM benchmark),
blocks AS (SELECT query_id, string_agg('[' || chunk_id || '] score=' || {fixed3_sql('score')} || chr(10)
                                       || chunk_text || chr(10) || chr(10), '' ORDER BY rank) AS b
           FROM top GROUP BY query_id)
SELECT red.doc_id, 'Document id: ' || red.doc_id::VARCHAR || chr(10) || 'Document text:' || chr(10)
       || '---' || chr(10)
       || CASE WHEN length(red.text) <= 8000 THEN red.text
               ELSE substr(red.text, 1, 8000) || chr(10) || '[…truncated…]' END
       || chr(10) || '---' || chr(10) || chr(10) || 'Retrieved passages:' || chr(10)
       || coalesce(blocks.b, '')
       || 'Return the JSON object per the schema. Use the retrieved passages for citations.' AS prompt
FROM red LEFT JOIN blocks ON blocks.query_id = red.doc_id""")
def render_prompt(spark, sf):
    """Benchmark items as reasoning requests (no hint: the auto route passes none)."""
    index = saved(retrieval.build_index(table(spark, sf, "documents").select("doc_id", "text")), "index")
    req = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text",
                                               F.lit(None).cast("string").alias("hinted_intent"))
    return prompts.prepare(req, index, 5)
