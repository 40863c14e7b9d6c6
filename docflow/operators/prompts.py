"""Prompt preparation (J2, J4, P1): redact -> truncate -> retrieve -> render."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.functions import pii
from docflow.functions.text import fixed3, truncate
from docflow.operators import embedding, retrieval

MAX_DOCUMENT_CHARS = 8000
QUERY_CHARS = 2000
TRUNCATION_MARK = "\n[…truncated…]"
CLOSING = "Return the JSON object per the schema. Use the retrieved passages for citations."


def render_reason_user(requests: DataFrame, passages: DataFrame,
                       max_document_chars: int = MAX_DOCUMENT_CHARS) -> DataFrame:
    """The user message per request.

    requests: doc_id, text, hinted_intent (nullable). passages: doc_id, rank, chunk_id,
    score, text - at most top_k per request, so collecting them per request is bounded.
    Layout: id line, optional hint line, the document between '---' lines (cut at
    ``max_document_chars`` with a marker), one block per passage in rank order
    ('[chunk_id] score=x.xxx', text, blank line), closing line; no trailing newline.
    """
    p = passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("rank", "chunk_id", "score", "text"))).alias("_ps"))
    blocks = F.array_join(F.transform(F.coalesce("_ps", F.array()), lambda x: F.concat(
        F.lit("["), x["chunk_id"], F.lit("] score="), fixed3(x["score"]), F.lit("\n"),
        x["text"], F.lit("\n\n"))), "")
    doc = F.when(F.char_length("text") <= max_document_chars, F.col("text")).otherwise(
        F.concat(F.substring("text", 1, max_document_chars), F.lit(TRUNCATION_MARK)))
    hint = F.when(F.col("hinted_intent").isNotNull() & (F.col("hinted_intent") != ""),
                  F.concat(F.lit("Fast-classifier hint: "), F.col("hinted_intent"), F.lit("\n"))) \
            .otherwise(F.lit(""))
    msg = F.concat(F.lit("Document id: "), F.col("doc_id").cast("string"), F.lit("\n"), hint,
                   F.lit("Document text:\n---\n"), doc, F.lit("\n---\n\nRetrieved passages:\n"),
                   blocks, F.lit(CLOSING))
    return requests.join(p, "doc_id", "left").select("doc_id", msg.alias("prompt"))


def prepare(requests: DataFrame, index: DataFrame, k: int = retrieval.DEFAULT_TOP_K,
            redactor: pii.Redactor = pii.redact, vector_weight: float = retrieval.DEFAULT_VECTOR_WEIGHT,
            dim: int = embedding.DEFAULT_DIM) -> DataFrame:
    """Redact the document (J1), retrieve the top-k passages for its first 2000
    redacted characters by the blended score over the whole index (J2, R3, R4), render the
    prompt (J4) from the redacted text.

    requests: doc_id, text, hinted_intent. index: retrieval.build_index. ``redactor`` is any
    Column -> Column backend (U7; the regex redactor by default). Output: doc_id, prompt."""
    red = requests.select("doc_id", redactor(F.col("text")).alias("text"), "hinted_intent")
    q = red.select(F.col("doc_id").alias("query_id"), truncate("text", QUERY_CHARS).alias("text"))
    qv = embedding.embed_md5_vectors(q, ["query_id", "text"], "text", dim)
    top = retrieval.blended_topk(qv, index, k, vector_weight, dim)
    texts = index.select("chunk_id", F.col("text").alias("_ctext"))
    passages = top.join(texts, "chunk_id").select(
        F.col("query_id").alias("doc_id"), "rank", "chunk_id", "score", F.col("_ctext").alias("text"))
    return render_reason_user(red, passages)
