"""Registered queries: chunking, embeddings, retrieval (C*, E*, R*, W1, W5, S10)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docflow.functions.text import keyword_set
from docflow.operators import chunking, embedding, inverted, retrieval, vector_store
from docflow.plans.registry import register
from docflow.plans.sql_snippets import CHUNKS_CTE, SPACE, keyword_matches_cte, kwset, md5_counts_cte
from docflow.session import saved, scratch_path, table


def _chunks(spark, sf):
    return chunking.chunk_documents(table(spark, sf, "documents").select("doc_id", "text"))


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@register("chunk_documents", "C1 C2 C3 C4 J14 V7", f"""
WITH {CHUNKS_CTE}
SELECT chunk_id, doc_id, chunk_index, text, n_tokens FROM chunks""")
def chunk_documents(spark, sf):
    return _chunks(spark, sf)


@register("chunk_documents_encoder", "U2 C1 C2", f"""
WITH {CHUNKS_CTE}
SELECT chunk_id, doc_id::VARCHAR AS doc_id, chunk_index, text, n_tokens FROM chunks""")
def chunk_documents_encoder(spark, sf):
    """The same windows through the pluggable-tokeniser path."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return chunking.chunk_with_codec(docs, chunking.split_spaces)


@register("chunk_manifest", "S10 U-3", f"""
WITH {CHUNKS_CTE}
SELECT doc_id, count(*)::BIGINT AS n_chunks, sum(n_tokens)::BIGINT AS n_tokens
FROM chunks GROUP BY doc_id""")
def chunk_manifest(spark, sf):
    return chunking.chunk_manifest(_chunks(spark, sf))


@register("chunk_manifest_summary", "S10 A12", f"""
WITH {CHUNKS_CTE}
SELECT count(*)::BIGINT AS chunk_count, count(DISTINCT doc_id)::BIGINT AS n_documents FROM chunks""")
def chunk_manifest_summary(spark, sf):
    return chunking.manifest_summary(_chunks(spark, sf))


@register("chunk_overlap_check", "W5", f"""
WITH {CHUNKS_CTE},
w AS (SELECT doc_id, chunk_index, text,
             lead(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS nxt FROM chunks)
SELECT doc_id, chunk_index,
       array_to_string(string_split(text, ' ')[-40:], ' ')
         = array_to_string(string_split(nxt, ' ')[1:40], ' ') AS overlap_ok
FROM w WHERE nxt IS NOT NULL""")
def chunk_overlap_check(spark, sf):
    return chunking.overlap_check(_chunks(spark, sf))


KEYWORD_TOPK_SQL = f"""
WITH {CHUNKS_CTE},
q AS (SELECT item_id AS query_id, text FROM benchmark),
{keyword_matches_cte()},
allp AS (SELECT q.query_id, c.chunk_id, c.doc_id, c.chunk_index, coalesce(m.score, 0.0) AS score
         FROM q CROSS JOIN chunks c
         LEFT JOIN m ON m.query_id = q.query_id AND m.chunk_id = c.chunk_id)
SELECT query_id, chunk_id, doc_id, chunk_index, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank
  FROM allp) WHERE rank <= 5"""


@register("keyword_topk", "R2 R4 W1 U-1", KEYWORD_TOPK_SQL)
def keyword_topk(spark, sf):
    return retrieval.keyword_topk(_queries(spark, sf), _chunks(spark, sf), k=5)


def _inverted(spark, sf):
    base = scratch_path(spark, "inverted")
    inverted.build(_chunks(spark, sf), base)
    return base


@register("keyword_topk_stored", "R2 R4 W1 S8 U-1", KEYWORD_TOPK_SQL)
def keyword_topk_stored(spark, sf):
    """The same search from a stored inverted index."""
    return inverted.keyword_topk(_queries(spark, sf), _inverted(spark, sf), k=5)


@register("keyword_index_reads", "R2 S8", f"""
WITH {CHUNKS_CTE},
tok AS (SELECT DISTINCT unnest({kwset('text')}) AS token FROM benchmark),
held AS (SELECT tok, count(*) AS n FROM (SELECT unnest({kwset('text')}) AS tok FROM chunks) GROUP BY tok)
SELECT token, coalesce(n, 0)::BIGINT AS n_chunks, TRUE AS own_partition_only FROM tok LEFT JOIN held ON held.tok = token""")
def keyword_index_reads(spark, sf):
    """What the index gives for each token of the queries: in how many chunks it occurs, and that
    its rows come from its own partition."""
    base = _inverted(spark, sf)
    asked = _queries(spark, sf).select(F.explode(keyword_set("text")).alias("token")).distinct()
    tokens = [r[0] for r in asked.collect()]  # the stated query set's
    names = spark.createDataFrame(list(enumerate(tokens)), "t int, token string")
    found = inverted.postings(spark, base, tokens, ("places", "bucket")).groupBy("t").agg(
        F.sum(F.size("places")).alias("n"), F.collect_set("bucket").alias("buckets"))
    own = F.coalesce(F.col("buckets") == F.array(inverted.bucket_of("token")), F.lit(True))
    return names.join(found, "t", "left").select("token", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_chunks"),
                                                 own.alias("own_partition_only"))


@register("vector_topk", "R1 W1 E4", """
SELECT query_id, vec_id, score, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id,
         round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id
           ORDER BY round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) DESC,
                    c.vec_id) AS rank
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0) WHERE rank <= 5""")
def vector_topk(spark, sf):
    """The stated query set (ids divisible by 100) against all vectors."""
    emb = table(spark, sf, "embeddings")
    q = emb.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    idx = emb.select("vec_id", F.col("embedding").alias("vec"))
    return retrieval.vector_topk(q, idx, k=5, query_key="query_id", index_keys=("vec_id",),
                                 digits=6)


@register("embed_sparse_md5", "E2 E3 E4", f"""
WITH {md5_counts_cte('c', 'documents', 'doc_id')}
SELECT doc_id, idx, cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY doc_id)) AS weight FROM c""")
def embed_sparse_md5(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return embedding.embed_md5_sparse(docs, ["doc_id"])


@register("embed_blake2b", "E1 U1 E5")
def embed_blake2b(spark, sf):
    """Exact reference hash; no DuckDB blake2b, so rows-only here plus a Python-model test."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    v = embedding.embed_blake2b(F.col("text"))
    return docs.select("doc_id", v.alias("embedding"))


def blended_ctes(q_sql: str, k: int = 5) -> str:
    """chunks, q, m and fin (every query x chunk pair with its three scores), top."""
    return f"""{CHUNKS_CTE},
q AS ({q_sql}),
{md5_counts_cte('cv', 'chunks', 'chunk_id')},
{md5_counts_cte('qv', 'q', 'query_id')},
cn AS (SELECT chunk_id, sqrt(sum(cnt * cnt)::DOUBLE) AS norm FROM cv GROUP BY chunk_id),
qn AS (SELECT query_id, sqrt(sum(cnt * cnt)::DOUBLE) AS norm FROM qv GROUP BY query_id),
dots AS (SELECT qv.query_id, cv.chunk_id, sum(qv.cnt * cv.cnt) AS d
         FROM qv JOIN cv USING (idx) GROUP BY qv.query_id, cv.chunk_id),
vs AS (SELECT q.query_id, c.chunk_id, c.doc_id, c.chunk_index, c.text AS chunk_text,
              CASE WHEN coalesce(qn.norm, 0) > 0 AND coalesce(cn.norm, 0) > 0
                   THEN coalesce(dots.d, 0)::DOUBLE / (qn.norm * cn.norm) ELSE 0.0 END AS vec_score
       FROM q CROSS JOIN chunks c
       LEFT JOIN qn ON qn.query_id = q.query_id
       LEFT JOIN cn ON cn.chunk_id = c.chunk_id
       LEFT JOIN dots ON dots.query_id = q.query_id AND dots.chunk_id = c.chunk_id),
{keyword_matches_cte()},
fin AS (SELECT vs.*, coalesce(m.score, 0.0) AS kw_score,
               0.7::DOUBLE * vec_score + (1.0::DOUBLE - 0.7::DOUBLE) * coalesce(m.score, 0.0) AS score
        FROM vs LEFT JOIN m ON m.query_id = vs.query_id AND m.chunk_id = vs.chunk_id),
top AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank
  FROM fin) WHERE rank <= {k})"""


def _index(spark, sf):
    """The chunk index: token sets and hashed vectors of all documents' chunks."""
    return retrieval.build_index(table(spark, sf, "documents").select("doc_id", "text"))


def _query_vectors(spark, sf):
    return embedding.embed_md5_vectors(_queries(spark, sf), ["query_id", "text"])


@register("blended_topk", "E2 R1 R2 R3 R4 W1", f"""
WITH {blended_ctes("SELECT item_id AS query_id, text FROM benchmark")}
SELECT query_id, chunk_id, doc_id, chunk_index, vec_score, kw_score, score, rank FROM top""")
def blended_topk(spark, sf):
    """All benchmark items against all chunks, by the blend."""
    return retrieval.blended_topk(_query_vectors(spark, sf), _index(spark, sf), k=5)


HYBRID_SQL = f"""
WITH {blended_ctes("SELECT item_id AS query_id, text FROM benchmark")},
vtop AS (SELECT query_id, chunk_id FROM (
           SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id
                  ORDER BY vec_score DESC, doc_id, chunk_index, chunk_id) AS rn FROM vs) WHERE rn <= 10),
ktop AS (SELECT query_id, chunk_id FROM (
           SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id
                  ORDER BY score DESC, doc_id, chunk_index) AS rn FROM m) WHERE rn <= 10),
scored AS (SELECT fin.* FROM fin JOIN (SELECT * FROM vtop UNION SELECT * FROM ktop) c
           ON c.query_id = fin.query_id AND c.chunk_id = fin.chunk_id)
SELECT query_id, chunk_id, doc_id, chunk_index, vec_score, kw_score, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank
  FROM scored) WHERE rank <= 5"""


@register("hybrid_topk", "R6 R7", HYBRID_SQL)
def hybrid_topk(spark, sf):
    """The candidate mode of a managed search service over the same index."""
    return retrieval.hybrid_topk(_query_vectors(spark, sf), _index(spark, sf), k=5)


@register("reranked_topk", "R7", HYBRID_SQL[:HYBRID_SQL.index("SELECT query_id, chunk_id, doc_id, chunk_index, vec_score, kw_score, score, rank FROM (")].rstrip() + rf""",
want AS (SELECT query_id, unnest({kwset('text')}) AS tok FROM q),
asked AS (SELECT query_id, count(*) AS n FROM want GROUP BY query_id),
word AS (SELECT query_id, chunk_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM (
           SELECT query_id, chunk_id, list_transform(list_filter(regexp_split_to_array(chunk_text, '{SPACE}'),
                  lambda t: length(t) > 0), lambda t: lower(t)) AS w FROM scored)),
hit AS (SELECT word.* FROM word JOIN want USING (query_id, tok)),
found AS (SELECT query_id, chunk_id, count(DISTINCT tok) AS matched FROM hit GROUP BY ALL),
nxt AS (SELECT a.query_id, a.chunk_id, a.pos, b.tok, min(b.pos) AS p FROM (SELECT DISTINCT query_id, chunk_id, pos FROM hit) a
        JOIN hit b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos >= a.pos GROUP BY ALL),
run AS (SELECT nxt.query_id, nxt.chunk_id, nxt.pos, max(p) - nxt.pos + 1 AS len FROM nxt JOIN found USING (query_id, chunk_id)
        GROUP BY nxt.query_id, nxt.chunk_id, nxt.pos, matched HAVING count(*) = matched),
cover AS (SELECT query_id, chunk_id, min(len) AS cover FROM run GROUP BY ALL),
rr AS (SELECT s.query_id, s.chunk_id, s.doc_id, s.chunk_index, s.score AS base_score, coalesce(matched, 0)::INTEGER AS matched,
              coalesce(cover, 0)::INTEGER AS cover, CASE WHEN matched >= 2 THEN matched * matched / (n * cover)::DOUBLE END AS reranker_score
       FROM scored s LEFT JOIN found USING (query_id, chunk_id) LEFT JOIN cover USING (query_id, chunk_id) LEFT JOIN asked USING (query_id))
SELECT query_id, chunk_id, doc_id, chunk_index, base_score, matched, cover, reranker_score, score, rank FROM (
  SELECT *, coalesce(reranker_score, base_score) AS score, row_number() OVER (PARTITION BY query_id
         ORDER BY coalesce(reranker_score, base_score) DESC, doc_id, chunk_index) AS rank FROM rr) WHERE rank <= 5""")
def reranked_topk(spark, sf):
    """The candidates of ``hybrid_topk``, ranked again by how near each other the query's words stand."""
    return retrieval.reranked_topk(_query_vectors(spark, sf), _index(spark, sf), k=5)


@register("subword_windows", "C1 C2 U2", """
SELECT doc_id, length(text)::BIGINT AS n_chars, TRUE AS exact_slices, TRUE AS no_gap, TRUE AS full_windows, TRUE AS ids_in_order
FROM documents WHERE length(text) >= 1""")
def subword_windows(spark, sf, tokenizer: str = "byte_bpe_50k.json"):
    """Windows of 400 subword tokens (40 shared) over all documents: every window is the text's
    slice at its offsets, windows leave no gap, all but a text's last hold 400 tokens."""
    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        spec = f.read()
    docs = table(spark, sf, "documents").select("doc_id", "text")
    win = saved(chunking.subword_windows(docs, spec), "windows")
    nxt = win.select("doc_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("start").alias("_next"))
    sizes = docs.select("doc_id", F.length("text").alias("_length"))
    met = win.drop("text").join(nxt, ["doc_id", "chunk_index"], "left").join(sizes, "doc_id")
    last = F.col("_next").isNull()
    gap = F.when(last, F.col("stop") == F.col("_length")).otherwise(F.col("_next") <= F.col("stop"))
    gap = gap & F.when(F.col("chunk_index") == 0, F.col("start") == 0).otherwise(True)
    full = F.when(last, F.col("n_tokens").between(0, 400)).otherwise(F.col("n_tokens") == 400)
    named = F.col("chunk_id") == F.format_string("%s_chunk_%04d", F.col("doc_id").cast("string"), F.col("chunk_index").cast("int"))
    met = met.groupBy("doc_id").agg(F.max("stop").alias("n_chars"), F.every(gap).alias("no_gap"), F.every(full).alias("full_windows"),
                                    F.every(named).alias("ids_in_order"))
    # a text meets its own windows in one row: it is not repeated for each of them
    own = win.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "text")).alias("_own"))
    slices = own.join(docs.where(F.col("text").isNotNull()), "doc_id").groupBy("doc_id").agg(F.every(F.forall(
        "_own", lambda w: w["text"] == F.substr("text", (w["start"] + 1).cast("int"), (w["stop"] - w["start"]).cast("int")))).alias("exact_slices"))
    return met.join(slices, "doc_id").select("doc_id", "n_chars", "exact_slices", "no_gap", "full_windows", "ids_in_order")


@register("embed_by_content", "E5 E2 S8", """
SELECT (SELECT count(*) FROM documents)::BIGINT AS n_texts, (SELECT count(DISTINCT coalesce(text, '')) FROM documents)::BIGINT AS first_embedded,
       0::BIGINT AS again_embedded,
       (SELECT count(DISTINCT t) FROM (SELECT 'edited ' || coalesce(text, '') AS t FROM documents WHERE doc_id % 100 = 0)
        WHERE t NOT IN (SELECT coalesce(text, '') FROM documents))::BIGINT AS edited_embedded, TRUE AS vectors_equal""")
def embed_by_content(spark, sf):
    """All documents embedded, embedded again (nothing is new) and with one document in a hundred
    edited (only those are new); the vectors are those of a plain run."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    store = vector_store.VectorStore(spark, scratch_path(spark, "vectors"))
    first, n1 = store.embed(docs)
    again, n2 = store.embed(docs)
    mark = F.concat(F.lit("edited "), F.coalesce("text", F.lit("")))
    edited, n3 = store.embed(docs.withColumn("text", F.when(F.col("doc_id") % 100 == 0, mark).otherwise(F.col("text"))))
    vec = lambda df, name: df.select("doc_id", F.struct("idx", "cnt", "norm").alias(name))
    plain = embedding.embed_md5_vectors(docs.withColumn("text", F.coalesce("text", F.lit(""))), ["doc_id", "text"])
    met = vec(plain, "_p").join(vec(first, "_f"), "doc_id", "left").join(vec(again, "_a"), "doc_id", "left").join(
        edited.select("doc_id", F.col("norm").alias("_n")), "doc_id", "left")
    same = F.col("_p").eqNullSafe(F.col("_f")) & F.col("_p").eqNullSafe(F.col("_a")) & F.col("_n").isNotNull()
    count = lambda n: F.lit(n).cast("bigint")
    return met.agg(F.count("*").alias("n_texts"), F.every(same).alias("vectors_equal")).select(
        "n_texts", count(n1).alias("first_embedded"), count(n2).alias("again_embedded"), count(n3).alias("edited_embedded"), "vectors_equal")
