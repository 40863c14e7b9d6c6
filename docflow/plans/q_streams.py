"""Registered queries: Structured Streaming jobs run with ``availableNow`` (ST1-ST6).

Each drives a file stream over the table to completion and returns the sink as a batch
DataFrame; the oracle is the batch equivalent. Every run is a job of its own (a fresh name),
as the registered queries start from nothing.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import pii
from docflow.functions.text import count_tokens
from docflow.operators import chunking, classify, embedding, lookups
from docflow.plans.registry import register
from docflow.plans.sql_snippets import CHUNKS_CTE, md5_counts_cte, redact_sql
from docflow.session import scratch_path, table
from docflow.sources.buckets import BucketTable
from docflow.streaming import streams as st


def _updates(agg, name, keys):
    path = scratch_path(agg.sparkSession, name)
    return st.run_updates(agg, path.rsplit("/", 1)[-1], path, keys)


def _model(spark, sf):
    """Trained on the labelled documents (class = quality), redacted as the stream does."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    docs = table(spark, sf, "documents").select("doc_id", "text").join(lab, "doc_id")  # only these are redacted
    train = classify.features(docs.withColumn("text", pii.redact("text")), "text", classify.DEFAULT_DIM)
    return classify.fit_head(train)


def _window_cols(df):
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                     F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                     "event_type", F.col("n").cast("bigint").alias("n"))


@register("stream_daily_counts", "ST3", """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def stream_daily_counts(spark, sf):
    agg = st.daily_counts(st.file_stream(spark, sf, "events"))
    return _window_cols(_updates(agg, "st3", ["window", "event_type"]))


@register("stream_sliding_counts", "ST4", """
SELECT start AS window_start, start + INTERVAL 7 DAY AS window_end, event_type, count(*)::BIGINT AS n
FROM (SELECT event_type, date_trunc('day', ts) - to_days(k::INTEGER) AS start
      FROM events, range(0, 7) r(k)) GROUP BY ALL""")
def stream_sliding_counts(spark, sf):
    agg = st.sliding_counts(st.file_stream(spark, sf, "events"))
    return _window_cols(_updates(agg, "st4", ["window", "event_type"]))


@register("stream_cost_rollup", "ST5 JN8 J8", """
WITH t AS (SELECT (['gpt-4o', 'gpt-4o-mini', 'gpt-4-turbo', 'gpt-5.1'])[((conv_id + turn) % 4) + 1] AS model,
                  CASE WHEN role = 'assistant' THEN 0 ELSE len(string_split(text, ' ')) END AS tokens_in,
                  CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END AS tokens_out
           FROM conversations),
prices AS (SELECT * FROM (VALUES ('gpt-4o', 0.005::DOUBLE, 0.015::DOUBLE),
    ('gpt-4o-mini', 0.00015::DOUBLE, 0.0006::DOUBLE), ('gpt-4-turbo', 0.01::DOUBLE, 0.03::DOUBLE),
    ('text-embedding-3-large', 0.00013::DOUBLE, 0.0::DOUBLE),
    ('text-embedding-3-small', 0.00002::DOUBLE, 0.0::DOUBLE)) p(model, pin, pout))
SELECT t.model, count(*)::BIGINT AS n_calls, sum(tokens_in)::BIGINT AS tokens_in,
       sum(tokens_out)::BIGINT AS tokens_out,
       round(sum((tokens_in::DOUBLE / 1000.0::DOUBLE) * coalesce(p.pin, 0.005::DOUBLE)
                 + (tokens_out::DOUBLE / 1000.0::DOUBLE) * coalesce(p.pout, 0.015::DOUBLE)), 9) AS cost_usd
FROM t LEFT JOIN prices p ON p.model = t.model GROUP BY t.model""")
def stream_cost_rollup(spark, sf):
    conv = st.file_stream(spark, sf, "conversations")
    models = F.array(*[F.lit(m) for m in ("gpt-4o", "gpt-4o-mini", "gpt-4-turbo", "gpt-5.1")])
    n = count_tokens("text")
    asst = F.col("role") == "assistant"
    turns = conv.select(
        F.try_element_at(models, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) + 1).cast("int")).alias("model"),
        F.when(asst, F.lit(0)).otherwise(n).cast("bigint").alias("tokens_in"),
        F.when(asst, n).otherwise(F.lit(0)).cast("bigint").alias("tokens_out"))
    agg = st.cost_rollup(turns, lookups.price_table(spark))
    out = _updates(agg, "st5", ["model"])
    return out.select("model", F.col("n_calls").cast("bigint"), F.col("tokens_in").cast("bigint"),
                      F.col("tokens_out").cast("bigint"), "cost_usd")


@register("stream_dedup", "ST6", """
SELECT DISTINCT event_id, user_id, event_type FROM events""")
def stream_dedup(spark, sf):
    """Every event delivered twice (the stream read as two), kept once by its id."""
    ev = st.file_stream(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    again = st.file_stream(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    out = st.dedupe(ev.union(again), ["event_id"])
    path = scratch_path(spark, "st6")
    return st.run_append(out, path.rsplit("/", 1)[-1], path).select("event_id", "user_id", "event_type")


@register("stream_classify_route", "ST1 J1 V12 M6 U1", f"""
SELECT doc_id, {redact_sql('text')} <> text AS changed, TRUE AS same_as_batch, TRUE AS routed
FROM documents""")
def stream_classify_route(spark, sf):
    """The trained model over the stream; ``same_as_batch``: intent, confidence and route
    equal the batch job's on the same redacted text."""
    model = _model(spark, sf)
    docs = st.file_stream(spark, sf, "documents")
    path = scratch_path(spark, "st1")
    out = st.run_append(st.classify_route(docs, model, classify.DEFAULT_DIM), path.rsplit("/", 1)[-1], path)
    batch = st.classify_route(table(spark, sf, "documents"), model, classify.DEFAULT_DIM)
    batch = batch.select("doc_id", F.struct("intent", "confidence", "route").alias("_b"))
    sure = F.col("confidence") >= classify.CONFIDENCE_THRESHOLD
    return out.join(batch, "doc_id").select(
        "doc_id", "changed", (F.struct("intent", "confidence", "route") == F.col("_b")).alias("same_as_batch"),
        ((F.col("route") == F.when(sure, "fast").otherwise("escalate_to_reason")) & F.col("confidence").between(0, 1)).alias("routed"))


_INDEX_SQL = f"""
WITH {CHUNKS_CTE},
{md5_counts_cte('cv', 'chunks', 'chunk_id')},
cn AS (SELECT chunk_id, count(*) AS n_buckets, sum(cnt * cnt)::DOUBLE AS sq FROM cv GROUP BY chunk_id)
SELECT chunk_id, doc_id, chunk_index, text, n_tokens, coalesce(n_buckets, 0)::BIGINT AS n_buckets,
       coalesce(sq, 0.0) AS squared_norm
FROM chunks LEFT JOIN cn USING (chunk_id)"""


def _index_rows(out):
    square = F.aggregate("cnt", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("chunk_id", "doc_id", "chunk_index", "text", "n_tokens",
                      F.size("idx").cast("bigint").alias("n_buckets"), square.alias("squared_norm"))


@register("stream_index_upkeep", "ST2 S8 S9 C1 E2", _INDEX_SQL)
def stream_index_upkeep(spark, sf):
    """Documents indexed as they arrive, with vectors, then compacted into a stored version."""
    base = scratch_path(spark, "st2-index")
    st.run_foreach_batch(st.file_stream(spark, sf, "documents"), base.rsplit("/", 1)[-1], st.index_upkeep_batch(base))
    st.compact_index(spark, base)
    return _index_rows(st.read_index(spark, base))


@register("stream_bucket_upkeep", "ST2 S8 S9 C1 E2", _INDEX_SQL)
def stream_bucket_upkeep(spark, sf):
    """The same over a bucketed table: deltas folded into the buckets they touch, then retired."""
    base = scratch_path(spark, "st2-buckets")
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(0)
    rows = embedding.embed_md5_vectors(chunking.chunk_documents(docs), None, "text").withColumn("version", F.lit(0).cast("bigint"))
    index = BucketTable(spark, base, rows.schema)
    st.run_foreach_batch(st.file_stream(spark, sf, "documents"), base.rsplit("/", 1)[-1], st.bucket_upkeep_batch(index))
    index.fold()
    return _index_rows(index.read())
