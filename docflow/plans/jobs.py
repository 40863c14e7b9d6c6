"""Batch jobs composing the operators (S11, M3/M5/M7, P5): what a scheduler would submit.

Each job reads its inputs through Spark, writes its outputs through Spark, and returns
small DataFrames (one-row summaries) for the caller; nothing is collected except the
bounded gate values needed to decide an exit status.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators import chunking, classify, embedding, metrics
from docflow.operators import regression as rg
from docflow.sources import files
from docflow.sources.buckets import BucketTable


def index_job(spark: SparkSession, corpus_dir: str, out_dir: str, push: bool = False,
              max_tokens: int = chunking.DEFAULT_MAX_TOKENS,
              overlap_tokens: int = chunking.DEFAULT_OVERLAP, dim: int = embedding.DEFAULT_DIM,
              version: int | None = None, buckets: int | None = None) -> DataFrame:
    """Read corpus (S1) -> chunk (C1) -> dump JSONL (S6) -> manifest (S10) -> with
    ``push``: embed (E2) and upsert into the keyed index (S8/S9) as a new version (the last
    one plus 1), then swap. A failed write leaves the live version untouched. Returns the
    manifest summary row; ``uploaded`` = number of chunks pushed (0 without push). With
    ``buckets`` the index is a bucketed table (``sources.buckets``) at ``index-buckets``: a push writes only
    the buckets that its chunks fall in."""
    docs = files.read_corpus(spark, corpus_dir)
    chunks = chunking.chunk_documents(docs, max_tokens, overlap_tokens)
    files.dump_chunks(chunks, f"{out_dir}/chunks")
    written = spark.read.schema(chunks.schema).json(f"{out_dir}/chunks")   # lineage cut
    files.write_manifest(written, f"{out_dir}/manifest")
    uploaded = F.lit(0).cast("bigint")
    if push and buckets:
        new = embedding.embed_md5_vectors(written, None, "text", dim)
        index = index_table(spark, out_dir, new.withColumn("version", F.lit(0).cast("bigint")).schema, buckets)
        index.upsert(new.withColumn("version", F.lit(index.number() + 1 if version is None else version).cast("bigint")))
        index.retire()
        uploaded = F.lit(written.count()).cast("bigint")
    elif push:
        base = f"{out_dir}/index"
        version = files.next_version(spark, base) if version is None else version
        new = embedding.embed_md5_vectors(written, None, "text", dim).withColumn("version", F.lit(version))
        cur = files.create_index(spark, base, new.schema)
        target = f"{base}/v{version}"
        files.write_index(files.upsert(spark.read.parquet(cur), new), target)
        files.set_current(spark, base, target)   # readers switch only now
        uploaded = F.lit(written.count()).cast("bigint")
    return spark.read.json(f"{out_dir}/manifest/summary").select(
        "chunk_count", "n_documents", uploaded.alias("uploaded"))


def index_table(spark: SparkSession, out_dir: str, schema, buckets: int) -> BucketTable:
    """The bucketed index that ``index_job`` keeps."""
    return BucketTable(spark, f"{out_dir}/index-buckets", schema, buckets=buckets)


def train_evaluate_job(spark: SparkSession, docs: DataFrame, labels: DataFrame, gold: DataFrame,
                       model_dir: str, dim: int = classify.DEFAULT_DIM,
                       floor: float = metrics.MACRO_F1_FLOOR) -> DataFrame:
    """M3 -> M5 chained (M7): train, save (S12), log the run (S13), evaluate on the gold
    set, gate on macro F1 (V13). Returns the evaluation row with ``passed``."""
    model, train_m, report = classify.train_job(docs, labels, dim)
    classify.save_head(model, model_dir, dim)
    report.write.mode("overwrite").json(f"{model_dir}/report")            # S20
    sizes = labels.agg(F.count_distinct("doc_id").alias("d"), F.count_distinct("label").alias("c")).first()
    files.append_run(spark, f"{model_dir}/runs", "train", {
        "dim": str(dim), "head": "lr", "provider": "md5-hashed-bow", "n_documents": str(sizes["d"]),
        "n_classes": str(sizes["c"])}, train_m)
    loaded, dim2 = classify.load_head(spark, model_dir)
    ev = classify.evaluate_job(loaded, dim2, docs, gold).withColumn("passed", F.col("macro_f1") >= floor)
    files.write_summary(f"{model_dir}/summary", ev)                       # S19
    return ev


def regression_job(spark: SparkSession, traces: DataFrame, scores: DataFrame, baseline_path: str,
                   generated_at: str, threshold: float = rg.JUDGE_REGRESSION_THRESHOLD):
    """P5: judge run (P4) -> aggregate -> baseline (saved when missing, S18) -> verdict
    (A15) -> report header + per-doc rows (A17)."""
    per_doc, agg = rg.judge_run(traces, scores)
    current = agg.select(F.col("mean_score"), F.lit(generated_at).alias("generated_at"),
                         F.col("n_traces"))
    base = files.baseline_or_save(spark, baseline_path, current)
    base_mean = (base.select("mean_score").scalar() if base is not None
                 else F.lit(None).cast("double"))
    header = rg.regression_report(agg, base_mean, F.lit(generated_at), threshold)
    return header, per_doc
