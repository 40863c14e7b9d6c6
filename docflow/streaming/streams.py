"""Structured Streaming operators (ST1-ST6).

Sources are file streams over a table (one file, a folder of part files, and files that
arrive later); state is bounded by watermarks. Append results go to a parquet sink, updated
aggregates are written per batch and read back by key, so nothing gathers in the driver.
Checkpoints live under the session's shared ``spark.checkpoint.dir`` at a path named by the
job, so a restarted driver resumes where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions import pii
from docflow.operators import chunking, classify, embedding, lookups
from docflow.session import job_path
from docflow.sources import files
from docflow.sources.buckets import BucketTable


def file_stream(spark: SparkSession, folder: str, table_name: str,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file stream of one table in ``folder``: ``<table>.parquet`` as a file or a
    folder of part files (a glob finds either). The schema is taken from the files once."""
    path = f"{folder.rstrip('/')}/{table_name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(f"{path[:-1]}[t]")


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Parquet timestamps arrive as TIMESTAMP_NTZ; watermarks need TIMESTAMP (UTC)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def daily_counts(events: DataFrame, key: str = "event_type", delay: str = "1 day") -> DataFrame:
    """ST3: tumbling 1-day windows per key; late rows beyond ``delay`` are dropped."""
    e = event_time(events).withWatermark("ts", delay)
    return e.groupBy(F.window("ts", "1 day"), key).agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, key: str = "event_type", length: str = "7 days",
                   slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """ST4: the nightly N-day look-back as sliding windows."""
    e = event_time(events).withWatermark("ts", delay)
    return e.groupBy(F.window("ts", length, slide), key).agg(F.count(F.lit(1)).alias("n"))


def cost_rollup(turns: DataFrame, prices: DataFrame, ts: str | None = None,
                window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """ST5: stream-static join with the (broadcast) price table, then token and cost
    totals per model - per event-time window with a watermark when ``ts`` is given (state
    bounded by the watermark), else running totals. turns: model, tokens_in, tokens_out
    [, ts]."""
    priced = lookups.with_cost(turns, prices)
    keys = ["model"]
    if ts is not None:
        priced = event_time(priced, ts).withWatermark(ts, delay)
        keys = [F.window(ts, window), "model"]
    return priced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost_usd"), 9).alias("cost_usd"))


def dedupe(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """ST6: re-delivered rows collapse by key (an event's id); a copy that comes later than
    ``delay`` after the first is a new row, as state is dropped once the watermark passes."""
    return event_time(events).withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def classify_route(docs: DataFrame, model, dim: int, threshold: float = classify.CONFIDENCE_THRESHOLD) -> DataFrame:
    """ST1: arriving documents through redaction, embedding, the trained model and routing,
    all narrow (append mode): doc_id, changed, intent, confidence, route, model_version."""
    red = docs.select("doc_id", pii.redact("text").alias("r"), "text")
    red = red.select("doc_id", F.col("r").alias("text"), (F.col("r") != F.col("text")).alias("changed"))
    return classify.bulk_classify(model, red, dim, threshold, carry=("changed",))


def index_upkeep_batch(base: str, dim: int = embedding.DEFAULT_DIM) -> Callable[[DataFrame, int], None]:
    """ST2 foreachBatch body: chunk and embed the micro-batch and write it as a delta of the
    stored index. Overwriting ``delta/<batch id>`` makes a replayed batch idempotent; the cost
    of a batch follows the batch, not the index."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        chunks = chunking.chunk_documents(batch.select("doc_id", "text"))
        embedding.embed_md5_vectors(chunks, None, "text", dim).withColumn("version", F.lit(batch_id).cast("bigint")) \
            .write.mode("overwrite").parquet(f"{base}/delta/{batch_id}")
    return fn


def _deltas(spark: SparkSession, base: str) -> DataFrame | None:
    if not files.exists(spark, f"{base}/delta"):
        return None
    return spark.read.parquet(f"{base}/delta/*")


def read_index(spark: SparkSession, base: str) -> DataFrame | None:
    """The upkept index: the compacted version and the deltas, latest version per chunk."""
    stored, deltas = files.current(spark, base), _deltas(spark, base)
    if stored is None:
        return None if deltas is None else files.upsert(deltas.limit(0), deltas)
    kept = spark.read.parquet(stored)
    return kept if deltas is None else files.upsert(kept, deltas)


def compact_index(spark: SparkSession, base: str) -> str:
    """Upsert all deltas into a new stored version and swap to it; its path. Deltas stay (they
    upsert to the same rows) until a clean-up removes those older than the version."""
    target = f"{base}/v{files.next_version(spark, base)}"
    files.write_index(read_index(spark, base), target)
    files.set_current(spark, base, target)
    return target


def bucket_upkeep_batch(index: BucketTable, dim: int = embedding.DEFAULT_DIM) -> Callable[[DataFrame, int], None]:
    """ST2 over a bucketed table: the micro-batch's chunks become a delta; ``index.fold`` merges the
    deltas into the buckets that they touch and retires them, as often as the operator likes."""
    def fn(batch: DataFrame, batch_id: int) -> None:
        chunks = chunking.chunk_documents(batch.select("doc_id", "text"))
        vectors = embedding.embed_md5_vectors(chunks, None, "text", dim)
        index.append_delta(vectors.withColumn("version", F.lit(batch_id).cast("bigint")), batch_id)
    return fn


def run_append(df: DataFrame, job: str, path: str) -> DataFrame:
    """Run over everything available now into a parquet sink at ``path``; the sink as a
    batch DataFrame."""
    spark = df.sparkSession
    q = (df.writeStream.outputMode("append").format("parquet").option("path", path)
           .option("checkpointLocation", job_path(spark, job)).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_updates(df: DataFrame, job: str, path: str, keys: list[str]) -> DataFrame:
    """Run an aggregation in update mode: each batch writes the groups that changed (a
    replayed batch overwrites its own folder); read back as the last state of each key.
    Unlike complete mode this keeps only what the watermark still needs."""
    spark = df.sparkSession

    def fn(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    run_foreach_batch(df, job, fn, "update")
    schema = T.StructType([*df.schema.fields, T.StructField("_batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/*")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def run_foreach_batch(df: DataFrame, job: str, fn, mode: str = "append") -> None:
    spark = df.sparkSession
    q = (df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", job_path(spark, job))
           .trigger(availableNow=True).start())
    q.awaitTermination()
