"""Sources and sinks (S1-S7, S10, S12, S13, S17-S20) over Spark's file formats.

Everything reads and writes through ``spark.read`` / ``df.write``; no file is opened on
the driver, so a corpus of any size streams through the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow import contracts


def read_corpus(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Every ``*.txt`` directly in ``path`` -> (doc_id = file stem, text = whole file,
    source = 'local'). The file URI's ``%XX`` are decoded back to the literal name; a ``+`` stays.
    Order is not part of the result; ``ordered_corpus`` has it."""
    df = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    return df.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("doc_id"), F.col("value").alias("text"),
                     F.lit("local").alias("source"))


def ordered_corpus(docs: DataFrame) -> DataFrame:
    """The corpus by document id, as the indexer walks it: a range-partitioned sort (no
    single task sees the whole corpus)."""
    return docs.orderBy("doc_id")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema (blank lines are skipped by the
    reader); no inference. Malformed lines surface as all-null rows for validation."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def load_intents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S2 + V2: gold intents, duplicates kept; (valid, unknown-intent quarantine)."""
    df = read_jsonl(spark, path, contracts.GOLD_INTENT)
    return contracts.split_valid(df, [("intent_unknown", contracts.not_intent("intent"))])


def with_line_order(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their place: (file path, start of the split in the file, row in the
    split). Files order by path, lines by position; nothing is collected."""
    meta = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = spark.read.text(path).select(meta.alias("_m"), "value")
    place = F.struct(F.col("_m.file").alias("file"), F.col("_m.block").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return raw.select(place.alias("_ord"), "value")


def load_labels_last_wins(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same file as a mapping doc_id -> intent where the *last* line wins (files in
    path order); (valid, quarantine of unknown intents). The winner per doc_id is
    ``max_by(intent, place)`` - a partial aggregation."""
    raw = with_line_order(spark, path).where(F.length(F.trim("value")) > 0)
    parsed = raw.select("_ord", F.from_json("value", contracts.GOLD_INTENT).alias("r"))
    last = parsed.groupBy(F.col("r.doc_id").alias("doc_id")).agg(F.max_by("r.intent", "_ord").alias("intent"))
    return contracts.split_valid(last, [("intent_unknown", contracts.not_intent("intent"))])


def load_gold_fields(spark: SparkSession, path: str) -> DataFrame:
    """Gold fields, one row per (doc_id, name): name, value - a document without fields
    keeps one row with a null name, so it still counts."""
    gold = read_jsonl(spark, path, contracts.GOLD_FIELDS)
    return gold.select("doc_id", F.explode_outer("fields").alias("name", "value"))


def load_judge_prompts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Judge prompts; (valid, quarantine of rows without id or prompt, or unknown intent)."""
    df = read_jsonl(spark, path, contracts.JUDGE_PROMPT)
    return contracts.split_valid(df, [("doc_id_null", F.col("doc_id").isNull()), ("prompt_null", F.col("prompt").isNull()),
                                      ("intent_unknown", contracts.not_intent("reference_intent"))])


def write_traces(traces: DataFrame, path: str) -> None:
    """Traces as JSON lines."""
    traces.write.mode("overwrite").json(path)


def dump_chunks(chunks: DataFrame, path: str) -> None:
    """JSON-lines sink, overwrite."""
    chunks.write.mode("overwrite").json(path)


def load_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S7 + V1: chunk JSONL with the chunk contract checked; (valid, quarantine)."""
    return contracts.split_valid(read_jsonl(spark, path, contracts.CHUNK), contracts.chunk_rules())


def write_manifest(chunks: DataFrame, path: str) -> None:
    """Header (chunk_count, n_documents) as JSON plus the distinct doc ids as a
    table beside it - never one giant list in one row."""
    chunks.agg(F.count(F.lit(1)).alias("chunk_count"),
               F.countDistinct("doc_id").alias("n_documents")) \
          .write.mode("overwrite").json(f"{path}/summary")
    chunks.select("doc_id").distinct().write.mode("overwrite").parquet(f"{path}/doc_ids")


def append_run(spark: SparkSession, path: str, run_id: str, params: dict[str, str],
               metrics: DataFrame) -> None:
    """Append one row to a runs table: run_id, params MAP, metrics MAP.

    ``metrics`` is a one-row frame of numeric columns (e.g. from classifier_metrics)."""
    cols = [c for c, t in metrics.dtypes if t in ("double", "float", "int", "bigint")]
    m = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("double"))])
    p = F.create_map(*[x for k, v in params.items() for x in (F.lit(k), F.lit(str(v)))])
    metrics.select(F.lit(run_id).alias("run_id"), p.alias("params"), m.alias("metrics")) \
           .write.mode("append").parquet(path)


def write_summary(path: str, classifier: DataFrame, extraction: DataFrame | None = None,
                  judge: DataFrame | None = None) -> DataFrame:
    """One row of nested sections (classifier, extraction, judge), written as JSON with
    missing sections as nulls; returns the row."""
    def section(df):
        return F.struct(*[F.col(c) for c in df.columns]).alias("s")
    out = classifier.select(section(classifier).alias("classifier"))
    for name, df in (("extraction", extraction), ("judge", judge)):
        col = F.lit(None).cast("string") if df is None else df.select(section(df)).scalar()
        out = out.withColumn(name, col)
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in its store. Other failures (no access, no such store) rise."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def baseline_or_save(spark: SparkSession, path: str, current: DataFrame) -> DataFrame | None:
    """The baseline JSON if there is one; otherwise write ``current`` as the baseline
    and return None (a missing baseline is never a regression). A baseline that can't be read
    is an error and stays as it is."""
    if exists(spark, path):
        return spark.read.schema(current.schema).option("mode", "FAILFAST").json(path)
    current.write.mode("errorifexists").json(path)
    return None


# ---- S8/S9: keyed index table ----------------------------------------------


def _latest(df: DataFrame, key: str, version: str) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    win = F.max_by(F.struct(*cols), F.col(version))
    return df.groupBy(key).agg(win.alias("_r")).select(key, "_r.*")


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """Replace-by-key; the row with the highest ``version`` wins per key, whatever the
    sizes of the two frames. A partial ``max_by`` aggregation (combined map-side) instead of a
    window, so hot keys never gather in one task before reduction."""
    return _latest(existing.unionByName(new), key, version)


INDEX_BYTES = 256 << 20


def create_index(spark: SparkSession, base: str, schema: T.StructType) -> str:
    """Create the typed, empty index table at ``base`` if there is none; its current path."""
    path = current(spark, base)
    if path is None:
        path = f"{base}/v0"
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        set_current(spark, base, path)
    return path


def next_version(spark: SparkSession, base: str) -> int:
    """One more than the current version, 1 for a new table."""
    path = current(spark, base)
    return 1 if path is None else int(path.rsplit("/v", 1)[1]) + 1


def write_index(df: DataFrame, path: str, key: str = "chunk_id") -> None:
    """The index as parquet, rows of one key hash together, files of about the advisory
    partition size: Spark rebalances by the data's size, at any size."""
    df.hint("rebalance", key).write.mode("errorifexists").parquet(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces JSONL (blank lines skipped); an empty trace set is an error, decided by one
    row."""
    df = spark.read.schema(contracts.TRACE).json(path)
    if df.isEmpty():
        raise ValueError(f"no traces to score in {path}")
    return df


def set_current(spark: SparkSession, base: str, path: str) -> None:
    """S8/S9 swap: record ``path`` as the current version of the table rooted at ``base``: a
    new pointer table beside the old ones; readers take the last whole one."""
    n = max([-1, *_pointers(spark, base)]) + 1
    spark.createDataFrame([(path,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{base}/_current/{n}")


def _pointers(spark: SparkSession, base: str) -> list[int]:
    if not exists(spark, f"{base}/_current"):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_current")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
    names = [int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit()]
    return [n for n in names if exists(spark, f"{base}/_current/{n}/_SUCCESS")]


def current(spark: SparkSession, base: str) -> str | None:
    """The current version path recorded by ``set_current``, or None when the table does
    not exist yet. Read errors rise: a live table is never taken for an absent one."""
    known = _pointers(spark, base)
    return spark.read.text(f"{base}/_current/{max(known)}").first()[0] if known else None
