"""Registered queries: sources and sinks, parameter checks and model jobs on round trips of the
given tables (S1-S7, S10, S12, S13, S17, S19, S20, V1, V2, V8, V9, W4, W6, E1, E5, E6, R5, U3, U8, J11, M2-M5, M7)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from docflow import contracts
from docflow.operators import chunking, classify, embedding, retrieval
from docflow.plans import jobs
from docflow.plans.registry import register
from docflow.plans.sql_snippets import CHUNKS_CTE, words
from docflow.session import saved, scratch_path, table
from docflow.sources import files


def _refuses(fn, *args) -> bool:
    try:
        fn(*args)
    except ValueError:
        return True
    return False


# ---- corpora -----------------------------------------------------------------------------------


def _write_texts(spark, folder: str, rows) -> None:
    """One ``<id>.txt`` per row of a small table, in the store that ``folder`` names."""
    conf = spark._jsc.hadoopConfiguration()
    for name, text in rows:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.txt")
        out = path.getFileSystem(conf).create(path)
        out.write(text.encode())
        out.close()


@register("corpus_folder", "S1 W6", """
SELECT item_id::VARCHAR AS doc_id, text, 'local' AS source, TRUE AS in_order FROM benchmark
UNION ALL SELECT 'odd name+%20é', 'x', 'local', TRUE""")
def corpus_folder(spark, sf):
    """The benchmark items as a folder of text files, read as a corpus and walked in order; a file
    of another kind beside them is left out."""
    folder = scratch_path(spark, "corpus")
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("string"), "text").collect()  # the stated item set
    _write_texts(spark, folder, [*items, ("odd name+%20é", "x")])
    spark.createDataFrame([("not a document",)], "v string").write.mode("append").json(f"{folder}/other")
    docs = saved(files.ordered_corpus(files.read_corpus(spark, folder)).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    before = F.lag("doc_id").over(Window.partitionBy(F.shiftright("_at", 33)).orderBy("_at"))
    rows = docs.withColumn("_ok", F.coalesce(before <= F.col("doc_id"), F.lit(True)))
    parts = docs.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("p").collect()
    whole = all(a["hi"] <= b["lo"] for a, b in zip(parts, parts[1:], strict=False))  # a row a partition
    return rows.select("doc_id", "text", "source", (F.col("_ok") & F.lit(whole)).alias("in_order"))


# ---- JSON lines --------------------------------------------------------------------------------


@register("gold_intents_file", "S2 V2 S3 W4", """
SELECT doc_id::VARCHAR AS doc_id, CASE WHEN quality = 1 THEN 'nda' ELSE 'invoice' END AS intent, quality = 1 AS valid,
       2::BIGINT AS n_lines, CASE WHEN quality = 1 THEN 'nda' ELSE 'invoice' END AS last_intent, quality = 1 AS last_valid
FROM labels""")
def gold_intents_file(spark, sf):
    """Labels as a JSON-lines file, every document twice ('msa' first): all lines with the unknown
    intents set apart, and the last line of each document."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"),
                                            F.when(F.col("quality") == 1, "nda").otherwise("invoice").alias("intent"))
    path = scratch_path(spark, "intents")
    lines = lab.select(F.lit(0).alias("_n"), "doc_id", F.lit("msa").alias("intent")).unionByName(lab.select(F.lit(1).alias("_n"), "*"))
    lines.repartition(1).sortWithinPartitions("_n").drop("_n").write.json(path)  # one file: its lines have an order
    valid, unknown = files.load_intents(spark, path)
    rows = valid.withColumn("valid", F.lit(True)).unionByName(unknown.drop("errors").withColumn("valid", F.lit(False)))
    count = rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    good, bad = files.load_labels_last_wins(spark, path)
    last = good.withColumn("last_valid", F.lit(True)).unionByName(bad.drop("errors").withColumn("last_valid", F.lit(False)))
    return (rows.where("intent <> 'msa'").join(count, "doc_id")
            .join(last.withColumnRenamed("intent", "last_intent"), "doc_id"))


@register("gold_fields_file", "S4", """
SELECT doc_id::VARCHAR AS doc_id, unnest(['lang', 'source']) AS name, unnest([lang, source]) AS value FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT doc_id::VARCHAR, NULL, NULL FROM documents WHERE doc_id % 10 = 0""")
def gold_fields_file(spark, sf):
    """Language and source as gold fields of every document (one in ten has none), written and read."""
    docs = table(spark, sf, "documents")
    fields = F.when(F.col("doc_id") % 10 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    path = scratch_path(spark, "gold-fields")
    docs.select(F.col("doc_id").cast("string").alias("doc_id"), fields.alias("fields")).write.json(path)
    return files.load_gold_fields(spark, path)


@register("judge_prompts_file", "S5", """
SELECT CASE WHEN doc_id % 5 = 1 THEN NULL ELSE doc_id::VARCHAR END AS doc_id, CASE WHEN doc_id % 5 = 2 THEN NULL ELSE 'Judge ' || doc_id::VARCHAR END AS prompt,
       CASE WHEN doc_id % 5 = 3 THEN 'letter' ELSE 'rfp' END AS reference_intent,
       CASE doc_id % 5 WHEN 1 THEN 'doc_id_null' WHEN 2 THEN 'prompt_null' WHEN 3 THEN 'intent_unknown' ELSE '' END AS errors
FROM labels""")
def judge_prompts_file(spark, sf):
    """A judge prompt per labelled document, some without id or prompt or with an unknown intent."""
    lab, path = table(spark, sf, "labels"), scratch_path(spark, "prompts")
    kind = F.col("doc_id") % 5
    lab.select(F.when(kind != 1, F.col("doc_id").cast("string")).alias("doc_id"),
               F.when(kind != 2, F.concat(F.lit("Judge "), F.col("doc_id").cast("string"))).alias("prompt"),
               F.when(kind == 3, "letter").otherwise("rfp").alias("reference_intent")).write.json(path)
    valid, bad = files.load_judge_prompts(spark, path)
    return valid.withColumn("errors", F.lit("")).unionByName(bad.withColumn("errors", F.array_join("errors", ",")))


@register("chunks_file", "S6 S7 V1", f"""
WITH {CHUNKS_CTE}
SELECT chunk_id, doc_id::VARCHAR AS doc_id, chunk_index, text,
       CASE WHEN doc_id % 10 = 3 THEN 0 ELSE n_tokens END AS n_tokens,
       CASE WHEN doc_id % 10 = 3 THEN 'n_tokens_not_positive' ELSE '' END AS errors FROM chunks""")
def chunks_file(spark, sf):
    """All chunks dumped as JSON lines and read by their contract; a tenth holds no tokens."""
    path = scratch_path(spark, "chunks")
    chunks = chunking.chunk_documents(table(spark, sf, "documents").select("doc_id", "text"))
    chunks = chunks.withColumn("n_tokens", F.when(F.col("doc_id") % 10 == 3, F.lit(0)).otherwise(F.col("n_tokens")))
    files.dump_chunks(chunks.withColumn("doc_id", F.col("doc_id").cast("string")), path)
    valid, bad = files.load_chunks(spark, path)
    return valid.withColumn("errors", F.lit("")).unionByName(bad.withColumn("errors", F.array_join("errors", ",")))


# ---- models and jobs ---------------------------------------------------------------------------


@register("train_evaluate", "M1 M2 M3 M4 M5 M7 J11 S12 S13 S19 S20 E6 V9 V13", """
WITH l AS (SELECT doc_id, quality FROM labels JOIN documents USING (doc_id))
SELECT (SELECT count(*) FROM l)::BIGINT AS n, TRUE AS gate_is_f1, TRUE AS f1_per_class, 128::BIGINT AS stored_dim, TRUE AS reload_equal,
       (SELECT count(DISTINCT quality) FROM l)::VARCHAR AS logged_classes, (SELECT count(*) FROM l)::VARCHAR AS logged_documents,
       1::BIGINT AS runs, TRUE AS report_ok, TRUE AS summary_ok, TRUE AS unlabelled_refused, TRUE AS ragged_refused""")
def train_evaluate(spark, sf):
    """Train, save, log, load, evaluate on all labelled documents (class = quality): what the jobs
    leave behind agrees with itself, and bad training input is refused."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    labelled = saved(docs.join(lab, "doc_id"), "labelled")
    docs, lab = labelled.select("doc_id", "text"), labelled.select("doc_id", "label")
    path = scratch_path(spark, "head")
    ev = saved(jobs.train_evaluate_job(spark, docs, lab, lab, path, dim=128), "evaluation")
    model, dim = classify.load_head(spark, path)
    told = classify.bulk_classify(model, docs, dim)
    again = classify.bulk_classify(classify.load_head(spark, path)[0], docs, dim)
    equal = told.select("doc_id", F.struct("intent", "confidence").alias("a")).join(
        again.select("doc_id", F.struct("intent", "confidence").alias("b")), "doc_id").agg(F.every(F.col("a") == F.col("b"))).scalar()
    runs = spark.read.parquet(f"{path}/runs")
    log = runs.agg(F.count("*").alias("runs"), F.max(F.col("params")["n_classes"]).alias("logged_classes"),
                   F.max(F.col("params")["n_documents"]).alias("logged_documents"))
    report = spark.read.json(f"{path}/report")
    named = report.where(F.col("label").isin("accuracy", "macro avg", "weighted avg")).count() == 3
    summary = spark.read.json(f"{path}/summary").select((F.col("classifier.macro_f1") == ev.select("macro_f1").scalar())).first()[0]
    labels = [r[0] for r in lab.select("label").distinct().collect()]  # a row a class
    bad = classify.features(docs.limit(4), "text", 64).withColumn("label", F.lit(None).cast("string"))
    ragged = classify.features(docs.limit(4), "text", 64).unionByName(classify.features(docs.limit(4), "text", 32)).withColumn("label", F.lit("a"))
    own = F.map_from_entries(F.array_sort(F.map_entries("per_class_f1")))
    return ev.select(
        "n", (F.col("passed") == (F.col("macro_f1") >= 0.5)).alias("gate_is_f1"),
        (F.array_sort(F.map_keys(own)) == F.array_sort(F.array(*map(F.lit, labels)))).alias("f1_per_class"),
        F.lit(dim).cast("bigint").alias("stored_dim"), equal.alias("reload_equal"), F.lit(named).alias("report_ok"), F.lit(summary).alias("summary_ok"),
        F.lit(_refuses(classify.check_training_input, bad)).alias("unlabelled_refused"),
        F.lit(_refuses(classify.check_training_input, ragged)).alias("ragged_refused")).crossJoin(F.broadcast(log))  # one row each


# ---- embeddings and search ---------------------------------------------------------------------


@register("blake2b_properties", "E1 U1 E5 U8 V8", f"""
SELECT doc_id, 384::BIGINT AS dim, len({words("coalesce(text, '')")}) > 0 AS has_words, TRUE AS unit_or_zero, TRUE AS equal_texts_equal,
       TRUE AS provider_checked, TRUE AS dim_checked FROM documents""")
def blake2b_properties(spark, sf):
    """Every document's embedding: its length, one unit long or (only without words) zero, and the same for the same text wherever it stands."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vec = saved(docs.select("doc_id", F.sha2("text", 256).alias("_h"), (F.size(F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), 0)) > 0)
                            .alias("has_words"), embedding.embed_blake2b(F.col("text")).alias("v")), "blake2b")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    one = vec.groupBy("_h").agg(F.countDistinct("v").alias("_kinds"))
    return vec.join(one, "_h").select(
        "doc_id", F.size("v").cast("bigint").alias("dim"), "has_words",
        ((F.abs(norm - 1) < 1e-5) | ((norm == 0) & ~F.col("has_words"))).alias("unit_or_zero"),
        (F.col("_kinds") == 1).alias("equal_texts_equal"),
        F.lit(_refuses(embedding.check_provider, "other") and not _refuses(embedding.check_provider, "blake2b")).alias("provider_checked"),
        F.lit(_refuses(embedding.check_dim, 31) and not _refuses(embedding.check_dim, 32)).alias("dim_checked"))


@register("search_modes", "U3 R5 V8 R6", """
SELECT unnest(['keyword', 'vector', 'blended', 'hybrid']) AS mode, item_id AS query_id, 5::BIGINT AS n, TRUE AS ranks_in_order,
       TRUE AS same_as_operator, TRUE AS weight_checked, TRUE AS mode_checked FROM benchmark""")
def search_modes(spark, sf):
    """The one search interface in all its modes over a stored index: five passages a query, ranks
    by falling score, equal to the operator behind the mode."""
    path = scratch_path(spark, "search-index")
    files.write_index(retrieval.build_index(table(spark, sf, "documents").select("doc_id", "text")), path)
    index = spark.read.parquet(path)
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    qv = saved(embedding.embed_md5_vectors(queries, ["query_id", "text"]), "query-vectors")
    behind = {"keyword": lambda: retrieval.keyword_topk(queries, index, 5), "vector": lambda: retrieval.blended_topk(qv, index, 5, 1.0),
              "blended": lambda: retrieval.blended_topk(qv, index, 5), "hybrid": lambda: retrieval.hybrid_topk(qv, index, 5)}
    weights = all(_refuses(retrieval.check_vector_weight, w) for w in (-0.1, 1.1)) and not _refuses(retrieval.check_vector_weight, 1.0)
    unknown = _refuses(retrieval.search, queries, index, 5, uuid.uuid4().hex)
    out = None
    for mode, fn in behind.items():
        want = fn().select("query_id", "rank", F.struct("chunk_id", "score").alias("_w"))
        got = retrieval.search(queries, index, 5, mode)
        lower = F.lead("score").over(Window.partitionBy("query_id").orderBy("rank"))  # five rows a query
        got = got.withColumn("_next", lower).join(want, ["query_id", "rank"], "full")
        part = got.groupBy("query_id").agg(
            F.count("*").alias("n"), F.every(F.col("_next").isNull() | (F.col("_next") <= F.col("score"))).alias("ranks_in_order"),
            F.every(F.col("_w").eqNullSafe(F.struct("chunk_id", "score"))).alias("same_as_operator")).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("weight_checked", F.lit(weights)).withColumn("mode_checked", F.lit(unknown))


@register("document_contract", "V1 V9", """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'text_empty' WHEN coalesce(length(text), 0) = 0 THEN 'text_empty' ELSE '' END AS errors FROM documents""")
def document_contract(spark, sf):
    """Documents by their contract, a seventh with an empty text."""
    docs = table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("text")))
    valid, bad = contracts.split_valid(docs, contracts.document_rules())
    return valid.select("doc_id", F.lit("").alias("errors")).unionByName(bad.select("doc_id", F.array_join("errors", ",").alias("errors")))
