"""train -> classify and route -> prepare prompts -> recorded answers -> resolve."""

from pyspark.sql import functions as F

from docflow.operators import classify, lookups, prompts, retrieval, transcripts
from tests.test_classifier_sources_streams import CORPUS, LABELS


def test_end_to_end(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id string, text string")
    labels = spark.createDataFrame([(d, LABELS[d[0]]) for d, _ in CORPUS], "doc_id string, label string")
    model, m, _ = classify.train_job(docs, labels, dim=64)
    routed = classify.bulk_classify(model, docs, 64, threshold=0.99)
    assert routed.count() == 9 and {r.route for r in routed.collect()} <= {"fast", "escalate_to_reason"}

    # reason over every document (route 'reason'), retrieving from the chunked corpus
    chunks = retrieval.build_index(docs, 4, 1)
    req = routed.join(docs, "doc_id").select("doc_id", "text", F.col("intent").alias("hinted_intent"))
    prompt = prompts.prepare(req, chunks, k=3)
    assert prompt.count() == 9 and all("Retrieved passages:" in r.prompt for r in prompt.collect())

    # the recorded LLM answer cites the best passage with a quote taken from it
    q = req.select(F.col("doc_id").alias("query_id"), "text")
    top = retrieval.keyword_topk(q, chunks, 3).join(chunks.select("chunk_id", "text"), "chunk_id")
    best = top.where("rank = 1")
    answer = F.to_json(F.struct(
        F.col("query_id").alias("doc_id"), F.lit("nda").alias("intent"), F.lit(0.8).alias("confidence"),
        F.lit("Grounded in the best retrieved passage.").alias("reasoning"),
        F.array(F.struct(F.col("chunk_id"), F.substring("text", 1, 12).alias("quote"))).alias("citations")))
    completions = best.select(
        F.col("query_id").alias("request_id"), F.lit(0).alias("turn"), answer.alias("content"),
        F.array().cast("array<struct<id:string,name:string,arguments:string>>").alias("tool_calls"),
        F.lit(120).alias("tokens_in"), F.lit(40).alias("tokens_out"), F.lit("gpt-4o-mini").alias("model"),
        F.lit("stop").alias("finish_reason"))
    passages = top.select(F.col("query_id").alias("request_id"), "chunk_id", "text")
    out = transcripts.resolve(transcripts.fold_transcripts(completions), passages,
                              lookups.price_table(spark)).collect()
    assert len(out) == 9
    assert {r.status for r in out} == {"ok"}
    assert all(r.turns == 1 and r.model_version == "gpt-4o-mini" and r.cost_usd > 0 for r in out)
