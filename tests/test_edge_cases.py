"""Edge cases listed in FIXTURES.md that the other files do not already cover."""

from pyspark.sql import functions as F

from docflow.functions.text import keyword_set, word_tokens
from docflow.operators import chunking, embedding, metrics
from tests.conftest import rows


def test_text_without_ascii_token(spark):
    df = spark.createDataFrame([("u", "éàü ßø 漢字 ёж"), ("s", " ")], "doc_id string, text string")
    v = {r.doc_id: r for r in embedding.embed_md5_vectors(df, ["doc_id"], dim=32).collect()}
    assert v["u"].idx == [] and v["u"].norm == 0.0          # no [A-Za-z] token: zero vector
    t = {r.doc_id: (r.w, r.k) for r in df.select("doc_id", word_tokens("text").alias("w"),
                                                  keyword_set("text").alias("k")).collect()}
    assert t["u"][0] == []                                  # no embedding word
    assert sorted(t["u"][1]) == ["éàü"]                     # keyword tokens: any > 2 chars
    assert t["s"] == ([], [])
    # a single space is still a (two-empty-token) chunk, per the space tokeniser
    assert rows(chunking.chunk_documents(df.where("doc_id = 's'"), 4, 1), "n_tokens") == [(2,)]


def test_duplicate_label_rows_are_kept_in_joins_and_metrics(spark):
    docs = spark.createDataFrame([("a", 100), ("b", 5000)], "doc_id string, n_chars int")
    labels = spark.createDataFrame([("a", "0"), ("a", "0"), ("b", "1"), ("z", "1")],
                                   "doc_id string, truth string")
    pairs = labels.join(docs, "doc_id").select(
        "truth", F.when(F.col("n_chars") >= 1000, "1").otherwise("0").alias("pred"))
    m = metrics.classifier_metrics(pairs).first()
    assert m.n == 3 and m.accuracy == 1.0                   # 'z' has no document: dropped
    assert rows(metrics.missing_labels(docs, labels)) == []


def test_prompt_hint_and_truncation(spark):
    from docflow.operators import prompts

    req = spark.createDataFrame([("d1", "short text", "nda"), ("d2", "x" * 8001, None)],
                                "doc_id string, text string, hinted_intent string")
    passages = spark.createDataFrame([("d1", 2, "c2", 0.5, "second"), ("d1", 1, "c1", 0.0625, "first")],
                                     "doc_id string, rank int, chunk_id string, score double, text string")
    out = {r.doc_id: r.prompt for r in prompts.render_reason_user(req, passages).collect()}
    p1, p2 = out["d1"], out["d2"]
    assert p1.startswith("Document id: d1\nFast-classifier hint: nda\nDocument text:\n---\nshort text\n---\n")
    # passages in rank order, three decimals, closing line without a trailing newline
    assert "[c1] score=0.063\nfirst\n\n[c2] score=0.500\nsecond\n\n" in p1
    assert p1.endswith("Use the retrieved passages for citations.")
    assert "Fast-classifier hint" not in p2
    assert "x" * 8000 + "\n[…truncated…]\n---" in p2 and "x" * 8001 not in p2


def test_chunk_jsonl_round_trip_with_quarantine_and_summary(spark):
    import json
    import os
    import tempfile

    from docflow.sources import files

    d = tempfile.mkdtemp(prefix="docflow-s7-")
    good = chunking.chunk_documents(spark.createDataFrame([("a", "one two three")], "doc_id string, text string"), 2, 1)
    files.dump_chunks(good, f"{d}/chunks")
    with open(f"{d}/chunks/part-bad.json", "w") as fh:
        fh.write(json.dumps({"chunk_id": "x_chunk_0000", "doc_id": "x", "chunk_index": -1,
                             "text": "", "n_tokens": 0}) + "\n\n")
    valid, bad = files.load_chunks(spark, f"{d}/chunks")
    assert rows(valid) == rows(good)
    assert [r.errors for r in bad.collect()] == [["chunk_index_negative", "text_empty", "n_tokens_not_positive"]]
    summary = files.write_summary(f"{d}/summary", metrics.classifier_metrics(
        spark.createDataFrame([("a", "a")], "truth string, pred string")))
    got = json.loads(open([os.path.join(f"{d}/summary", f) for f in os.listdir(f"{d}/summary")
                           if f.endswith(".json")][0]).read())
    assert got["classifier"]["n"] == 1
    assert got.get("judge") is None          # a skipped section stays empty
    assert summary.first().classifier.accuracy == 1.0
