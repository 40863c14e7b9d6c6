import os
import tempfile

import pytest
from pyspark.sql import functions as F

from docflow.operators import ann, classify, retrieval
from docflow.plans import q_models
from docflow.sources import files
from docflow.streaming import streams as st
from tests.conftest import SF0001, SF001, rows

# A small separable corpus in the spirit of the reference's six-text classifier set.
CORPUS = [
    ("n1", "mutual nondisclosure agreement confidential information recipient discloser"),
    ("n2", "confidential information shall not be disclosed nondisclosure obligations"),
    ("n3", "nondisclosure confidential recipient obligations secrecy"),
    ("p1", "purchase order quantity unit price delivery invoice vendor"),
    ("p2", "purchase order shipping delivery quantity vendor invoice"),
    ("p3", "order delivery invoice quantity purchase vendor"),
    ("t1", "termination notice terminate agreement effective date notice period"),
    ("t2", "notice of termination terminate effective immediately"),
    ("t3", "terminate termination notice period effective"),
]
LABELS = {"n": "nda", "p": "purchase_order", "t": "termination"}


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id string, text string")
    labels = spark.createDataFrame([(d, LABELS[d[0]]) for d, _ in CORPUS], "doc_id string, label string")
    model, m, _ = classify.train_job(docs, labels, dim=64)
    return docs, labels, model, m


def test_classifier_contract(spark, trained):
    docs, labels, model, m = trained
    assert m.first().macro_f1 >= 0.5
    out = classify.bulk_classify(model, docs, 64).collect()
    assert {r.intent for r in out} <= set(LABELS.values())
    assert all(0.0 <= r.confidence <= 1.0 for r in out)
    assert all(r.route in ("fast", "escalate_to_reason") for r in out)
    ev = classify.evaluate_job(model, 64, docs, labels).first()
    assert ev.n == 9 and ev.macro_f1 >= 0.5


def test_save_load_same_predictions(spark, trained):
    docs, _, model, _ = trained
    path = tempfile.mkdtemp(prefix="docflow-model-")
    classify.save_head(model, path, 64)
    loaded, dim = classify.load_head(spark, path)
    assert dim == 64
    a = rows(classify.bulk_classify(model, docs, 64), "doc_id", "intent", "confidence")
    b = rows(classify.bulk_classify(loaded, docs, dim), "doc_id", "intent", "confidence")
    assert a == b


def test_missing_labels_fail_training(spark):
    docs = spark.createDataFrame([("a", "x y z"), ("b", "q r s")], "doc_id string, text string")
    labels = spark.createDataFrame([("a", "nda")], "doc_id string, label string")
    with pytest.raises(ValueError, match="b"):
        classify.train_job(docs, labels, dim=64)


@pytest.mark.parametrize("blocks", [1, 5])
def test_lsh_finds_the_registered_share_of_neighbours(spark, blocks):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    queries = emb.where("vec_id % 50 = 0")
    approx = ann.lsh_topk(queries, emb, "vec_id", "vec", dim=64, k=5, blocks=blocks)
    exact = retrieval.vector_topk(queries.withColumnRenamed("vec_id", "query_id"), emb, k=6, index_keys=("vec_id",), digits=6)
    exact = exact.where("vec_id <> query_id").where("rank <= 6")
    assert ann.recall_at_k(approx, exact, "vec_id").first().recall >= 0.8
    assert approx.count() == 5 * queries.count()


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_lsh_recall_is_nine_tenths_and_less_is_refused(spark, monkeypatch, sf):
    queries, approx, exact = q_models._neighbours(spark, sf)
    assert ann.recall_at_k(approx, exact, "vec_id").first().recall >= 0.9
    few = exact.where("rank < 5 OR query_id % 500 = 400")
    assert 0.8 <= ann.recall_at_k(few, exact, "vec_id").first().recall < 0.9
    monkeypatch.setattr(q_models, "_neighbours", lambda *a: (queries, few, exact))
    assert not any(r.recall_ok for r in q_models.lsh_recall(spark, sf).collect())


def test_lsh_keeps_every_copy_in_a_hot_bucket(spark):
    emb = spark.createDataFrame([(i, [1.0, 0.5, 0.25, 0.1]) for i in range(200)] + [(900, [-1.0, 0.0, 0.0, 0.0])],
                                "vec_id long, vec array<double>")
    got = ann.lsh_topk(emb.where("vec_id in (7, 900)"), emb, "vec_id", "vec", dim=4, k=150, tables=3, bits=3, probes=1).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 7] == [i for i in range(151) if i != 7]


def test_read_corpus_and_jsonl(spark):
    d = tempfile.mkdtemp(prefix="docflow-corpus-")
    for name, body in [("nda-01", "Title\n\nBody one"), ("po%2001", "Order\n\nBody two")]:
        with open(os.path.join(d, f"{name}.txt"), "w") as fh:
            fh.write(body)
    with open(os.path.join(d, "skip.md"), "w") as fh:
        fh.write("ignored")
    got = rows(files.read_corpus(spark, d), "doc_id", "text", "source")
    assert got == [("nda-01", "Title\n\nBody one", "local"), ("po%2001", "Order\n\nBody two", "local")]
    j = os.path.join(d, "gold.jsonl")
    with open(j, "w") as fh:
        fh.write('{"doc_id": "a", "intent": "nda"}\n\n{"doc_id": "a", "intent": "msa"}\n'
                 '{"doc_id": "b", "intent": "poem"}\n')
    valid, bad = files.load_intents(spark, j)
    assert valid.count() == 2 and rows(bad, "doc_id") == [("b",)]
    last, unknown = files.load_labels_last_wins(spark, j)
    assert rows(last) == [("a", "msa")] and rows(unknown, "doc_id") == [("b",)]


def test_corpus_names_keep_plus_signs_and_subfolders_are_left_out(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a+b.txt", "a b.txt", "é.txt", "sub/c.txt"):
        (tmp_path / name).write_text("x")
    docs = files.read_corpus(spark, str(tmp_path))
    assert [r.doc_id for r in files.ordered_corpus(docs).collect()] == ["a b", "a+b", "é"]


def test_the_last_line_wins_over_a_folder_of_files(spark, tmp_path):
    (tmp_path / "2.jsonl").write_text('{"doc_id": "a", "intent": "msa"}\n' * 3000 + '{"doc_id": "b", "intent": "rfp"}\n')
    (tmp_path / "1.jsonl").write_text('{"doc_id": "b", "intent": "nda"}\n{"doc_id": "a", "intent": "nda"}\n')
    os.utime(tmp_path / "2.jsonl", (1, 1))
    assert rows(files.load_labels_last_wins(spark, str(tmp_path))[0]) == [("a", "msa"), ("b", "rfp")]


def test_gold_fields_and_judge_prompts(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"doc_id": "a", "fields": {"x": "1", "y": "2"}}\n{"doc_id": "b", "fields": {}}\n')
    assert rows(files.load_gold_fields(spark, str(tmp_path / "g.jsonl")).fillna("-")) == [("a", "x", "1"), ("a", "y", "2"), ("b", "-", "-")]
    (tmp_path / "p.jsonl").write_text('{"doc_id": "a", "prompt": "p", "reference_intent": "nda"}\n{"doc_id": "b", "prompt": "p", "reference_intent": "poem"}\n')
    good, bad = files.load_judge_prompts(spark, str(tmp_path / "p.jsonl"))
    assert rows(good, "doc_id") == [("a",)] and rows(bad, "doc_id") == [("b",)]


def test_an_unreadable_baseline_stays(spark, tmp_path):
    path = str(tmp_path / "base")
    row = spark.createDataFrame([(1.5,)], "mean_score double")
    assert files.baseline_or_save(spark, path, row) is None
    assert files.baseline_or_save(spark, path, spark.createDataFrame([(9.0,)], "mean_score double")).first()[0] == 1.5
    part = next(f for f in os.listdir(path) if f.endswith(".json"))
    with open(f"{path}/{part}", "w") as fh:
        fh.write("{broken")
    os.unlink(f"{path}/.{part}.crc")
    with pytest.raises(Exception):
        files.baseline_or_save(spark, path, row).collect()
    assert open(f"{path}/{part}").read() == "{broken"


def test_index_versions_and_pointer(spark, tmp_path):
    base = str(tmp_path / "idx")
    new = spark.createDataFrame([("c", "x", 1)], "chunk_id string, text string, version int")
    assert files.current(spark, base) is None and files.next_version(spark, base) == 1
    assert files.create_index(spark, base, new.schema) == files.create_index(spark, base, new.schema) == f"{base}/v0"
    files.write_index(new, f"{base}/v1")
    assert files.current(spark, base).endswith("v0")     # not switched before the swap
    files.set_current(spark, base, f"{base}/v1")
    assert files.current(spark, base).endswith("v1") and files.next_version(spark, base) == 2
    assert rows(spark.read.parquet(files.current(spark, base))) == rows(new)


def test_upsert_last_version_wins(spark):
    old = spark.createDataFrame([("c1", "old", 1), ("c2", "keep", 1)], "chunk_id string, text string, version int")
    new = spark.createDataFrame([("c1", "new", 2)], "chunk_id string, text string, version int")
    assert rows(files.upsert(old, new)) == [("c1", "new", 2), ("c2", "keep", 1)]
    older = new.selectExpr("chunk_id", "text", "0 AS version")
    assert rows(files.upsert(old, older)) == rows(old)


@pytest.fixture()
def many_files(spark, tmp_path):
    """The events and documents as folders of part files, to be streamed one file a batch."""
    for t in ("events", "documents"):
        spark.read.parquet(f"{SF001}/{t}.parquet").repartition(4).write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_streaming_over_many_files_and_batches_matches_batch(spark, many_files, tmp_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    stream = st.file_stream(spark, many_files, "events", 1)
    got = st.run_updates(st.daily_counts(stream, delay="3650 days"), f"t-st3-{tmp_path.name}", f"{tmp_path}/st3", ["window", "event_type"])
    want = ev.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "event_type").count()
    assert rows(got.select(F.col("window.start").alias("d"), "event_type", "n")) == rows(want)
    twice = st.file_stream(spark, many_files, "events", 1).union(st.file_stream(spark, many_files, "events", 1))
    kept = st.run_append(st.dedupe(twice.select("event_id", "ts"), ["event_id"], "3650 days"), f"t-st6-{tmp_path.name}", f"{tmp_path}/st6")
    assert rows(kept, "event_id") == rows(ev, "event_id")


def test_a_restarted_stream_resumes_and_finds_new_files(spark, many_files, tmp_path):
    job, path = f"t-resume-{tmp_path.name}", f"{tmp_path}/out"
    run = lambda: st.run_append(st.file_stream(spark, many_files, "documents").select("doc_id"), job, path).count()
    n = run()
    assert n == run() == spark.read.parquet(f"{SF001}/documents.parquet").count()
    spark.read.parquet(f"{SF001}/documents.parquet").limit(3).write.mode("append").parquet(f"{many_files}/documents.parquet")
    assert run() == n + 3


def test_stream_index_equals_the_batch_index(spark, many_files, tmp_path):
    base, cols = f"{tmp_path}/index", ("chunk_id", "doc_id", "chunk_index", "text", "n_tokens", "norm")
    st.run_foreach_batch(st.file_stream(spark, many_files, "documents", 2), f"t-st2-{tmp_path.name}", st.index_upkeep_batch(base, 64))
    want = rows(retrieval.build_index(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text"), dim=64), *cols)
    assert rows(st.read_index(spark, base), *cols) == want
    st.compact_index(spark, base)
    assert rows(spark.read.parquet(files.current(spark, base)), *cols) == want


def test_late_rows_beyond_watermark_are_dropped(spark):
    import datetime as dt
    import time

    import pandas as pd

    d = tempfile.mkdtemp(prefix="docflow-stream-")
    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    # Late rows are filtered with the previous batch's watermark, so the late row comes
    # two batches after the row that moved the watermark to Jan 9.
    batches = [[(1, day(1, 1), "view"), (2, day(1, 2), "view")],   # window 2024-01-01
               [(3, day(10), "view")],                              # moves the watermark to Jan 9
               [(5, day(10, 1), "view")],
               [(4, day(1, 3), "view")]]                            # late: dropped
    for i, b in enumerate(batches):
        pd.DataFrame(b, columns=["event_id", "ts", "event_type"]).to_parquet(
            f"{d}/part-{i}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(f"{d}/part-{i}.parquet", (time.time() + i, time.time() + i))
    schema = spark.read.parquet(d).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)
    out = st.run_append(st.daily_counts(stream), f"t-late-{os.path.basename(d)}", f"{tempfile.mkdtemp()}/out")
    got = {r.window.start.day: r.n for r in out.collect()}
    assert got.get(1) == 2          # the late row of Jan 1 never reached the window
    assert 10 not in got            # still open under the watermark: withheld in append mode


def test_windowed_cost_rollup(spark):
    import datetime as dt

    from docflow.operators import lookups

    d = tempfile.mkdtemp(prefix="docflow-cost-")
    import pandas as pd

    pd.DataFrame([("gpt-4o", 1000, 0, dt.datetime(2024, 1, 1, 0, 10)),
                  ("gpt-4o", 0, 1000, dt.datetime(2024, 1, 1, 0, 50)),
                  ("mystery", 1000, 1000, dt.datetime(2024, 1, 1, 1, 5))],
                 columns=["model", "tokens_in", "tokens_out", "ts"]).to_parquet(
        f"{d}/calls.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    stream = spark.readStream.schema(spark.read.parquet(d).schema).parquet(d)
    agg = st.cost_rollup(stream, lookups.price_table(spark), ts="ts")
    got = {(r.window.start.hour, r.model): (r.n_calls, r.cost_usd)
           for r in st.run_updates(agg, f"t-cost-{os.path.basename(d)}", f"{tempfile.mkdtemp()}/out", ["window", "model"]).collect()}
    assert got[(0, "gpt-4o")] == (2, pytest.approx(0.02))
    assert got[(1, "mystery")] == (1, pytest.approx(0.02))     # unknown model -> default price


def test_only_labelled_documents_are_redacted_for_training(spark, monkeypatch):
    from docflow.plans import q_streams

    seen = []
    monkeypatch.setattr(q_streams.classify, "fit_head", lambda train, *a, **k: seen.append(train))
    q_streams._model(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("Join Inner")  # above the join
    assert plan[plan.index("Join Inner"):].count("regexp_replace") == 0
