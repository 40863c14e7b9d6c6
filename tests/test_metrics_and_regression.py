import pytest
from pyspark.sql import functions as F

from docflow import contracts
from docflow.operators import metrics
from docflow.operators import regression as rg
from tests.conftest import rows


def py_f1(truth, pred):
    labels = sorted(set(truth) | set(pred))
    f1s = {}
    for lab in labels:
        tp = sum(t == lab and p == lab for t, p in zip(truth, pred))
        s = sum(t == lab for t in truth)
        n = sum(p == lab for p in pred)
        f1s[lab] = 2 * tp / (s + n) if s + n else 0.0
    return f1s


PAIRS = [("nda", "nda"), ("nda", "msa"), ("msa", "msa"), ("rfp", "nda"), ("other", "other"),
         ("other", "other"), ("msa", "msa")]


def pairs_df(spark, p):
    return spark.createDataFrame(p, "truth string, pred string")


def test_accuracy_and_macro_f1(spark):
    m = metrics.classifier_metrics(pairs_df(spark, PAIRS)).first()
    f1 = py_f1([t for t, _ in PAIRS], [p for _, p in PAIRS])
    assert m.n == 7
    assert m.accuracy == pytest.approx(5 / 7)
    assert m.macro_f1 == pytest.approx(sum(f1.values()) / len(f1))
    assert m.passed == (m.macro_f1 >= 0.5)


def test_empty_input(spark):
    m = metrics.classifier_metrics(pairs_df(spark, [])).first()
    assert (m.n, m.accuracy, m.macro_f1, m.passed) == (0, 0.0, 0.0, False)


def test_per_class_over_closed_set(spark):
    classes = spark.createDataFrame([(i,) for i in contracts.INTENTS], "label string")
    got = dict(rows(metrics.per_class_f1(pairs_df(spark, PAIRS), classes)))
    f1 = py_f1([t for t, _ in PAIRS], [p for _, p in PAIRS])
    assert set(got) == set(contracts.INTENTS)
    assert got["termination"] == 0.0 and got["price_change"] == 0.0
    assert got["msa"] == pytest.approx(f1["msa"])


def test_report_rows(spark):
    rep = {r.label: r for r in metrics.classification_report(pairs_df(spark, PAIRS)).collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= set(rep)
    assert rep["accuracy"].support == 7
    assert rep["macro avg"].support == 7


def test_extraction_recall(spark):
    gold = spark.createDataFrame([("d1", "s1", "date"), ("d1", "s1", "party"), ("d1", "s2", "date"),
                                  ("d9", "s3", "amount")], "doc_id string, sample_id string, field string")
    pred = spark.createDataFrame([("d1", "date")], "doc_id string, field string")
    r = metrics.extraction_recall(gold, pred).first()
    assert (r.n_documents, r.n_fields_expected, r.n_fields_found) == (3, 4, 2)
    assert r.field_recall == 0.5
    none = metrics.extraction_recall(gold.limit(0), pred).first()
    assert none.field_recall == 1.0


def test_class_weights_and_missing_labels(spark):
    lab = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "doc_id string, label string")
    w = dict(rows(metrics.class_weights(lab, "label"), "doc_id", "weight"))
    assert w == {"a": pytest.approx(3 / 4), "b": pytest.approx(3 / 4), "c": pytest.approx(3 / 2)}
    docs = spark.createDataFrame([("a",), ("z",)], "doc_id string")
    assert rows(metrics.missing_labels(docs, lab)) == [("z",)]


def test_judge_aggregate_drops_invalid(spark):
    s = spark.createDataFrame([("d1", 5, 4, 4, 4, "ok"), ("d2", 5, 5, 5, 5, "ok"),
                               ("d3", 0, 5, 5, 5, "bad score"), ("d4", 5, 5, 5, 5, "x" * 401)],
                              contracts.JUDGE_SCORE)
    r = rg.judge_aggregate(s).first()
    assert (r.n_traces, r.n_invalid) == (2, 2)
    assert r.mean_score == pytest.approx((4.25 + 5.0) / 2)
    assert r.intent_correctness == 5.0


def test_regression_verdict_threshold_and_missing_baseline(spark):
    cur = spark.createDataFrame([(4.0,)], "mean_score double")
    assert not rg.regression_verdict(cur, F.lit(4.5)).first().regressed          # drop 0.5 == threshold
    assert rg.regression_verdict(cur, F.lit(4.51)).first().regressed
    r = rg.regression_verdict(cur, F.lit(None).cast("double")).first()
    assert r.delta is None and not r.regressed


def test_compare_to_baseline(spark):
    cur = spark.createDataFrame([("classifier.macro_f1", 0.80), ("judge.mean_score", 4.0),
                                 ("extra.metric", 1.0)], "key string, value double")
    base = spark.createDataFrame([("classifier.macro_f1", 0.90), ("judge.mean_score", 4.3)],
                                 "key string, value double")
    tol = spark.createDataFrame(list(rg.TOLERANCES), "key string, tolerance double")
    out = {r.key: r for r in rg.compare_to_baseline(cur, base, tol).collect()}
    assert set(out) == {"classifier.macro_f1", "judge.mean_score"}
    f = out["classifier.macro_f1"]
    assert f.regressed and f.section == "classifier" and f.name == "macro_f1"
    assert f.message == "classifier.macro_f1: 0.800 < 0.900 (drop 0.100 > 0.030)"
    # 4.3 - 4.0 in floating point is just under 0.3: not strictly greater than the tolerance
    assert not out["judge.mean_score"].regressed


def test_route_threshold_and_multiplex(spark):
    df = spark.createDataFrame([(0.75,), (0.7499,), (1.0,)], "c double")
    assert [r.r for r in df.select(rg.route("c").alias("r")).collect()] == ["fast", "escalate_to_reason", "fast"]
    rq = spark.createDataFrame([(1, "classify", 0.1), (2, "auto", 0.9), (3, "auto", 0.2),
                                (4, "reason", 0.99), (5, None, 0.8), (6, "bogus", 0.5)],
                               "id int, request_route string, c double")
    out = rg.multiplex(rq, lambda d: d.withColumn("confidence", F.col("c")).withColumn("intent", F.lit("i")),
                       lambda d: d)
    got = dict(rows(out, "id", "result"))
    assert got == {1: "classified", 2: "classified", 3: "reasoned", 4: "reasoned", 5: "classified", 6: "error"}


def test_decode_dims_plain_and_double_encoded(spark):
    import json
    inner = json.dumps({"doc_id": "d", "intent": "nda"})
    cases = [json.dumps({"response": inner}), json.dumps(json.dumps({"reasoning_response": inner})),
             json.dumps({"response": ""}), "{broken"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, d string")
    got = dict(rows(df.select("i", rg.decode_dims(F.col("d")).alias("r"))))
    assert json.loads(got[0]) == json.loads(inner)
    assert json.loads(got[1]) == json.loads(inner)
    assert got[2] is None and got[3] is None


def test_live_or_fallback(spark):
    live = spark.createDataFrame([("x",)], "doc_id string")
    fb = spark.createDataFrame([("fb",)], "doc_id string")
    assert rows(rg.live_or_fallback(live, fb)) == [("x",)]
    assert rows(rg.live_or_fallback(live.limit(0), fb)) == [("fb",)]
