"""Registered queries: evaluation metrics and label joins (A1-A6, A12, A13, V6, V13, JN1-JN3).

Truth = ``labels.quality``; prediction = a fixed rule on the document (n_chars >= 1000).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import metrics
from docflow.plans.registry import register
from docflow.session import table

PRED_RULE_CHARS = 1000

_PAIRS_SQL = f"""
j AS (SELECT l.quality::VARCHAR AS truth,
             CASE WHEN d.n_chars >= {PRED_RULE_CHARS} THEN '1' ELSE '0' END AS pred
      FROM labels l JOIN documents d USING (doc_id)),
cls AS (SELECT truth AS label FROM j UNION SELECT pred FROM j),
pc AS (SELECT label, count_if(truth = label AND pred = label) AS tp,
              count_if(truth = label) AS support, count_if(pred = label) AS predicted
       FROM cls, j GROUP BY label),
sc AS (SELECT label,
              CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
              CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1,
              support::BIGINT AS support FROM pc)"""


def _pairs(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")  # JN2: unmatched samples dropped, duplicates kept
    return j.select(F.col("quality").cast("string").alias("truth"),
                    F.when(F.col("n_chars") >= PRED_RULE_CHARS, "1").otherwise("0").alias("pred"))


@register("metrics_binary", "A1 A2 V13 JN2", f"""
WITH {_PAIRS_SQL}
SELECT (SELECT count(*) FROM j)::BIGINT AS n,
       (SELECT CASE WHEN count(*) > 0 THEN count_if(truth = pred) / count(*) ELSE 0.0 END FROM j) AS accuracy,
       coalesce(round((SELECT avg(f1) FROM sc), 9), 0.0) AS macro_f1,
       coalesce(round((SELECT avg(f1) FROM sc), 9), 0.0) >= 0.5 AS passed""")
def metrics_binary(spark, sf):
    return metrics.classifier_metrics(_pairs(spark, sf))


@register("confusion_counts", "A5", """
SELECT l.quality::VARCHAR AS truth, CASE WHEN d.n_chars >= 1000 THEN '1' ELSE '0' END AS pred,
       count(*)::BIGINT AS n
FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL""")
def confusion_counts(spark, sf):
    return metrics.confusion(_pairs(spark, sf))


@register("classification_report", "A4 S20", f"""
WITH {_PAIRS_SQL}
SELECT label, precision, recall, f1, support FROM sc
UNION ALL SELECT 'accuracy', NULL, NULL,
       CASE WHEN count(*) > 0 THEN count_if(truth = pred) / count(*) ELSE 0.0 END, count(*)::BIGINT FROM j
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
       sum(support)::BIGINT FROM sc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
       round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
       sum(support)::BIGINT FROM sc""")
def classification_report(spark, sf):
    return metrics.classification_report(_pairs(spark, sf))


@register("per_class_f1", "A3", f"""
WITH {_PAIRS_SQL},
classes AS (SELECT * FROM (VALUES ('0'), ('1'), ('2')) t(label))
SELECT classes.label, coalesce(sc.f1, 0.0) AS f1 FROM classes LEFT JOIN sc USING (label)""")
def per_class_f1(spark, sf):
    """Closed class set {0, 1, 2}: class '2' never occurs and gets 0.0."""
    classes = spark.createDataFrame([("0",), ("1",), ("2",)], "label string")
    return metrics.per_class_f1(_pairs(spark, sf), classes)


@register("missing_labels", "V6 U-2", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def missing_labels(spark, sf):
    return metrics.missing_labels(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("labelled_corpus", "JN1 A12", """
SELECT d.doc_id, l.quality, l.toxic, d.n_chars, d.lang FROM documents d JOIN labels l USING (doc_id)""")
def labelled_corpus(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return d.join(table(spark, sf, "labels"), "doc_id") \
            .select("doc_id", "quality", "toxic", "n_chars", "lang")


@register("label_stats", "A12 U-3", """
SELECT count(*)::BIGINT AS n_labelled, count(DISTINCT doc_id)::BIGINT AS n_documents,
       count(DISTINCT quality)::BIGINT AS n_classes FROM labels""")
def label_stats(spark, sf):
    lab = table(spark, sf, "labels")
    return lab.agg(F.count(F.lit(1)).alias("n_labelled"),
                   F.countDistinct("doc_id").alias("n_documents"),
                   F.countDistinct("quality").alias("n_classes"))


@register("class_weights", "A13", """
WITH c AS (SELECT quality, count(*) AS nc FROM labels GROUP BY quality)
SELECT l.quality, l.doc_id, l.toxic,
       (SELECT sum(nc) FROM c) / ((SELECT count(*) FROM c) * c.nc) AS weight
FROM labels l JOIN c USING (quality)""")
def class_weights(spark, sf):
    return metrics.class_weights(table(spark, sf, "labels"), "quality") \
                  .select("quality", "doc_id", "toxic", "weight")


@register("extraction_recall", "A6 JN3", """
WITH gold AS (SELECT DISTINCT user_id, event_type AS field FROM events WHERE ts < TIMESTAMP '2024-01-16'),
pred AS (SELECT DISTINCT user_id, event_type AS field FROM events WHERE ts >= TIMESTAMP '2024-01-16'),
j AS (SELECT g.user_id, g.field, p.field AS hit FROM gold g
      LEFT JOIN pred p ON p.user_id = g.user_id AND p.field = g.field)
SELECT CASE WHEN count(field) > 0 THEN count(hit) / count(field) ELSE 1.0 END AS field_recall,
       count(DISTINCT user_id)::BIGINT AS n_documents, count(field)::BIGINT AS n_fields_expected,
       count(hit)::BIGINT AS n_fields_found FROM j""")
def extraction_recall(spark, sf):
    """Gold keys: the event types a user had before the cut-off; predicted keys: the
    event types after it. One gold sample per user."""
    ev = table(spark, sf, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    gold = ev.where(F.col("ts") < cut).select(
        F.col("user_id").alias("doc_id"), F.col("user_id").alias("sample_id"),
        F.col("event_type").alias("field")).distinct()
    pred = ev.where(F.col("ts") >= cut).select(F.col("user_id").alias("doc_id"),
                                              F.col("event_type").alias("field"))
    return metrics.extraction_recall(gold, pred)
