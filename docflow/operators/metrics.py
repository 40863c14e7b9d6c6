"""Evaluation metrics (A1-A6, A12, A13, V6, V13, JN1-JN3).

Every metric first reduces predictions to a confusion table ``(truth, pred, n)`` with a
partial (map-side) aggregation, so the shuffle carries at most one row per label pair per
partition; all per-class arithmetic then runs on that tiny table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MACRO_F1_FLOOR = 0.5
DIGITS = 9


def confusion(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """A5: truth, pred, n BIGINT."""
    return pairs.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")) \
                .agg(F.count(F.lit(1)).alias("n"))


def per_label_counts(conf: DataFrame) -> DataFrame:
    """label, tp, support, predicted - over labels seen in truth or prediction."""
    sides = conf.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("p"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("x"))
    return sides.groupBy(F.col("x.label").alias("label")).agg(
        F.sum("x.tp").cast("bigint").alias("tp"),
        F.sum("x.s").cast("bigint").alias("support"),
        F.sum("x.p").cast("bigint").alias("predicted"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class_scores(counts: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support (zero division -> 0)."""
    return counts.select(
        "label",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support")


def classifier_metrics(pairs: DataFrame, truth: str = "truth", pred: str = "pred",
                       floor: float = MACRO_F1_FLOOR) -> DataFrame:
    """A1+A2+V13: one row: n BIGINT, accuracy, macro_f1 (labels seen in truth or
    prediction), passed (macro_f1 >= floor). Empty input: n=0, accuracy 0, macro_f1 0."""
    conf = confusion(pairs, truth, pred)
    acc = conf.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
                   F.coalesce(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n"))),
                              F.lit(0)).alias("_hit"))
    macro = per_class_scores(per_label_counts(conf)).agg(F.round(F.avg("f1"), DIGITS)).scalar()
    out = acc.select("n", "_hit", F.coalesce(macro, F.lit(0.0)).alias("macro_f1"))
    return out.select("n", _ratio(F.col("_hit"), F.col("n")).alias("accuracy"), "macro_f1",
                      (F.col("macro_f1") >= floor).alias("passed"))


def per_class_f1(pairs: DataFrame, classes: DataFrame, truth: str = "truth",
                 pred: str = "pred") -> DataFrame:
    """A3: F1 for every class of the closed set ``classes(label)``; absent -> 0.0."""
    scores = per_class_scores(per_label_counts(confusion(pairs, truth, pred)))
    return classes.join(scores.select("label", "f1"), "label", "left") \
                  .select("label", F.coalesce("f1", F.lit(0.0)).alias("f1"))


def classification_report(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """A4: per-class rows plus 'accuracy', 'macro avg' and 'weighted avg' rows
    (label, precision, recall, f1, support)."""
    conf = confusion(pairs, truth, pred)
    pc = per_class_scores(per_label_counts(conf))
    r = lambda c: F.round(c, DIGITS)
    tot = F.sum("support")
    macro = pc.agg(F.lit("macro avg").alias("label"), r(F.avg("precision")).alias("precision"),
                   r(F.avg("recall")).alias("recall"), r(F.avg("f1")).alias("f1"),
                   tot.cast("bigint").alias("support"))
    wavg = lambda c: r(F.sum(F.col(c) * F.col("support")) / tot)
    weighted = pc.agg(F.lit("weighted avg").alias("label"), wavg("precision").alias("precision"),
                      wavg("recall").alias("recall"), wavg("f1").alias("f1"),
                      tot.cast("bigint").alias("support"))
    accuracy = conf.agg(
        F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        _ratio(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n"))), F.sum("n")).alias("f1"),
        F.sum("n").cast("bigint").alias("support"))
    return pc.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def extraction_recall(gold_keys: DataFrame, pred_keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Micro key recall; values ignored.

    gold_keys: one row per gold sample (key, sample_id, field) - duplicates of a sample
    are kept; pred_keys: (key, field), distinct. Output one row: field_recall (1.0 when
    nothing is expected), n_documents, n_fields_expected, n_fields_found.
    """
    p = pred_keys.select(key, "field").distinct().withColumn("_hit", F.lit(1))
    j = gold_keys.join(p, [key, "field"], "left")
    agg = j.agg(F.count_distinct("sample_id").alias("n_documents"),
                F.count("field").alias("n_fields_expected"),
                F.count("_hit").alias("n_fields_found"))
    return agg.select(
        F.when(F.col("n_fields_expected") > 0,
               F.col("n_fields_found") / F.col("n_fields_expected")).otherwise(F.lit(1.0))
        .alias("field_recall"),
        F.col("n_documents").cast("bigint"), F.col("n_fields_expected").cast("bigint"),
        F.col("n_fields_found").cast("bigint"))


def missing_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """V6/U-2: documents without a label (the training job fails when non-empty)."""
    return docs.select(key).join(labels.select(key), key, "left_anti")


def class_weights(labels: DataFrame, label_col: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per row. Class counts are a tiny table
    (one row per class) joined back to the rows - Spark sees its size; no global window."""
    counts = labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    n = counts.agg(F.sum("_nc")).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar()
    w = counts.select(label_col, (n / (k * F.col("_nc"))).alias("weight"))
    return labels.join(w, label_col)
