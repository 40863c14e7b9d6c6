"""Registered queries: classifier and approximate neighbours.

Not SQL-expressible (model fitting, random projections): rows-only checks here, and
unit tests assert the contracts (labels from the class set, confidence in [0, 1],
reload equality, F1 floor on a separable corpus, LSH recall against the exact kernel).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from docflow.functions.vectors import dot
from docflow.operators import ann, boosting, classify, embedding, ivf, metrics, retrieval
from docflow.plans.registry import register
from docflow.session import saved, scratch_path, table

#: Share of the true neighbours that the index must find.
RECALL = 0.9


@register("train_eval_embeddings", "M1 M2 J11 V9 A13")
def train_eval_embeddings(spark, sf):
    emb = table(spark, sf, "embeddings")
    train = emb.select("vec_id", F.col("label").cast("string").alias("label"),
                       array_to_vector("embedding").alias("features"))
    model = classify.fit_head(train, "label", "lr", max_iter=50)
    return classify.predict(model, train).select("vec_id", "label", "intent", "confidence")


@register("classify_documents", "M3 M4 M6 M7 V12 E2 E6")
def classify_documents(spark, sf):
    """Train on the labelled documents (class = quality) and route every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    labelled = docs.join(lab.select("doc_id"), "doc_id", "left_semi")
    model, _m, _r = classify.train_job(labelled, lab, dim=classify.DEFAULT_DIM)
    return classify.bulk_classify(model, docs, classify.DEFAULT_DIM)


def _exact_neighbours(spark, sf):
    """The stated query set (ids divisible by 100), all vectors, and the exact five neighbours."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    queries = emb.where(F.col("vec_id") % 100 == 0)
    exact = retrieval.vector_topk(queries.withColumnRenamed("vec_id", "query_id"), emb, k=6, index_keys=("vec_id",), digits=6)
    exact = retrieval.topk_per_group(exact.where("query_id <> vec_id").drop("rank"), ["query_id"],
                                     [F.col("score").desc(), F.col("vec_id")], 5)
    return queries, emb, exact


def _neighbours(spark, sf):
    """Approximate and exact neighbours (without itself) of the stated query set (ids
    divisible by 100) among all vectors."""
    queries, emb, exact = _exact_neighbours(spark, sf)
    return queries, saved(ann.lsh_topk(queries, emb, "vec_id", "vec", dim=64, k=5), "lsh"), exact


@register("lsh_topk", "R8")
def lsh_topk(spark, sf):
    return _neighbours(spark, sf)[1]


@register("lsh_recall", "R8", """
SELECT vec_id AS query_id, 5::BIGINT AS n, TRUE AS scores_exact, TRUE AS recall_ok
FROM embeddings WHERE vec_id % 100 = 0""")
def lsh_recall(spark, sf):
    """Per query: k rows, every score the true one, and over all queries recall@5 >= ``RECALL``."""
    queries, approx, exact = _neighbours(spark, sf)
    recall = ann.recall_at_k(approx, exact, "vec_id").select("recall").scalar()
    true = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("_q")).join(approx, "query_id").join(
        table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("_v")), "vec_id")
    same = F.abs(dot("_q", "_v") - F.col("score")) < 1e-5
    return true.groupBy("query_id").agg(F.count("*").alias("n"), F.every(same).alias("scores_exact")).withColumn(
        "recall_ok", recall >= RECALL)


def _stored(spark, sf):
    queries, emb, exact = _exact_neighbours(spark, sf)
    base = scratch_path(spark, "ivf")
    ivf.build(emb, base, "vec_id", "vec", dim=64)
    return queries, emb, exact, saved(ivf.search(queries, base, "vec_id", "vec", k=5), "ivf")


@register("ann_topk", "R8 S8")
def ann_topk(spark, sf):
    """The stored approximate index, searched for the stated query set."""
    return _stored(spark, sf)[3].drop("probed")


@register("ann_recall", "R8 S8", """
SELECT vec_id AS query_id, 5::BIGINT AS n, TRUE AS scores_exact, TRUE AS recall_ok, TRUE AS few_compared, TRUE AS few_bytes
FROM embeddings WHERE vec_id % 100 = 0""")
def ann_recall(spark, sf):
    """Per query: k rows with their true scores; recall@5 over all queries of ``RECALL`` or more;
    fewer than a fifth of all rows compared exactly; codes and vectors read together fewer than a
    fifth of the vectors' bytes."""
    queries, emb, exact, approx = _stored(spark, sf)
    recall = ann.recall_at_k(approx, exact, "vec_id").select("recall").scalar()
    total = emb.agg(F.count("*")).scalar()
    true = queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("_q")).join(approx, "query_id").join(
        emb.select("vec_id", F.col("vec").alias("_v")), "vec_id")
    same = F.abs(dot("_q", "_v") - F.col("score")) < 1e-5
    out = true.groupBy("query_id").agg(F.count("*").alias("n"), F.every(same).alias("scores_exact"),
                                       F.max("compared").alias("compared"), F.max("probed").alias("probed"))
    size = 64 * 4  # bytes of a vector; a code has ivf.SUBSPACES
    return out.select("query_id", "n", "scores_exact", (recall >= RECALL).alias("recall_ok"),
                      (5 * F.col("compared") < total).alias("few_compared"),
                      (5 * (F.col("probed") * ivf.SUBSPACES + F.col("compared") / total * size) < size).alias("few_bytes"))


@register("boosted_head", "M1 M2 J11 S12 E6 V9", """
SELECT doc_id, TRUE AS known_class, TRUE AS confidence_ok, TRUE AS same_after_reload, TRUE AS not_below_linear
FROM documents JOIN labels USING (doc_id) WHERE doc_id % 4 = 2""")
def boosted_head(spark, sf):
    """Boosted trees over hashed embeddings (class = language and quality), trained on three quarters of
    all labelled documents: what they say of the others, the same from the stored model, and a
    macro F1 there that is not below the linear head's."""
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    docs = table(spark, sf, "documents").join(lab, "doc_id").select(
        "doc_id", F.concat_ws("/", "lang", F.col("quality").cast("string")).alias("label"),
        embedding.dense_unit(F.coalesce("text", F.lit("")), 64).alias("features"))
    docs = saved(docs, "boosted")
    held = F.col("doc_id") % 4 == 2
    model = boosting.fit(docs.where(~held), trees=8, rate=0.3, leaves=8)
    path = scratch_path(spark, "boosted-head")
    boosting.save(model, spark, path, 64)
    again, dim = boosting.load(spark, path)
    test = docs.where(held)
    out = saved(boosting.predict(model, test), "boosted-out")
    same = boosting.predict(again, test.withColumn("features", F.slice("features", 1, dim))).select(
        "doc_id", F.struct("intent", "confidence").alias("_again"))
    as_vector = lambda df: df.withColumn("features", array_to_vector(F.col("features").cast("array<double>")))
    linear = classify.predict(classify.fit_head(as_vector(docs.where(~held))), as_vector(test))
    f1 = lambda df: metrics.classifier_metrics(df.select(
        F.col("label").alias("truth"), F.col("intent").alias("pred"))).select("macro_f1").scalar()
    return out.join(same, "doc_id").select(
        "doc_id", F.col("intent").isin(model.classes).alias("known_class"),
        F.col("confidence").between(1 / len(model.classes), 1).alias("confidence_ok"),
        (F.struct("intent", "confidence") == F.col("_again")).alias("same_after_reload"), (f1(out) >= f1(linear)).alias("not_below_linear"))
