import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.operators import embedding, retrieval


@pytest.fixture()
def index(spark):
    docs = spark.createDataFrame([("a", "alpha beta gamma delta epsilon"), ("b", "beta gamma zeta"),
                                  ("c", "nothing in common")], "doc_id string, text string")
    return retrieval.build_index(docs, 3, 1, dim=64)


@pytest.mark.parametrize("mode", ["keyword", "vector", "blended", "hybrid"])
def test_search_modes_share_one_output_shape(spark, index, mode):
    q = spark.createDataFrame([("q", "beta gamma")], "query_id string, text string")
    out = retrieval.search(q, index, k=2, mode=mode, dim=64)
    assert out.columns == ["query_id", "chunk_id", "doc_id", "chunk_index", "score", "rank"]
    r = out.orderBy("rank").collect()
    assert [x.rank for x in r] == [1, 2] and r[0].score >= r[1].score


def test_provider_is_explicit(spark):
    df = spark.createDataFrame([("Hello world tokens",)], "t string")
    a = df.select(embedding.dense_unit(F.col("t"), 64, "md5").alias("v")).first().v
    b = df.select(embedding.dense_unit(F.col("t"), 64, "blake2b").alias("v")).first().v
    assert np.linalg.norm(a) == pytest.approx(1.0, rel=1e-6) and np.linalg.norm(b) == pytest.approx(1.0, rel=1e-6)
    with pytest.raises(ValueError):
        embedding.dense_unit(F.col("t"), 64, "hosted")


def test_normalize_search_hits(spark):
    hits = spark.createDataFrame([("a", 2.5, 1.0, 7), ("b", None, 0.4, 0), ("c", None, None, None)],
                                 "chunk_id string, reranker_score double, search_score double, n_tokens bigint")
    got = {r.chunk_id: (r.score, r.n_tokens) for r in retrieval.normalize_search_hits(hits).collect()}
    assert got == {"a": (2.5, 7), "b": (0.4, 1), "c": (0.0, 1)}


def test_telemetry_percentiles(spark):
    from docflow.operators import regression as rg

    df = spark.createDataFrame([("m", "h", float(v)) for v in range(1, 101)], "model string, prompt_hash string, value double")
    top = rg.telemetry_rollup(df, ["model", "prompt_hash"], "value", percentiles=True).where("level = 3").first()
    assert top.n == 100 and top.p50_value == 50.0 and top.p95_value == 95.0
