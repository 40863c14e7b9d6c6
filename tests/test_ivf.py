import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.operators import ann, ivf, retrieval
from docflow.session import scratch_path


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")


def _exact(q, df, k):
    out = retrieval.vector_topk(q.withColumnRenamed("id", "query_id"), df, k=k + 1, index_keys=("id",), vec_col="v", digits=6)
    return retrieval.topk_per_group(out.where("query_id <> id").drop("rank"), ["query_id"], [F.col("score").desc(), F.col("id")], k)


def test_recall_of_clustered_vectors_with_few_cells_probed(spark):
    r = np.random.default_rng(1)
    x = _unit(np.repeat(r.standard_normal((30, 16)), 50, 0) + r.standard_normal((1500, 16)) * .15)
    x = np.concatenate([x, np.repeat(x[:1], 500, 0)])  # a quarter of all rows are one vector
    df, base = _frame(spark, x), scratch_path(spark, "ivf-test")
    ivf.build(df, base, "id", "v", dim=16, subspaces=8, sample_rows=800)
    q = df.where("id % 50 = 7 AND id < 1500")
    got = ivf.search(q, base, "id", "v", k=5, share=0.3, depth=60)
    assert got.groupBy("query_id").count().where("count <> 5").isEmpty()
    assert got.agg(F.max("probed")).first()[0] < 0.7 and got.agg(F.max("compared")).first()[0] <= 60
    assert ann.recall_at_k(got, _exact(q, df, 5), "id").first()[0] >= 0.9
    few = ivf.search(q, base, "id", "v", k=5, share=0.3, depth=60, max_query_bytes=20_000)  # several slices
    key = lambda d: sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in d.collect())
    assert key(few) == key(got)


def test_all_cells_and_a_deep_list_are_exact_and_added_rows_are_found(spark):
    r = np.random.default_rng(2)
    x = _unit(r.standard_normal((300, 8)))
    df, base = _frame(spark, x[:200]), scratch_path(spark, "ivf-test")
    ivf.build(df, base, "id", "v", dim=8, subspaces=4)
    more = _frame(spark, x[200:], 200)
    ivf.add(more, base, "id", "v")
    both, q = df.unionByName(more), more.where("id % 10 = 0")
    got = ivf.search(q, base, "id", "v", k=4, share=1.0, depth=300)
    key = lambda d: sorted((r["query_id"], r["id"], r["rank"]) for r in d.collect())
    assert key(got) == key(_exact(q, both, 4))
    assert {r["probed"] for r in got.collect()} == {1.0}


def test_unprobed_cells_are_not_read(spark):
    rows = ivf._schema("bigint")
    assert rows.endswith("cell int")
    r = np.random.default_rng(3)
    df, base = _frame(spark, _unit(r.standard_normal((200, 8)))), scratch_path(spark, "ivf-test")
    ivf.build(df, base, "id", "v", dim=8, subspaces=4, cells=10)
    model = ivf._model(spark, base)
    sizes = {x["cell"]: x["n"] for x in spark.read.parquet(f"{base}/sizes").collect()}
    assert sum(sizes.values()) == 200
    probe = ivf.probes(model, sizes, _unit(r.standard_normal((3, 8))), 0.2)
    held = probe @ np.array([sizes.get(c, 0) for c in range(10)])
    assert (held >= 40).all() and (probe.sum(1) < 10).all()


def test_small_inputs(spark):
    none, base = _frame(spark, np.zeros((0, 8))), scratch_path(spark, "ivf-test")
    ivf.build(none, base, "id", "v", dim=8, subspaces=4)
    q = _frame(spark, _unit(np.ones((2, 8))))
    assert ivf.search(q, base, "id", "v").count() == 0
    ivf.add(q, base, "id", "v")
    assert {(r["query_id"], r["id"]) for r in ivf.search(q, base, "id", "v").collect()} == {(0, 1), (1, 0)}
    assert ivf.search(none, base, "id", "v").count() == 0
    with pytest.raises(ValueError):
        ivf.build(q, base, "id", "v", dim=8, subspaces=3)
