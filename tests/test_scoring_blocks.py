"""The block kernel of retrieval over odd texts, and how little it does per index row."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.functions.text import keyword_set, may_meet_shorter
from docflow.operators import embedding, retrieval

TEXTS = ["Alpha\x1cBETA gamma\x85delta", "İa İbİ xİy alpha", "ΟΔΟΣ ΣΑΣ \U00010D50bc Ꟛbc",
         "", None, " \t\n", "al pha be ta", "i̇a i̇b alpha beta", "alpha alpha ALPHA beta", "ẞẞẞ İ ẞaİẞ"]


def _index(spark):
    rows = [(f"c{i}", i // 2, i % 2, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id int, chunk_index bigint, text string")


def _want(queries, index, k):
    """Every query's chunks by the overlap of their ``keyword_set``, from the definition."""
    asked = {r.query_id: set(r.t or ()) for r in queries.select("query_id", keyword_set("text").alias("t")).collect()}
    held = {(r.doc_id, r.chunk_index): set(r.t or ()) for r in index.select("doc_id", "chunk_index", keyword_set("text").alias("t")).collect()}
    return {q: sorted((-(len(t & c) / len(t) if t else 0.0), *at) for at, c in held.items())[:k] for q, t in asked.items()}


@pytest.mark.parametrize("dotted", [False, True])
@pytest.mark.parametrize("max_bytes", [200, 64 << 20])
def test_keyword_overlap_is_that_of_the_keyword_sets(spark, dotted, max_bytes):
    index = _index(spark)
    asked = ["alpha beta gamma delta", "οδος σας", "\U00010D70bc ꟛbc nothing", "", None, "xİy i̇bi̇ beta"]
    asked += ["i̇a alpha", "i̇b beta"] if dotted else []
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    words = [t for r in queries.select(keyword_set("text").alias("t")).collect() for t in r.t or ()]
    assert may_meet_shorter(words) == dotted
    got = {}
    for r in retrieval.keyword_topk(queries, index, 6, max_query_bytes=max_bytes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id, r.chunk_index))
    assert got == _want(queries, index, 6)


def test_lower_casing_lengthens_one_letter_only(spark):
    letters = spark.createDataFrame([(chr(i),) for i in range(0x110000) if not 0xD800 <= i < 0xE000], "c string")
    assert [r.c for r in letters.where(F.char_length(F.lower("c")) != F.char_length("c")).collect()] == ["İ"]


def test_index_texts_are_not_split_before_the_task(spark):
    """The index's texts reach the task in one piece and in one column: no regular expression, no token arrays."""
    queries = spark.createDataFrame([(1, "alpha beta")], "query_id int, text string")
    plan = retrieval.keyword_topk(queries, _index(spark), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "array<" not in plan and "lower(text" in plan


def _block(n, seed=3):
    rng = np.random.default_rng(seed)
    word = [f"w{i}" * 2 for i in range(50)]
    texts = [" ".join(rng.choice(word, 30)) for _ in range(n)]
    counts = embedding.bucket_counts(texts, 64, "md5")
    idx = [np.flatnonzero(c).tolist() for c in counts]
    return texts, idx, [c[i].tolist() for c, i in zip(counts, idx, strict=True)], np.linalg.norm(counts, axis=1).tolist()


def test_vector_scores_look_words_up_for_picked_rows_only(monkeypatch):
    """With the whole weight on the vectors no keyword score ranks anything: it is made for the rows that leave the task."""
    texts, idx, cnt, norm = _block(1500)
    toks = [sorted(set(t.split())) for t in texts[:4]]
    asked = pa.table({"query_id": pa.array(range(4)), "toks": toks, "idx": idx[:4], "cnt": cnt[:4], "norm": norm[:4]})
    batch = pa.record_batch({"chunk_id": [f"c{i}" for i in range(1500)], "doc_id": list(range(1500)), "chunk_index": [0] * 1500,
                             "low": texts, "idx": idx, "cnt": cnt, "norm": norm})
    seen, keyword = [], retrieval.QuerySlice.keyword
    monkeypatch.setattr(retrieval.QuerySlice, "keyword", lambda self, *a: seen.append(len(a[0])) or keyword(self, *a))
    names = ["query_id", "chunk_id", "doc_id", "chunk_index", "vec_score", "kw_score", "score"]
    run = lambda weight, *picks: pa.Table.from_batches(
        retrieval._kernel(SimpleNamespace(value=asked), 64, weight, picks, names)(iter([batch]))).to_pylist()
    found = run(1.0, ("score", 5))
    assert sum(seen) < 100
    full = {(r["query_id"], r["doc_id"]): r for r in run(0.5, ("score", 1500))}
    assert sum(seen) > 1500
    for r in found:
        own = full[r["query_id"], r["doc_id"]]
        assert (r["vec_score"], r["kw_score"], r["score"]) == (own["vec_score"], own["kw_score"], own["vec_score"])


def test_hits_of_dense_and_rare_tokens_equal_set_sizes():
    """Tokens that most chunks hold go through the matrix product, rare ones through single cells."""
    rng = np.random.default_rng(1)
    lists = [[f"t{j}" for j in range(600) if rng.random() < (.9 if j < 300 else .004)] for _ in range(90)]
    chunks = [[f"t{j}" for j in range(600) if rng.random() < (.8 if j < 300 else .004)] for _ in range(70)]
    q = retrieval.QuerySlice([{"query_id": i, "toks": ts, "idx": None, "norm": None} for i, ts in enumerate(lists)], 0)
    want = [[len(set(a) & set(b)) for b in chunks] for a in lists]
    pairs = np.array([(q.number[t], i) for i, c in enumerate(chunks) for t in c if t in q.number])
    assert q.hits(pairs[:, 0], pairs[:, 1], len(chunks)).tolist() == want
    got = q.keyword(pa.array([" ".join(c + c[:5]) for c in chunks]))
    assert np.rint(got * q.sizes[:, None]).tolist() == want
