import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.operators import chunking, embedding, retrieval
from tests.conftest import rows


def kwset(t):
    return {x.lower() for x in t.split() if len(x) > 2}


def py_keyword_topk(queries, chunks, k):
    out = []
    for qid, qt in queries:
        q = kwset(qt)
        scored = []
        for cid, doc, idx, ct in chunks:
            c = kwset(ct)
            s = len(q & c) / len(q) if q and c else 0.0
            scored.append((-s, doc, idx, cid, s))
        scored.sort()
        out += [(qid, cid, s, r + 1) for r, (_, doc, idx, cid, s) in enumerate(scored[:k])]
    return sorted(out)


@pytest.fixture()
def corpus(spark):
    docs = spark.createDataFrame([
        ("d1", "The quick brown fox jumps over the lazy dog"),
        ("d2", "A lazy afternoon with the brown cat"),
        ("d3", "Completely unrelated words here"),
        ("d4", "fox fox fox"),
    ], "doc_id string, text string")
    return chunking.chunk_documents(docs, 4, 1)


def test_keyword_topk_matches_python_model_with_zero_fill(spark, corpus):
    queries = [("q1", "lazy brown FOX"), ("q2", "zzz yyy"), ("q3", "a an"), ("q4", "the dog")]
    qdf = spark.createDataFrame(queries, "query_id string, text string")
    chunks = [(r.chunk_id, r.doc_id, r.chunk_index, r.text) for r in corpus.collect()]
    for k in (1, 3, 5):
        got = rows(retrieval.keyword_topk(qdf, corpus, k), "query_id", "chunk_id", "score", "rank")
        assert got == py_keyword_topk(queries, chunks, k)


def test_keyword_topk_k_zero_and_empty_index(spark, corpus):
    qdf = spark.createDataFrame([("q", "fox")], "query_id string, text string")
    assert retrieval.keyword_topk(qdf, corpus, 0).count() == 0
    empty = corpus.limit(0)
    assert retrieval.keyword_topk(qdf, empty, 3).count() == 0


def test_vector_topk_matches_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((60, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "vec_id long, vec array<double>")
    q = df.select(F.col("vec_id").alias("query_id"), "vec").where("query_id < 7")
    got = retrieval.vector_topk(q, df, k=4, index_keys=("vec_id",), digits=9).collect()
    S = np.round(m[:7] @ m.T, 9)
    for r in got:
        order = sorted(range(60), key=lambda j: (-S[r.query_id, j], j))[:4]
        assert r.vec_id == order[r.rank - 1]
        assert r.score == pytest.approx(S[r.query_id, r.vec_id])
    assert len(got) == 28
    # scores descend within a query
    for qid in range(7):
        s = [r.score for r in sorted(got, key=lambda r: r.rank) if r.query_id == qid]
        assert s == sorted(s, reverse=True)


def py_blend(queries, chunks, w, dim):
    """Every (query, chunk) with its scores, from the definitions."""
    from tests.test_embeddings import py_md5_counts

    out = {}
    for qid, qt in queries:
        q, qv = kwset(qt), py_md5_counts(qt, dim)
        for cid, doc, i, ct in chunks:
            c, cv = kwset(ct), py_md5_counts(ct, dim)
            kw = len(q & c) / len(q) if q else 0.0
            norm = sum(x * x for x in qv.values()) ** 0.5 * sum(x * x for x in cv.values()) ** 0.5
            vec = sum(x * cv.get(k, 0) for k, x in qv.items()) / norm if norm else 0.0
            out[qid, cid] = (doc, i, vec, kw, w * vec + (1 - w) * kw)
    return out


QUERIES = [("q1", "lazy brown fox"), ("q2", ""), ("q3", "unrelated words\u00a0jumps"), ("q4", "zzz")]


@pytest.fixture()
def vectors(spark, corpus):
    qdf = spark.createDataFrame(QUERIES, "query_id string, text string")
    return embedding.embed_md5_vectors(qdf, dim=64), embedding.embed_md5_vectors(corpus, dim=64)


@pytest.mark.parametrize("w", [0.0, 0.7, 1.0])
@pytest.mark.parametrize("max_bytes", [1500, 64 << 20])
def test_blended_topk_ranks_all_chunks(corpus, vectors, w, max_bytes):
    chunks = [(r.chunk_id, r.doc_id, r.chunk_index, r.text) for r in corpus.collect()]
    want = py_blend(QUERIES, chunks, w, 64)
    got = retrieval.blended_topk(*vectors, k=4, vector_weight=w, dim=64, max_query_bytes=max_bytes).collect()
    assert len(got) == 16
    for qid, _ in QUERIES:
        order = sorted((c for q, c in want if q == qid), key=lambda c: (-want[qid, c][4], *want[qid, c][:2]))
        mine = sorted((r for r in got if r.query_id == qid), key=lambda r: r.rank)
        assert [r.chunk_id for r in mine] == order[:4]
        assert [(r.vec_score, r.kw_score, r.score) for r in mine] == [pytest.approx(want[qid, c][2:]) for c in order[:4]]


def test_hybrid_is_the_blend_of_its_candidates(vectors):
    out = retrieval.hybrid_topk(*vectors, k=3, dim=64).collect()
    assert all(r.score == pytest.approx(0.7 * r.vec_score + 0.3 * r.kw_score) for r in out)
    assert sum(r.query_id == "q1" for r in out) == 3
    with pytest.raises(ValueError):
        retrieval.hybrid_topk(*vectors, vector_weight=1.5)


@pytest.mark.parametrize("max_bytes", [1500, 64 << 20])
def test_keyword_topk_does_not_depend_on_slices(spark, corpus, max_bytes):
    qdf = spark.createDataFrame([("q1", "lazy brown FOX"), ("q2", "the dog"), ("q3", "cat")], "query_id string, text string")
    assert rows(retrieval.keyword_topk(qdf, corpus, 3, max_query_bytes=max_bytes)) == rows(retrieval.keyword_topk(qdf, corpus, 3))


def test_vector_topk_sliced_broadcast_equals_single(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((40, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(40)], "vec_id long, vec array<double>")
    q = df.select(F.col("vec_id").alias("query_id"), "vec")
    one = rows(retrieval.vector_topk(q, df, k=3, index_keys=("vec_id",), digits=9))
    sliced = rows(retrieval.vector_topk(q, df, k=3, index_keys=("vec_id",), digits=9,
                                        max_query_bytes=1500))   # forces several slices
    assert one == sliced and len(one) == 120


@pytest.mark.parametrize("step", [1, 50, 4 << 20])
def test_hits_of_many_queries_equal_set_sizes(step):
    import random

    from docflow.operators.retrieval import QuerySlice

    r = random.Random(step)
    word = lambda: r.choice(["the", "of"]) if r.random() < .3 else f"w{int(r.random() ** 3 * 400)}"
    rows = [{"query_id": i, "toks": sorted({word() for _ in range(r.randint(0, 30))}) or None, "idx": None, "norm": None}
            for i in range(300)]
    chunks = [sorted({word() for _ in range(60)}) for _ in range(40)]
    q = QuerySlice(rows, 0)
    pairs = np.array([(q.number[t], i) for i, c in enumerate(chunks) for t in c if t in q.number])
    got = q.hits(pairs[:, 0], pairs[:, 1], len(chunks), step)
    assert got.tolist() == [[len(set(x["toks"] or ()) & set(c)) for c in chunks] for x in rows]


def test_floor_drops_only_what_cannot_be_among_the_first():
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 12, (7, 400)) / 4
    floor, found = retrieval.Floor(7, 5), []
    for at in range(0, 400, 40):
        row, col = floor.best(scores[:, at:at + 40])
        found += [(r, -scores[r, at + c], at + c) for r, c in zip(row.tolist(), col.tolist(), strict=True)]
    assert len(found) < 7 * 5 * 10  # later blocks leave out what the first ones beat
    row, col = retrieval.best_rows(scores, 5)
    for i in range(7):
        assert [c for r, _, c in sorted(found) if r == i][:5] == col[row == i].tolist()


def test_scoring_emits_few_rows_of_many_blocks(spark):
    """One task over many blocks: a query's later blocks add only what may still rank."""
    vecs = [(i, [float(i % 97), 1.0]) for i in range(6000)]
    index = spark.createDataFrame(vecs, "vec_id bigint, vec array<double>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, vec array<double>")
    got = retrieval.vector_topk(queries, index, k=3, index_keys=("vec_id",))
    assert dict(got.dtypes)["query_id"] == "int"
    assert {(r.query_id, r.vec_id, r.score, r["rank"]) for r in got.collect()} == {
        (1, 96, 96.0, 1), (1, 193, 96.0, 2), (1, 290, 96.0, 3), (2, 0, 1.0, 1), (2, 1, 1.0, 2), (2, 2, 1.0, 3)}


def test_reranked_candidates_by_the_shortest_run_of_matched_words(spark):
    texts = ["alpha beta gamma", "alpha filler filler beta", "alpha only here", "nothing at all", None]
    index = embedding.embed_md5_vectors(spark.createDataFrame(
        [(f"c{i}", i, 0, t) for i, t in enumerate(texts)], "chunk_id string, doc_id bigint, chunk_index bigint, text string"), dim=64)
    queries = embedding.embed_md5_vectors(spark.createDataFrame([(7, "alpha beta"), (8, None)], "query_id bigint, text string"),
                                          ["query_id", "text"], "text", 64)
    got = {(r.query_id, r.chunk_id): r for r in retrieval.reranked_topk(queries, index, 5, dim=64).collect()}
    assert [(got[7, f"c{i}"].matched, got[7, f"c{i}"].cover, got[7, f"c{i}"].reranker_score) for i in range(4)] == [
        (2, 2, 1.0), (2, 4, 0.5), (1, 1, None), (0, 0, None)]
    assert {got[8, f"c{i}"].score for i in range(5)} == {0.0}
