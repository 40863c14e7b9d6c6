"""Second-stage ranking, subword windows, content-addressed vectors, sketches."""

import itertools
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docflow.operators import chunking, embedding, retrieval, sketches, vector_store
from docflow.session import scratch_path

SPEC = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


def test_shortest_cover_equals_all_runs():
    r = random.Random(5)
    for _ in range(400):
        words = [r.choice("abcdef") for _ in range(r.randint(0, 14))]
        wanted = set(r.sample("abcdxy", r.randint(0, 4)))
        found = wanted & set(words)
        runs = [j - i for i, j in itertools.combinations(range(len(words) + 1), 2) if found <= set(words[i:j])]
        assert retrieval.shortest_cover(words, wanted) == (len(found), min(runs) if found else 0)


def test_reranker_prefers_near_words_and_falls_back(spark):
    texts = ["alpha " + "filler " * 40 + "beta", "filler " * 20 + "alpha beta", "alpha " + "other " * 9, "nothing here", ""]
    index = retrieval.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    q = embedding.embed_md5_vectors(spark.createDataFrame([(1, "Alpha BETA"), (2, "unheard"), (3, "")], "query_id bigint, text string"), ["query_id", "text"])
    got = {(r["query_id"], r["doc_id"]): r for r in retrieval.reranked_topk(q, index, k=4).collect()}
    assert got[1, 1]["rank"] == 1 and got[1, 1]["cover"] == 2 and got[1, 1]["reranker_score"] == pytest.approx(1.0)
    assert got[1, 0]["cover"] == 42 and got[1, 0]["score"] == pytest.approx(4 / (2 * 42))
    one = got[1, 2]
    assert one["matched"] == 1 and one["reranker_score"] is None and one["score"] == one["base_score"]
    assert all(r["reranker_score"] is None for (qid, _), r in got.items() if qid != 1)


def test_subword_windows_are_slices_of_the_text(spark):
    texts = ["", None, "one", "日本語😀é " * 60, "a  b\n\nc " * 90, "x" * 700, " ", "<|endoftext|> end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    lib = Tokenizer.from_str(SPEC)
    for size, overlap in ((16, 4), (5, 0), (400, 40)):
        rows = {}
        for r in chunking.subword_windows(docs, SPEC, size, overlap, batch_docs=2).orderBy("doc_id", "chunk_index").collect():
            rows.setdefault(r["doc_id"], []).append(r)
        assert set(rows) == {2, 3, 4, 5, 6, 7}
        for i, got in rows.items():
            text, n = texts[i], len(lib.encode(texts[i], add_special_tokens=False))
            assert all(r["text"] == text[r["start"]:r["stop"]] for r in got)
            assert got[0]["start"] == 0 and got[-1]["stop"] == len(text) and len(got) == max(0, -(-(n - size) // (size - overlap))) + 1
            assert sum(r["n_tokens"] for r in got) == n + overlap * (len(got) - 1)
            assert all(a["stop"] >= b["start"] for a, b in itertools.pairwise(got))
            if not overlap and text.isascii():
                assert "".join(r["text"] for r in got) == text
    with pytest.raises(ValueError):
        chunking.subword_windows(docs, SPEC, 5, 5)


def test_texts_are_embedded_once(spark):
    store = vector_store.VectorStore(spark, scratch_path(spark, "store-test"), dim=32)
    a = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, "")], "i int, text string")
    out, n = store.embed(a.withColumn("norm", F.lit("clash")))
    assert n == 2 and out.count() == 4
    got = {r["i"]: r for r in out.collect()}
    plain = {r["i"]: r for r in embedding.embed_md5_vectors(a, ["i"], "text", 32).collect()}
    assert got[1]["idx"] == plain[1]["idx"] and got[1]["norm"] == plain[1]["norm"] and got[3]["norm"] == got[4]["norm"] == 0
    assert store.embed(a)[1] == 0
    b, n = store.embed(spark.createDataFrame([(5, "gamma delta"), (1, "alpha beta")], "i int, text string"))
    assert n == 1 and b.count() == 2 and len(store._parts()) == 2
    assert vector_store.VectorStore(spark, scratch_path(spark, "store-test")).embed(a.limit(0))[0].count() == 0


def test_merged_sketches_are_near_the_truth(spark):
    r = random.Random(2)
    rows = [(f"2024-01-{1 + i % 9:02d} 10:00:00", r.choice("ab"), r.lognormvariate(3, 1), r.randint(1, 3000)) for i in range(20_000)]
    rows += [("2024-01-01 11:00:00", "c", None, 1), ("2024-01-01 11:00:00", "d", 5.0, None)]
    df = spark.createDataFrame(rows, "at string, model string, ms double, who int").withColumn("at", F.col("at").cast("timestamp"))
    stored = sketches.daily(df, "at", ["model"], "ms", "who")
    assert stored.count() == 20
    got = {r["model"]: r for r in sketches.estimates(sketches.merge(stored, ["model"])).collect()}
    for m in "ab":
        mine = sorted(v for _, k, v, _ in rows if k == m)
        for p, col in ((.5, "p50"), (.95, "p95")):
            assert abs(sum(v <= got[m][col] for v in mine) / len(mine) - p) < 0.02
        people = len({w for _, k, _, w in rows if k == m})
        assert abs(got[m]["people"] - people) < 0.03 * people and got[m]["n"] == len(mine)
    assert got["c"]["p50"] is None and got["c"]["n"] == 1 and got["d"]["p95"] == 5.0 and got["d"]["people"] == 0
    total = sketches.roll_up(stored, ["model"]).where("level = 1").first()
    assert total["n"] == 20_002
    assert sketches.estimates(sketches.merge(stored.limit(0), ["model"])).count() == 0


def test_a_text_meets_its_windows_in_one_row(spark, tmp_path):
    """The check of ``subword_windows`` joins a whole text once, not once a window; copies of an id count."""
    from docflow.plans import q_retrieval

    texts = [(1, "word " * 3000), (2, "one"), (3, None), (4, ""), (5, "日本語😀é " * 300), (6, "same"), (6, "same"), (7, "two"), (7, "texts"), (None, "lost")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = q_retrieval.subword_windows(spark, str(tmp_path))
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert {i: got[i] for i in (1, 2, 5, 6)} == {i: (len(t), True, True, True, True) for i, t in texts if i in (1, 2, 5, 6)}
    assert set(got) == {1, 2, 5, 6, 7} and got[7] == (5, False, False, True, True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "Join LeftOuter" in plan
