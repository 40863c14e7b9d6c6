import random

import pytest

from docflow.operators import inverted, retrieval
from docflow.session import Shipped, scratch_path
from tests.conftest import rows

COLS = ("query_id", "chunk_id", "doc_id", "chunk_index", "score", "rank")


def _chunks(n, seed=1):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "and", "for"]) if r.random() < .4 else f"w{int(r.random() ** 2 * 900)}"
    out = [(f"{i % 97}_{i // 97}", i % 97, i // 97, " ".join(word() for _ in range(r.randint(0, 30)))) for i in range(n)]
    return out + [("900_0", 900, 0, None), ("901_0", 901, 0, ""), ("902_0", 902, 0, "of it")]


def _index(spark, chunks):
    df = spark.createDataFrame(chunks, "chunk_id string, doc_id bigint, chunk_index bigint, text string")
    base = scratch_path(spark, "inverted-test")
    inverted.build(df, base)
    return df, base


def _queries(spark, chunks, n=30):
    r = random.Random(7)
    texts = [r.choice(chunks)[3] for _ in range(n)] + [None, "", "of it", "unheard word", "the", "THE the w3 W4"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


@pytest.mark.parametrize("bits", [(9, 4), (3, 2)])
def test_equals_the_scan(spark, monkeypatch, bits):
    monkeypatch.setattr(inverted, "BLOCK_BITS", bits[0])
    monkeypatch.setattr(inverted, "GROUP_BITS", bits[1])
    chunks = _chunks(1500)
    df, base = _index(spark, chunks)
    q = _queries(spark, chunks)
    for k in (1, 5, 40):
        assert rows(inverted.keyword_topk(q, base, k), *COLS) == rows(retrieval.keyword_topk(q, df, k), *COLS)
    want = rows(retrieval.keyword_topk(q, df, 5), *COLS)
    assert rows(inverted.keyword_topk(q, base, 5, max_query_bytes=4000), *COLS) == want  # several slices


def test_blocks_below_the_threshold_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_BITS", 3)
    texts = ["alpha beta gamma delta" if i in (3, 4) else "alpha" if i % 2 else "other words" for i in range(400)]
    df, base = _index(spark, [(f"{i}_0", i, 0, t) for i, t in enumerate(texts)])
    q = [{"query_id": 1, "toks": ["alpha", "beta", "gamma", "delta"], "idx": None, "norm": None}]
    shared = Shipped(spark, retrieval.QuerySlice(q, 0))
    all_rows = inverted.postings(spark, base, list(shared.value.number))
    assert inverted._likely_blocks(all_rows, shared) == [(0, 0)]
    found = inverted._scored(all_rows, shared, 2, {0: (4, 4)}).collect()
    assert sorted(r["number"] for r in found) == [3, 4] and all(r["hits"] == 4 for r in found)
    assert len(inverted._scored(all_rows, shared, 2, None).collect()) == 8  # two a group without a threshold


def test_only_the_tokens_partitions_are_read(spark):
    _, base = _index(spark, _chunks(300))
    plan = inverted.postings(spark, base, ["the", "w3"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_few_or_no_chunks(spark):
    q = _queries(spark, _chunks(5))
    df, base = _index(spark, [("1_0", 1, 0, "the word")])
    assert rows(inverted.keyword_topk(q, base, 5), *COLS) == rows(retrieval.keyword_topk(q, df, 5), *COLS)
    df, base = _index(spark, [])
    assert inverted.keyword_topk(q, base, 5).count() == 0
    assert inverted.keyword_topk(q.limit(0), base, 5).count() == 0
    assert inverted.keyword_topk(q, base, 0).count() == 0


def test_a_token_has_one_row_a_block_and_its_places(spark, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_BITS", 3)
    chunks = _chunks(500)
    _, base = _index(spark, chunks)
    made = spark.read.schema(inverted.POSTINGS).parquet(f"{base}/postings")
    got = {(r["token"], r["block"]): r["places"] for r in made.collect()}
    assert len(got) == made.count()
    number = {r["chunk_id"]: r["number"] for r in spark.read.parquet(f"{base}/chunks").collect()}
    want: dict = {}
    for chunk, _, _, text in sorted(chunks, key=lambda c: number[c[0]]):
        for token in {t for t in (text or "").split() if len(t) > 2}:
            want.setdefault((token, number[chunk] >> 3), []).append(number[chunk] & 7)
    assert got == want and sorted(number) == sorted(c[0] for c in chunks)


def test_no_row_a_token_and_chunk_is_shuffled(spark, monkeypatch):
    """The postings come from the sorted chunks: nothing is grouped by token on the way."""
    plans = []
    real = inverted.saved
    monkeypatch.setattr(inverted, "saved", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    _index(spark, _chunks(50))
    assert len(plans) == 2 and "Sort [doc_id" in plans[1] and not any("Aggregate" in p or "split(" in p for p in plans[1:])


def test_keywords_part_at_every_white_space(spark):
    from docflow.functions.text import keyword_set

    spaces = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or c in (0x21, 0x7E, 0x7F, 0x200B))]
    texts = [f"abc{s}Def{s}{s}gh{s}" for s in spaces]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", keyword_set("text").alias("toks"))
    for r in df.collect():
        assert r["toks"] == list(dict.fromkeys(t.lower() for t in texts[r["i"]].split() if len(t) > 2)), texts[r["i"]]
