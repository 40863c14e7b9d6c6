import corpus_pipeline as cp
from docflow.llm import attention_mil, chunk_bpe, fm_index
from docflow.session import table
from tests.conftest import SF0001
from tests.llm import brute
from tests.llm.test_line_rules import plain as base_rules
from tests.llm.test_minhash import plain as components


def test_every_stage_against_a_plain_version(spark):
    docs = table(spark, SF0001, "documents")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF0001)
        if name != cp.STAGES[-1][0]:
            assert out.columns == columns
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}
        seen.append((name, len(after)))
        if name == "quality classifier":
            model = attention_mil.train(docs, table(spark, SF0001, "labels"))
            want = {r["doc_id"] for r in attention_mil.score(docs, model).collect() if r["score"] >= cp.QUALITY}
        elif name == "quality rules":
            want = {i for i, r in before.items() if not base_rules(r["text"])[-1]}
        elif name == "MinHash near-dedup":
            comp = components([(i, r["text"]) for i, r in before.items()], 5)
            want = {i for i, c in comp.items() if i == c}
        elif name == "benchmark decontamination":
            phrases = {}
            for r in table(spark, SF0001, "benchmark").collect():
                w = brute.alnum_words(r["text"])
                for k in range(max(1, len(w) - 9) if w else 0):
                    phrases.setdefault(tuple(w[k:k + 10]), set()).add(r["item_id"])
            hits = {i: brute.window_hits(r["text"], phrases) for i, r in before.items()}
            want = {i for i, (n, hit, _) in hits.items() if n == 0 or hit < n}
            for i in want:
                left = brute.alnum_words(after[i]["text"])
                assert len(left) == hits[i][0] - hits[i][1]
                assert after[i]["n_chars"] == (len(after[i]["text"]) if hits[i][1] else before[i]["n_chars"])
        else:
            from tokenizers import Tokenizer

            lib, want = Tokenizer.from_file(cp.public_tokenizers.path(cp.TOKENIZER)), set(before)
            for i, r in after.items():
                assert r["ids"] == lib.encode(before[i]["text"], add_special_tokens=False).ids
        assert set(after) == want, name
        docs = out
    assert seen[0][1] < 200 and seen[-1][1] > 0


def test_one_document_of_each_group_stays(spark):
    docs = brute.docs(spark)
    out = cp.near_dedup(spark, docs, "")
    comp = components(brute.ROWS, 5)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.columns == docs.columns and ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in comp.items() if i == c})


def test_run_and_awkward_rows(spark, tmp_path):
    brute.docs(spark, extra=False).selectExpr("doc_id", "text", "'en' AS lang", "cast(null AS string) AS source", "1L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= {i for i, _ in brute.ROWS} and any(r["doc_id"] == 3 for r in rows)
    assert fm_index and chunk_bpe
