import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.operators import embedding

WORD = re.compile(r"[A-Za-z][A-Za-z0-9_-]{2,}")
TEXTS = [("a", "Hello hello WORLD of data-sets and x1_y tokens"), ("b", "!!! ?? 12 ab"),
         ("c", "the the the"), ("d", "")]


def py_md5_counts(text, dim):
    v = {}
    for tok in WORD.findall(text.lower()):
        h = hashlib.md5(tok.encode()).hexdigest()
        idx = int(h[:8], 16) % dim
        sign = 1 if int(h[8:10], 16) % 2 == 1 else -1
        v[idx] = v.get(idx, 0) + sign
    return {k: c for k, c in v.items() if c != 0}


def py_blake(text, dim):
    m = np.zeros(dim, dtype=np.float32)
    for tok in WORD.findall(text.lower()):
        h = hashlib.blake2b(tok.encode(), digest_size=8).digest()
        m[int.from_bytes(h[:4], "little") % dim] += 1.0 if (h[4] & 1) else -1.0
    n = float(np.linalg.norm(m))
    return m / n if n > 0 else m


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id string, text string")


def test_md5_sparse_matches_python_and_is_unit_norm(spark, docs):
    got = embedding.embed_md5_sparse(docs, ["doc_id"], dim=64).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, {})[r.idx] = r.weight
    for doc_id, text in TEXTS:
        want = py_md5_counts(text, 64)
        norm = math.sqrt(sum(c * c for c in want.values()))
        assert set(by_doc.get(doc_id, {})) == set(want)
        for k, c in want.items():
            assert by_doc[doc_id][k] == pytest.approx(c / norm)
        if want:
            assert sum(w * w for w in by_doc[doc_id].values()) == pytest.approx(1.0)


def test_vectors_keep_every_row_zero_vector_for_no_tokens(spark, docs):
    v = {r.doc_id: r for r in embedding.embed_md5_vectors(docs, ["doc_id"], dim=64).collect()}
    assert set(v) == {"a", "b", "c", "d"}
    assert v["b"].idx == [] and v["b"].norm == 0.0
    assert v["d"].idx == [] and v["d"].norm == 0.0
    dense = {r.doc_id: r.vec for r in embedding.embed_md5_dense(docs, ["doc_id"], dim=64).collect()}
    assert len(dense["a"]) == 64 and all(x == 0.0 for x in dense["b"])
    want = py_md5_counts(TEXTS[0][1], 64)
    assert dict(zip(v["a"].idx, v["a"].cnt)) == want
    assert {i: round(x * v["a"].norm) for i, x in enumerate(dense["a"]) if x} == want


def test_blake2b_exact_deterministic_unit_or_zero(spark, docs):
    out = {r.doc_id: r.e for r in docs.select("doc_id", embedding.embed_blake2b(F.col("text"), 64).alias("e")).collect()}
    for doc_id, text in TEXTS:
        np.testing.assert_allclose(np.array(out[doc_id], dtype=np.float32), py_blake(text, 64), rtol=1e-6)
    assert np.linalg.norm(out["a"]) == pytest.approx(1.0, rel=1e-6)
    assert not any(out["b"]) and not any(out["d"])


def test_dim_lower_bound(spark, docs):
    with pytest.raises(ValueError):
        embedding.embed_md5_sparse(docs, ["doc_id"], dim=16)


def test_prompt_hash(spark, docs):
    got = {r.doc_id: r.h for r in docs.select("doc_id", embedding.prompt_hash(F.col("text")).alias("h")).collect()}
    assert got["a"] == hashlib.blake2b(TEXTS[0][1].encode(), digest_size=8).hexdigest()
    assert len(got["d"]) == 16


def test_counts_come_in_slices_of_bounded_rows_and_bytes():
    texts = ["alpha beta alpha", None, ""] * 700 + ["long words " * 200_000, "tail"]
    parts = list(embedding._counted(iter([pa.array(texts)]), 32, "md5"))
    assert max(len(p) for p in parts) <= 512 and sum(len(p) for p in parts) == len(texts)
    whole = np.concatenate(parts)
    for i in (0, 1, 2, 2097, 2100, 2101):
        assert {k: c for k, c in enumerate(whole[i]) if c} == py_md5_counts(texts[i] or "", 32)


def test_columns_of_several_slices_match_python(spark):
    texts = [f"word{i} same {'x' * (i % 7)}" if i % 5 else None for i in range(1300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = df.select("i", embedding.sparse_counts(F.col("t"), 64).alias("s"), embedding.dense_unit(F.col("t"), 64, "blake2b").alias("d")).collect()
    for r in got:
        assert dict(zip(r.s.idx, r.s.cnt, strict=True)) == py_md5_counts(texts[r.i] or "", 64)
        assert np.allclose(r.d, py_blake(texts[r.i] or "", 64))
