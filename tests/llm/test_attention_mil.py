import numpy as np
import pytest

from docflow.llm import attention_mil as mil
from docflow.session import table
from tests.conftest import SF001
from tests.llm import brute


def test_passages_cover_whole_texts():
    texts = ["", "a b", brute.LONG, " \n", "A! b| #é 1."]
    rows, n = mil.passages(texts)
    words = [len(brute.WORD.findall(t)) for t in texts]
    assert n.tolist() == [max(1, -(-w // mil.PASSAGE)) for w in words]
    ends = np.cumsum(n)
    for t, a, b, w in zip(texts, ends - n, ends, words, strict=True):
        assert rows[a:b, -1].sum() == w
        assert rows[a:b, 8].sum() == t.count("|") and rows[a:b, 6].sum() == t.count("!")
    rep, _ = mil.passages(["x x x y y", "x"])
    assert rep[0, mil.CLASSES] == 3


def test_gradient_is_the_losses_slope():
    r = np.random.default_rng(0)
    x, n, y = r.normal(size=(9, 5)), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])
    model = mil.Model(5, hidden=3, gate=2)
    def loss():
        p = model.score(x, n)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    before = loss()
    model.fit(x, n, y, steps=60, rate=0.05)
    assert loss() < 0.3 * before


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF001, "documents"), table(spark, SF001, "labels")
    model = mil.train(docs, labels)
    got = mil.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in got]) > 0.97


@pytest.mark.parametrize("labels, low, high", [([], 0.99, 1), ([(3, 1), (7, 1)], 0.99, 1), ([(3, 0), (7, 0)], 0, 0.01)])
def test_missing_labels_and_awkward_rows(spark, labels, low, high):
    docs = brute.docs(spark)
    model = mil.train(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"), held=99)
    scored = mil.score(docs, model, batch_chars=5000).collect()
    assert len(scored) == len(brute.ROWS) and all(low <= r["score"] <= high for r in scored)
    assert mil.score(docs.limit(0), model).count() == 0


def test_learns_only_from_rows_outside_the_fold(spark):
    docs = brute.docs(spark, [(i, "good text here" if i % 2 else "BAD!! TEXT!!") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a = [r["score"] for r in mil.score(docs, mil.train(docs, labels)).orderBy("doc_id").collect()]
    assert a == [r["score"] for r in mil.score(docs, mil.train(docs, flipped)).orderBy("doc_id").collect()]
    assert all((s > 0.7) == bool(i % 2) for i, s in enumerate(a))


def _plain_score(text, model):
    """One document, passage by passage, in scalars."""
    import math

    raw, words, spans = text.encode(), [m.span() for m in brute.WORD.finditer(text)], []
    for a, b in words:  # spans of words in bytes
        start = len(text[:a].encode())
        spans.append((start, start + len(text[a:b].encode())))
    groups = [spans[i:i + mil.PASSAGE] for i in range(0, len(spans), mil.PASSAGE)] or [[]]
    starts = [g[0][0] for g in groups if g] + [len(raw)]
    rows = []
    for i, g in enumerate(groups):
        if not g:
            rows.append([0.0] * (mil.CLASSES + 4))
            continue
        part = raw[starts[i]:starts[i + 1]] + (b" " if i + 1 == len(groups) else b"")
        row = [float(sum(mil.TABLE[c] == k for c in part)) for k in range(mil.CLASSES)]
        own = [raw[a:b] for a, b in spans]
        first = i * mil.PASSAGE
        row += [float(sum(j >= lag and own[j] == own[j - lag] for j in range(first, first + len(g)))) for lag in (1, 2)]
        row += [float(sum(b - a <= 3 for a, b in g)), float(len(g))]
        rows.append(row)
    p, hs, es = model.p, [], []
    for row in rows:
        n_bytes, n_words = max(sum(row[:mil.CLASSES]), 1), max(row[-1], 1)
        x = [v / n_bytes for v in row[:mil.CLASSES]] + [v / n_words for v in row[mil.CLASSES:-1]] + [row[-1] / mil.PASSAGE, n_bytes / n_words / 10]
        x = [(v - m) / s for v, m, s in zip(x, model.mean, model.scale, strict=True)]
        h = [math.tanh(sum(a * b for a, b in zip(x, col, strict=True)) + c) for col, c in zip(p["W"].T, p["b"], strict=True)]
        gate = 0.0
        for v, u, w in zip(p["V"].T, p["U"].T, p["w"], strict=True):
            s = sum(a * b for a, b in zip(h, u, strict=True))
            gate += w * math.tanh(sum(a * b for a, b in zip(h, v, strict=True))) / (1 + math.exp(-s))
        hs.append(h)
        es.append(gate)
    total = sum(math.exp(e) for e in es)
    z = [sum(math.exp(e) / total * h[k] for e, h in zip(es, hs, strict=True)) for k in range(len(hs[0]))]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["d"][0]))))


def test_scores_equal_a_plain_forward_pass(spark):
    docs = brute.docs(spark)
    model = mil.train(docs, spark.createDataFrame([(i, i % 2) for i in range(14)], "doc_id bigint, quality int"), held=99)
    for r in mil.score(docs, model, batch_chars=3000).collect():
        text = r["text"] or ""
        if len(text) < 10_000:
            assert r["score"] == pytest.approx(_plain_score(text, model), abs=1e-9)


def test_a_text_has_one_score_whatever_stands_beside_it():
    r = np.random.default_rng(4)
    texts = ["", " \n\t ", "\n\n  Leading blanks. Yes!", "a b c  \n", "trailing \n\n\n", "plain words, here.", "é ü | #1"]
    model = mil.Model(mil.CLASSES + 5)
    model.p["c"][:] = r.normal(size=12)
    alone = [float(model.score(mil.encode(rows), n)[0]) for rows, n in (mil.passages([t]) for t in texts)]
    for _ in range(20):
        order = r.permutation(len(texts))
        rows, n = mil.passages([texts[i] for i in order])
        assert model.score(mil.encode(rows), n).tolist() == pytest.approx([alone[i] for i in order], abs=1e-12)
