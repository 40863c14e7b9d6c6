import math
import zlib
from collections import Counter

import numpy as np

from docflow.llm import class_lm
from docflow.session import table
from tests.conftest import SF001, SF0001
from tests.llm import brute


def base(rows):
    tokens = [(i, brute.words(t) + ["\n"]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in tokens]
    counts = Counter(w for (i, ws), h in zip(tokens, held, strict=True) if not h and i is not None for w in ws)
    return tokens, held, counts


def _check_base(rows, got):
    tokens, held, c = base(rows)
    n, d = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    want = sorted((i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / d) for w in ws), 6))
                  for (i, ws), h in zip(tokens, held, strict=True))
    assert want == sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)


def test_base_scores_and_better_perplexity(spark):
    docs = table(spark, SF0001, "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for hot in (50, 262_144):  # most tokens join their counts; most are broadcast
        got = class_lm.score(docs, hot=hot, core=min(40, hot), units=256, n_classes=16, passes=3).collect()
        _check_base(rows, got)
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_held_out_perplexity_with_production_parameters(spark):
    held = [r for r in class_lm.score(table(spark, SF001, "documents")).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] - r["base_score"] for r in held) / n > math.log10(1.5)


def test_hot_and_joined_counts_give_one_score(spark):
    rows = [(i, f"a b{i % 3} c{i % 7} x{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, two = (sorted((r["doc_id"], round(r["base_score"], 9)) for r in class_lm.score(
        docs, hot=h, core=2, units=64, n_classes=4, passes=2).collect()) for h in (2, 1000))
    assert one == two


def test_probabilities_sum_to_one(spark):
    """Over all known words and the unknown event, after a text's start and after a word."""
    train = [(i, t) for i, t in ((i, f"a b{i % 2} c") for i in range(40)) if zlib.crc32(str(i).encode()) % 10]
    ask = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = ["a", "b0", "b1", "c"]
    held = [i for i in range(ask, 90_000) if zlib.crc32(str(i).encode()) % 10 == 0][:30]
    texts = {"": [], "a": [[w] for w in words], "ab": [["a", w] for w in words] + [["a", "never"]], "u": [["never"]]}
    rows, kind = list(train), []
    for k, lists in texts.items():
        for ws in lists or [[]]:
            rows.append((held[len(kind)], " ".join(ws)))
            kind.append((k, tuple(ws)))
    got = {r["doc_id"]: 10 ** r["score"] for r in class_lm.score(
        spark.createDataFrame(rows, "doc_id bigint, text string"), hot=3, core=2, units=32, n_classes=4, passes=2).collect()}
    p = {ws: got[i] for (k, ws), i in zip(kind, held, strict=False)}
    assert 0 < p[()] < 1 and all(0 < x < 1 for x in p.values())
    table_ = np.ones((3, 3))
    mass = np.array([4.1, 5.2, 6.3])
    total = mass.sum() + class_lm.ALPHA
    t = class_lm.transitions(table_, mass, total, 10.0)
    for before in range(3):
        assert abs((10 ** t[before] * mass).sum() + class_lm.ALPHA / total - 1) < 1e-12


def test_exchange_separates_two_languages():
    r = np.random.default_rng(0)
    units, n = 41, 4
    seq = np.concatenate([np.append(r.integers(1, 21, 30) + 20 * (k % 2), 0) for k in range(400)])
    classes = np.arange(units) % n
    classes[0] = 0
    classes[classes == 0] = 1
    classes[0] = 0
    for i in range(8):
        counts = np.zeros((2, units, n))
        np.add.at(counts[0], (seq[:-1], classes[seq[1:]]), 1)
        np.add.at(counts[1], (seq[1:], classes[seq[:-1]]), 1)
        classes = class_lm.sweep(counts, classes, n, i % 2, 2)
    assert not set(classes[1:21]) & set(classes[21:])


def test_awkward_rows(spark):
    rows = [(i, t) for i, t in brute.ROWS]
    got = class_lm.score(brute.docs(spark, rows), hot=500, core=20, units=128, n_classes=8, passes=2).collect()
    assert len(got) == len(rows) and all(np.isfinite(r["score"]) for r in got)
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (0, 1, 2))
    empty = brute.docs(spark, [], extra=False)
    assert class_lm.score(empty, units=64, core=8, n_classes=4, passes=1).count() == 0
