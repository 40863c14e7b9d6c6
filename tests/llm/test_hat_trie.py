import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from docflow.llm import hat_trie, queries
from tests.llm import brute

SMALL = {"max_words": 40, "max_chars": 3000, "max_entries": 20, "burst": 3, "batch_chars": 200, "bits": 1 << 15}


def _plain(rows, top=2000, least=10, longest=3, share=50):
    """Every count in one dictionary."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in cand.items():
        lang, w = p[0], p[1:]
        inside = [b for q, b in cand.items() if len(q) > len(p) and q[0] == lang
                  and any(q[1 + i:1 + i + len(w)] == w for i in range(len(q) - len(w)))]
        if any(100 * b >= share * a for b in inside):
            continue
        cuts = [(10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def _rows(n=400, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "日本", "a-b", "x" * 300, "The"]
    out = []
    for _ in range(n):
        text = " ".join(r.choice(words) if r.random() < .8 else r.choice(["new york city", "Of the", "rare%d" % r.randint(0, 900)])
                        for _ in range(r.randint(0, 25)))
        out.append((r.choice(["en", "en", "fr", None]), text.replace(" of", r.choice([" of", ",of", "\nof", "\t of", "; of"]))))
    return out + [("en", None), ("de", ""), ("de", " \t "), (None, None), ("fr", "lone")]


def _run(spark, rows, **more):
    df = spark.createDataFrame([(i, a, b, 1, 2, "w", 3) for i, (a, b) in enumerate(rows)],
                               "doc_id int, lang string, text string, n int, a int, w1 string, score int").repartition(3)
    out = hat_trie.collocations(df, **more)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(out.schema[c].dataType.simpleString() == "bigint" for c in ("rank", "a", "l", "r", "n", "score"))
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_equals_plain_counts(spark, limits):
    rows = _rows()
    got = _run(spark, rows, **limits)
    assert got == _plain(rows) and {r[0] for r in got} == {"en", "fr", "und"}


def test_other_limits(spark):
    rows = _rows(150, 4)
    assert _run(spark, rows, top=7, least=3, share=80, **SMALL) == _plain(rows, 7, 3, 3, 80)
    assert _run(spark, rows, longest=2, **SMALL) == _plain(rows, longest=2)
    with pytest.raises(ValueError):
        hat_trie.count(spark.createDataFrame([("en", "a b")], "lang string, text string"), longest=4)


def test_awkward_rows(spark):
    rows = [("en", t) for _, t in brute.ROWS]
    assert _run(spark, rows) == _plain(rows)
    assert _run(spark, []) == []


def test_words_that_share_a_hash_are_counted_anew(spark, monkeypatch):
    real, seeds = hat_trie.word_hash, spark.sparkContext.accumulator(0)

    def clash(lang, word, seed):
        if not seed:
            seeds.add(1)
        return 5 if seed == 0 and word in (b"york", b"lone") else real(lang, word, seed)

    monkeypatch.setattr(hat_trie, "word_hash", clash)
    rows = _rows(120, 9)
    assert _run(spark, rows) == _plain(rows)
    assert seeds.value > 0


def test_trie_bursts_and_spills_whole_subtrees():
    r = np.random.default_rng(1)
    ids = r.integers(1, 60, (6000, 2))
    ids[2000:, 1] = ids[2000:, 1] % 10 + 1
    ids[:2000, 0] = 7  # one word that fills containers by itself
    keys = ids[:, 0] << hat_trie.ID_BITS | ids[:, 1]
    trie = hat_trie.HatTrie(2, burst=20)
    for i in range(0, len(keys), 500):
        trie.add(keys[i:i + 500])
    assert len(trie.leaves) > 5 and (np.diff(trie.bounds) > 0).all() and len(trie.bounds) == len(trie.leaves)
    assert all(leaf.used <= 20 for leaf in trie.leaves)
    deep = trie.bounds[(trie.bounds & ((1 << hat_trie.ID_BITS) - 1)) != 0]
    assert len(deep) and set((deep >> hat_trie.ID_BITS).tolist()) == {7}  # only below that word
    want = Counter(keys.tolist())
    got = Counter()
    for upto in (trie.entries // 2, 0):
        for k, n in trie.spill(upto):
            assert (np.diff(k) > 0).all()
            got.update(dict(zip(k.tolist(), n.tolist(), strict=True)))
        assert trie.entries <= upto
    assert got == want


def test_bit_table_holds_all_its_rows(spark):
    r = np.random.default_rng(2)
    rows = r.integers(-2**63, 2**63 - 1, (500, 2))
    df = spark.createDataFrame([(int(a), int(b)) for a, b in rows], "w1 bigint, w2 bigint")
    table = hat_trie.bit_table(df, ["w1", "w2"], 1 << 16)
    assert hat_trie._held(table, [rows[:, 0].copy(), rows[:, 1].copy()], 1 << 16).all()
    other = r.integers(-2**63, 2**63 - 1, (2000, 2))
    assert hat_trie._held(table, [other[:, 0].copy(), other[:, 1].copy()], 1 << 16).mean() < 0.01


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(queries.SQL["op12_hat_trie"]).fetchall())
    assert sorted(map(tuple, queries.op12_hat_trie(spark, sf).collect())) == want and want
