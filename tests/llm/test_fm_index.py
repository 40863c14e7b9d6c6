import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.llm import fm_index as fm
from tests.llm import brute


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=5))
def test_search_and_locate_equal_scanning(symbols, phrases):
    s = np.array([*symbols, 0], np.int64)
    index, width = fm.FMIndex(s, step=3), max(map(len, phrases))
    table = np.array([[-1] * (width - len(p)) + p for p in phrases])
    lo, hi = index.search(table)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(s)) if s[i:i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def _bench(spark):
    items = [(1, " ".join(f"word{i} stays" for i in range(3, 15))), (2, "A b, C!"), (3, None), (4, ""), (5, "one"),
             (6, "w5 abc5 w6 abc6 w7 abc7 w8 abc8 w9 abc9 w10 abc10"), (6, "a b c"), (None, "one")]
    return items, spark.createDataFrame(items, "item_id bigint, text string")


def _plain(items):
    phrases = {}
    for item, text in items:
        w = brute.alnum_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            phrases.setdefault(tuple(w[i:i + 10]), set()).update({item} - {None})
    return phrases


def test_hits_equal_brute_force_for_any_block_and_shard_size(spark):
    items, bench = _bench(spark)
    phrases, docs = _plain(items), brute.docs(spark)
    for block, shard in ((500_000, 2_000_000), (3, 50)):
        rows = fm.find_phrases(docs, fm.windows(bench), shard, block).collect()
        assert len(rows) == len(brute.ROWS)
        for r in rows:
            f = r["found"]
            got = f["n_words"], sum(w["end"] - w["start"] for w in f["words"]), set(f["items"])
            assert got == brute.window_hits(r["text"], phrases), r["doc_id"]


def test_decontaminate_cuts_every_occurrence_and_keeps_the_rest(spark):
    items, bench = _bench(spark)
    phrases, docs = _plain(items), brute.docs(spark)
    out = {(r["doc_id"], r["text"]): r for r in fm.decontaminate(docs, bench).collect()}
    assert fm.decontaminate(docs, bench).columns == docs.columns
    for i, text in brute.ROWS:
        n, hit, _ = brute.window_hits(text, phrases)
        if not hit:
            assert (i, text) in out
    assert not any(k[0] in (5, 6) for k in out)  # "one" alone is an item
    cut = next(r for (i, _), r in out.items() if i == 7)
    assert brute.window_hits(cut["text"], phrases)[1] == 0 and cut["n_chars"] == len(cut["text"])
    assert cut["text"].startswith("word0 stays") and cut["text"].endswith("word59 stays")


def test_empty_tables(spark):
    _, bench = _bench(spark)
    docs = brute.docs(spark)
    assert fm.decontaminate(docs.limit(0), bench).count() == 0
    assert fm.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_random_texts_with_copies(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 120))) for _ in range(60)]
    texts += texts[:20]
    items = [(i, " ".join(r.choice("abcd") for _ in range(r.choice([3, 6, 11])))) for i in range(20)] + [(99, texts[3])]
    phrases = _plain(items)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in fm.find_phrases(docs, fm.windows(spark.createDataFrame(items, "item_id bigint, text string")), 300).collect():
        f = row["found"]
        assert (f["n_words"], sum(w["end"] - w["start"] for w in f["words"]), set(f["items"])) == brute.window_hits(row["text"], phrases)
