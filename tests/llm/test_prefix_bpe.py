import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from docflow.llm import prefix_bpe, queries
from tests.llm import brute

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = prefix_bpe.read_model(PATH)
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


def _odd():
    r = random.Random(7)
    signs = [*"abehtrs ▁  \n\t<s>/0xA'é日本語😀İß\x00\x0b", "the ", "  ", "ing", "<s>", "<0x0A>", "</s>"]
    out = ["".join(r.choice(signs) for _ in range(r.randint(0, 250))) for _ in range(1500)]
    out += ["a" * 9000, "unbelievably" * 90, "".join(r.choice("abcdeing") for _ in range(4000)), " " * 999, "▁" * 77, "", "=-" * 900, "\n", "aab" * 700]
    out.append("".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(3000)))
    return out + [t or "" for _, t in brute.ROWS]


def _lists(flat, counts):
    flat, at, out = flat.tolist(), 0, []
    for n in counts.tolist():
        out.append(flat[at:at + n])
        at += n
    return out


@pytest.mark.parametrize("limits", [{}, {"store_chars": 500, "max_pairs": 50}])
def test_ids_are_the_librarys(limits):
    texts, coder = _odd(), prefix_bpe.Encoder(MODEL, **limits)
    got = [x for i in range(0, len(texts), 40) for x in _lists(*coder.encode(texts[i:i + 40]))]
    assert got == LIB.encode(texts)
    decoder = prefix_bpe.Decoder(MODEL)
    assert [decoder.decode(x) for x in got] == LIB.decode(got)


def test_each_prefix_has_the_last_token_of_its_own_encoding():
    coder = prefix_bpe.Encoder(MODEL)
    words = sorted(["▁international", "▁internal", "▁unbelievably", "zzzzzz", "▁▁▁▁▁▁▁", "<0x0A>", "▁", "é"])
    table = coder.last_tokens(words)
    for word, last in zip(words, table.tolist(), strict=True):
        assert last[:len(word)] == coder._last_of_long(word)
        for n in range(1, len(word) + 1):
            symbols = list(word[:n])
            list(coder._merge(symbols))  # the plain merges of the prefix alone
            assert coder.text[last[n - 1]] == symbols[-1]


def test_compatible_pairs_are_those_that_plain_merges_leave():
    coder, r = prefix_bpe.Encoder(MODEL), random.Random(1)
    tokens = [i for i in range(259, 4000) if coder.text[i].isalpha()]
    seen = set()
    for _ in range(4000):
        a, b = r.choice(tokens), r.choice(tokens)
        symbols = list(coder.text[a] + coder.text[b])
        list(coder._merge(symbols))
        seen.add(symbols == [coder.text[a], coder.text[b]])
        assert coder.compatible(a, b) == (symbols == [coder.text[a], coder.text[b]])
    assert seen == {True, False}


def test_decoding_any_ids_is_the_librarys():
    r, decoder = random.Random(3), prefix_bpe.Decoder(MODEL)
    ids = [[r.choice([0, 1, 2, r.randint(3, 258), r.randint(3, 258), r.randint(259, 31999), 259, 28705])
            for _ in range(r.randint(0, 9))] for _ in range(5000)]
    assert [decoder.decode(x) for x in ids] == LIB.decode(ids)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        prefix_bpe.Vocabulary(b"")


def test_round_trip_over_awkward_rows(spark):
    docs = brute.docs(spark)
    out = prefix_bpe.decode(prefix_bpe.encode(docs, MODEL, batch_chars=1000), MODEL)
    assert set(out.columns) == {*docs.columns, "ids", "decoded"}
    rows = out.collect()
    assert len(rows) == len(brute.ROWS)
    for x in rows:
        want = LIB.encode(x["text"] or "")
        assert x["ids"] == want and x["decoded"] == LIB.decode(want) and x["found"] == 2
    both = prefix_bpe.encode(docs, MODEL, decoded=True).select(*out.columns)
    assert sorted(map(str, both.collect())) == sorted(map(str, rows))
    assert prefix_bpe.encode(docs.limit(0), MODEL, decoded=True).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op13_prefix_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for x in rows:
        ids = LIB.encode(texts[x["doc_id"]])
        assert x["n_tokens"] == len(ids)
        assert x["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
