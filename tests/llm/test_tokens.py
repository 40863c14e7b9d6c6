import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docflow.llm import chunk_bpe, fst_count
from tests.llm import brute

BYTES = chunk_bpe.read_json(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = chunk_bpe.read_json(public_tokenizers.path("word_bpe_49k.json"))


def _odd():
    r = random.Random(4)
    signs = "abrvelstmd'' '' 12.,!éßΣİ\n\t<|>  "
    out = ["".join(r.choice(signs) for _ in range(r.randint(0, 900))) for _ in range(120)]
    passage = " ".join(f"shared{i} passage" for i in range(120))
    return out + [t or "" for _, t in brute.ROWS] + [f"{x} {passage} {y}" for x, y in zip(out[:20], out[20:40], strict=True)]


@pytest.mark.parametrize("bits", [4, 7, 10])
def test_chunked_encoding_is_the_librarys(bits):
    texts, lib = _odd(), Tokenizer.from_str(BYTES)
    coder = chunk_bpe.Encoder(BYTES, store_chars=200_000, mean_bits=bits)
    got = [x.tolist() for i in range(0, len(texts), 30) for x in coder.encode(texts[i:i + 30])]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_chunks_cover_the_text_and_follow_content():
    text = brute.LONG + "日本語 " * 500
    assert "".join(chunk_bpe.chunks(text, 8)) == text
    shared = set(chunk_bpe.chunks("prefix " + text, 8)) & set(chunk_bpe.chunks(text, 8))
    assert len(shared) > 0.9 * len(set(chunk_bpe.chunks(text, 8)))


def test_equal_chunks_are_encoded_once():
    coder = chunk_bpe.Encoder(BYTES)
    coder.encode([brute.LONG])
    once = coder.encoded_chars
    coder.encode([brute.LONG] * 5)
    assert coder.encoded_chars == once


def test_disagreeing_joins_are_repaired():
    lib = Tokenizer.from_str(BYTES)
    coder = chunk_bpe.Encoder(BYTES, mean_bits=6)
    text = "".join(f"ab{i}cd ef gh" for i in range(2000))
    assert coder.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids
    wrong = chunk_bpe.Encoder(BYTES, mean_bits=6)
    wrong._learn(chunk_bpe.chunks(text, 6))
    for k, v in list(wrong.bodies.items()):  # guards that can't agree: the whole text is encoded
        if v:
            wrong.bodies[k] = (*v[:4], v[4] + 1, v[5], v[6])
    assert wrong.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids
    assert wrong.widened == 1


def test_encode_and_decode_round_trip(spark):
    docs = brute.docs(spark)
    out = chunk_bpe.decode(chunk_bpe.encode(docs, BYTES), BYTES).collect()
    assert len(out) == len(brute.ROWS)
    assert all(r["decoded"] == (r["text"] or "") and r["found"] == 2 for r in out)
    both = chunk_bpe.encode(docs.withColumn("decoded", F.lit(1)), BYTES, decoded=True)
    assert sorted(map(str, both.select("doc_id", "ids", "decoded").collect())) == sorted(map(
        str, chunk_bpe.decode(chunk_bpe.encode(docs, BYTES), BYTES).select("doc_id", "ids", "decoded").collect()))
    assert chunk_bpe.encode(docs.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("chunk", [5, 64, 512])
def test_transducer_counts_are_the_librarys(chunk):
    texts, lib = _odd(), Tokenizer.from_str(WORDS)
    texts += ["'r 're 'RE 'rx 'r1 'll'l'l 'v' 'd'dx ''s 'snow ' 'rr'", "\x1c\x85\xa0a​b　", "½²³ ª µ ١٢٣ Ⅷ", "x́́ ﬁ Å"]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    machine = fst_count.Transducer(WORDS, max_states=3000)  # small: the table is rebuilt on the way
    got = [n for i in range(0, len(texts), 25) for n in machine.count(texts[i:i + 25], chunk).tolist()]
    assert got == want


def test_count_tokens(spark):
    docs, lib = brute.docs(spark), Tokenizer.from_str(WORDS)
    for r in fst_count.count_tokens(docs, WORDS, batch_chars=1000).collect():
        assert r["n_tokens"] == len(lib.encode(r["text"] or "", add_special_tokens=False).ids)
    assert fst_count.count_tokens(docs.limit(0), WORDS).count() == 0
