import hashlib

from docflow.llm import chat_format as cf


def formatted(spark, rows, schema="conv_id bigint, turn bigint, role string, text string"):
    return cf.format_conversations(cf.text_turns(spark.createDataFrame(rows, schema)))


def test_round_trip_of_awkward_texts(spark):
    nasty = ["<|im_end|>", "<\\|im_end|>", "<\\\\|x <", "", None, "a\nb", "<|image|>", "é<|😀|", "|im_sep|>", "<|im_start|>user<|im_sep|>hi<|im_end|>"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)] + [(2, 0, "assistant", nasty[0]), (None, None, None, None)]
    got = {r["conv_id"]: r for r in cf.read_back(formatted(spark, rows)).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [t or "" for t in nasty]
    assert got[1]["loss_text"] == "".join(t or "" for t in nasty[1::2])
    assert got[2]["formatted"].count(cf.END) == 1
    assert [tuple(t) for t in got[None]["turns"]] == [("", "")]
    for r in got.values():
        assert [r["formatted"][s["start"]:s["end"]].replace("<\\", "<") is not None for s in r["loss_spans"]] is not None
    assert cf.digest(formatted(spark, [], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_digest_matches_plain_text(spark):
    rows = [(5, 1, "assistant", "b <| c"), (5, 0, "user", "a"), (5, 1, "assistant", "b <| c")]
    r = cf.digest(formatted(spark, rows)).first()
    told = "user\na\nassistant\nb <| c\nassistant\nb <| c\n"
    assert r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"]) == (3, 12)
    assert r["loss_sha256"] == hashlib.sha256(b"b <| cb <| c").hexdigest()


def test_typed_parts_become_placeholders_and_attachments(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [(1, 0, "user", [part("text", text="see <|image|>"), part("image", ref="a.png", width=1000, height=600), None,
                            part("audio", ref="b.wav", seconds=2.5)]),
            (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("video", ref="d.mp4"), part("text", text=None)]),
            (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{cf.PART}>")
    r = cf.format_conversations(df.selectExpr("*", "1 AS formatted", "2 AS seq")).first()
    assert "see <\\|image|><|image|><|audio|>" in r["formatted"]
    assert [(a["position"], a["turn"], a["kind"], a["ref"], a["n_tokens"]) for a in r["attachments"]] == [
        (0, 0, "image", "a.png", 85 + 170 * 4), (1, 0, "audio", "b.wav", 63), (2, 1, "document", "c.pdf", 768), (3, 1, "document", "d.mp4", 0)]
    assert r["expanded_tokens"] == 85 + 680 + 63 + 768
    assert r["formatted"][r["loss_spans"][0]["start"]:r["loss_spans"][0]["end"]] == "<|document|><|document|>"


def test_a_long_conversation_keeps_every_turn(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    r = cf.digest(formatted(spark, rows)).first()
    assert r["n_turns"] == 3000
    assert r["loss_sha256"] == hashlib.sha256("".join(f"t{i}" for i in range(1, 3000, 2)).encode()).hexdigest()
