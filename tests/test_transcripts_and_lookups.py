import json

import pytest
from pyspark.sql import functions as F

from docflow.operators import lookups, transcripts
from tests.conftest import rows

COMPLETION = ("request_id string, turn int, content string, "
              "tool_calls array<struct<id:string,name:string,arguments:string>>, "
              "tokens_in int, tokens_out int, model string, finish_reason string")

VALID = json.dumps({
    "doc_id": "ignored", "intent": "nda", "confidence": 0.9,
    "reasoning": "Mutual confidentiality obligations are stated.",
    "extracted_fields": [{"name": "term", "value": "2 years",
                          "citations": [{"chunk_id": "d_chunk_0000", "quote": "two (2) years"}]}],
    "citations": [{"chunk_id": "d_chunk_0000", "quote": "confidential information"}],
})


def call(name, args, i="c"):
    return (i, name, args)


def completions(spark, data):
    return spark.createDataFrame(data, COMPLETION)


def test_direct_answer_and_one_tool_round(spark):
    c = completions(spark, [
        ("direct", 0, VALID, [], 100, 50, "gpt-4o", "stop"),
        ("tool", 0, None, [call("lookup_clause_library", '{"query": "termination"}')], 100, 50, "", "tool_calls"),
        ("tool", 1, VALID, [], 120, 60, "gpt-4o-mini", "stop"),
    ])
    f = {r.request_id: r for r in transcripts.fold_transcripts(c).collect()}
    assert f["direct"].llm_calls == 1 and f["direct"].turns == 1 and f["direct"].fold_status == "answered"
    assert f["tool"].llm_calls == 2 and f["tool"].turns == 2
    assert f["tool"].tools_used == ["lookup_clause_library"]
    assert (f["tool"].tokens_in, f["tool"].tokens_out) == (220, 110)
    assert f["tool"].model == "gpt-4o-mini"          # first non-empty model


def test_cap_reached_with_tool_pending_and_exhausted(spark):
    tc = [call("check_counterparty_history", '{"entity_name": "Acme Corp"}')]
    c = completions(spark, [(f"cap", t, None, tc, 1, 1, "m", "tool_calls") for t in range(6)]
                    + [("short", 0, None, tc, 1, 1, "m", "tool_calls")])
    f = {r.request_id: r for r in transcripts.fold_transcripts(c, max_turns=4).collect()}
    assert f["cap"].llm_calls == 4 and f["cap"].pending_tools and f["cap"].fold_status == "cap_reached"
    assert f["cap"].turns == 5
    assert f["short"].fold_status == "exhausted"


def test_unknown_tool_not_counted_but_invalid_args_are(spark):
    c = completions(spark, [
        ("r", 0, None, [call("web_search", "{}"), call("lookup_clause_library", '{"query": "ab"}')],
         1, 1, "m", "tool_calls"),
        ("r", 1, VALID, [], 1, 1, "m", "stop")])
    f = transcripts.fold_transcripts(c).first()
    assert f.tools_used == ["lookup_clause_library"] and f.turns == 2
    d = {r.name: r.error for r in transcripts.tool_dispatch(c).collect()}
    assert d["web_search"] == "unknown tool: web_search"
    assert d["lookup_clause_library"] == "invalid arguments: query"


@pytest.mark.parametrize("args,err", [
    ('{"query": "termination"}', None), ('{"query": "termination", "top_k": 11}', "invalid arguments: top_k"),
    ('{"query": "termination", "top_k": "3"}', None), ("not json", "invalid arguments: malformed JSON"),
    ("", "invalid arguments: malformed JSON"), ('{"query": "ok ok", "extra": 1}', None),
])
def test_tool_argument_validation(spark, args, err):
    df = spark.createDataFrame([("lookup_clause_library", args)], "n string, a string")
    assert df.select(lookups.validate_tool_args(F.col("n"), F.col("a")).alias("e")).first().e == err


@pytest.mark.parametrize("content,err", [
    (VALID, None), ("", "empty"), (None, "empty"), ("{not json", "malformed"),
    (json.dumps({**json.loads(VALID), "surprise": 1}), "unknown_key"),
    (json.dumps({**json.loads(VALID), "confidence": 1.5}), "schema:confidence"),
    (json.dumps({**json.loads(VALID), "intent": "poem"}), "schema:intent"),
    (json.dumps({**json.loads(VALID), "reasoning": "short"}), "schema:reasoning"),
    (json.dumps({**json.loads(VALID), "extracted_fields": [{"name": "x", "value": "y", "citations": []}]}),
     "schema:extracted_fields"),
])
def test_strict_parse(spark, content, err):
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(transcripts.parse_response(F.col("c"))["error"].alias("e")).first().e == err


def test_resolve_statuses_and_cost(spark):
    c = completions(spark, [
        ("ok", 0, VALID, [], 1000, 1000, "gpt-4o", "stop"),
        ("bad", 0, "prose", [], 1, 1, "", "stop"),
        ("cite", 0, VALID.replace("d_chunk_0000", "zzz"), [], 1, 1, "gpt-4o", "stop"),
        ("unsafe", 0, VALID.replace("Mutual confidentiality", "We will kill the deal; mutual"), [], 1, 1,
         "mystery-model", "stop"),
    ])
    passages = spark.createDataFrame(
        [(r, "d_chunk_0000", "All Confidential Information is kept for two (2) years.")
         for r in ("ok", "bad", "cite", "unsafe")], "request_id string, chunk_id string, text string")
    out = {r.request_id: r for r in transcripts.resolve(
        transcripts.fold_transcripts(c), passages, lookups.price_table(spark)).collect()}
    assert out["ok"].status == "ok" and out["ok"].cost_usd == pytest.approx(0.005 + 0.015)
    assert out["bad"].status == "invalid_response" and out["bad"].model_version == "unknown"
    assert out["cite"].status == "citation_violation" and out["cite"].detail == "unknown_chunk"
    assert out["unsafe"].status == "unsafe_output"
    assert out["unsafe"].cost_usd == pytest.approx(0.005 / 1000 + 0.015 / 1000)   # unknown -> default


def test_cost_zero_and_output_pricier(spark):
    df = spark.createDataFrame([("gpt-4o", 0, 0), ("gpt-4o", 1000, 0), ("gpt-4o", 0, 1000)],
                               "model string, tokens_in int, tokens_out int")
    got = [r.cost_usd for r in lookups.with_cost(df, lookups.price_table(spark)).orderBy("tokens_in", "tokens_out").collect()]
    # rows sorted (in, out): (0, 0), (0, 1000), (1000, 0): output tokens cost more
    assert got[0] == 0.0 and got[1] > got[2]


def test_counterparty_lookup(spark):
    directory = spark.createDataFrame([("ACME Corp", "2019-04-11", 3)],
                                      "entity_name string, first_seen string, active_contracts int")
    calls = spark.createDataFrame([(1, "acme corp"), (2, "Nobody Inc")], "id int, entity_name string")
    got = rows(lookups.counterparty_lookup(calls, directory), "id", "status", "known_name")
    assert got == [(1, "known", "ACME Corp"), (2, "unknown", None)]


def py_clause(q, lib, k):
    scored = [(sum(1 for t in q.lower().split() if t in text.lower()), pos, cid) for cid, pos, text in lib]
    scored.sort(key=lambda x: (-x[0], x[1]))
    return [(cid, s) for s, _, cid in scored[:k]]


def test_clause_lookup_matches_python_model(spark):
    lib = [("t", 0, "Either party may terminate upon thirty (30) days notice."),
           ("p", 1, "Payment shall be due within thirty (30) days of invoice."),
           ("x", 2, "Prices may be increased once per calendar year."),
           ("l", 3, "In no event shall liability exceed the fees paid."),
           ("t2", 4, "Either party may terminate upon thirty (30) days notice.")]
    queries = [("q1", "terminate thirty days", 3), ("q2", "zzz", 2), ("q3", "a a e", 4), ("q4", "price", None)]
    ldf = spark.createDataFrame(lib, "clause_id string, position int, text string")
    qdf = spark.createDataFrame(queries, "query_id string, query string, top_k int")
    got = {}
    for r in lookups.clause_lookup(qdf, ldf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.clause_id, r.score))
    for qid, q, k in queries:
        assert got[qid] == py_clause(q, lib, k or 3), qid


def test_clause_lookup_honours_any_top_k_and_slices(spark):
    lib = spark.createDataFrame([(i, i, f"clause {i % 5} text") for i in range(40)], "clause_id int, position int, text string")
    q = spark.createDataFrame([("q", "clause 3", 15), ("r", "3", 40)], "query_id string, query string, top_k int")
    whole = rows(lookups.clause_lookup(q, lib))
    assert whole == rows(lookups.clause_lookup(q, lib, max_library_bytes=2000)) and len(whole) == 55


def test_directory_entries_that_differ_in_case_are_one(spark):
    directory = spark.createDataFrame([("ACME", 2), ("acme", 1)], "entity_name string, n int")
    calls = spark.createDataFrame([(1, "Acme")], "id int, entity_name string")
    assert rows(lookups.counterparty_lookup(calls, directory), "id", "known_name", "n") == [(1, "ACME", 2)]


def test_chat_messages_long_form(spark):
    conv = spark.createDataFrame([(1, 0, "system", "be brief"), (1, 1, "user", "hi"),
                                  (1, 2, "assistant", None), (2, 0, "user", "only")],
                                 "conv_id int, turn int, role string, text string")
    m = transcripts.chat_messages(conv)
    assert rows(m, "conv_id", "turn", "line")[:3] == [(1, 0, "system: be brief"), (1, 1, "user: hi"),
                                                      (1, 2, "assistant: ")]


GOOD = {"doc_id": "d", "intent": "other", "confidence": 0.5, "reasoning": "long enough text"}
CITE = {"chunk_id": "c", "quote": "q"}
PARSED = [
    ("", "empty"), (None, "empty"), ("words", "malformed"), ("[]", "malformed"), ("null", "malformed"), ({}, "schema:doc_id"),
    (GOOD, None), (GOOD | {"x": 1}, "unknown_key"), (GOOD | {"doc_id": 3}, "schema:doc_id"), (GOOD | {"doc_id": None}, "schema:doc_id"),
    (GOOD | {"intent": "poem"}, "schema:intent"), (GOOD | {"intent": None}, "schema:intent"), (GOOD | {"confidence": "0.5"}, None),
    (GOOD | {"confidence": 1}, None), (GOOD | {"confidence": 1.01}, "schema:confidence"), (GOOD | {"confidence": "x"}, "schema:confidence"),
    (GOOD | {"confidence": [1]}, "schema:confidence"), (GOOD | {"reasoning": "short"}, "schema:reasoning"), (GOOD | {"reasoning": 1234567890123}, "schema:reasoning"),
    (GOOD | {"citations": None}, "schema:citation"), (GOOD | {"citations": ["x"]}, "schema:citation"), (GOOD | {"citations": [CITE | {"more": 1}]}, None),
    (GOOD | {"citations": [{"chunk_id": "c"}]}, "schema:citation"), (GOOD | {"citations": [CITE | {"quote": ""}]}, "schema:citation"),
    (GOOD | {"citations": [CITE | {"quote": "q" * 400}]}, None), (GOOD | {"citations": [CITE | {"quote": "q" * 401}]}, "schema:citation"),
    (GOOD | {"extracted_fields": "abc"}, "schema:extracted_fields"), (GOOD | {"extracted_fields": [{"name": "n", "value": "v", "citations": []}]}, "schema:extracted_fields"),
    (GOOD | {"extracted_fields": [{"name": "n", "value": 3, "citations": [CITE]}]}, "schema:extracted_fields"),
    (GOOD | {"extracted_fields": [{"name": "n", "value": "v", "citations": [CITE]}]}, None), (GOOD | {"tools_used": ["a", 1]}, "schema:tools_used"),
    (GOOD | {"tools_used": ["a"]}, None), (GOOD | {"model_version": 1}, "schema:model_version"), (GOOD | {"tokens_in": "abc"}, "schema:tokens"),
    (GOOD | {"tokens_in": 1.5}, "schema:tokens"), (GOOD | {"tokens_in": "12", "tokens_out": 3.0}, None), (GOOD | {"latency_ms": None}, "schema:latency_ms"),
]


def test_strict_parse_checks_types_on_the_json_itself(spark):
    told = [(i, c if c is None or isinstance(c, str) else json.dumps(c)) for i, (c, _) in enumerate(PARSED)]
    got = spark.createDataFrame(told, "i int, c string").select("i", "c", transcripts.parse_response(F.col("c")).alias("p")).collect()
    assert {r.c: r.p.error for r in got} == {c: PARSED[i][1] for i, c in told}
    best = next(r.p.response for r in got if PARSED[r.i][0] == GOOD | {"extracted_fields": [{"name": "n", "value": "v", "citations": [CITE]}]})
    assert best.extracted_fields[0].citations[0].quote == "q" and best.citations == []


def _turns(spark, rows_):
    calls = lambda cs: [(f"id{i}", n, json.dumps(a) if isinstance(a, dict) else a) for i, (n, a) in enumerate(cs)]
    return spark.createDataFrame([(r, t, c, calls(cs), 1, 1, "m", "stop") for r, t, c, cs in rows_],
                                 "request_id string, turn int, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, "
                                 "tokens_in int, tokens_out int, model string, finish_reason string")


def _registry(spark):
    lib = spark.createDataFrame([(1, 0, "payment due"), (2, 1, "liability cap"), (3, 2, "payment terms")], "clause_id int, position int, text string")
    return transcripts.tool_registry(lib, spark.createDataFrame([("Acme", 3)], "entity_name string, contracts int"))


def test_tools_run_and_messages_are_listed_in_order(spark):
    asked = [("lookup_clause_library", {"query": "payment", "top_k": 2}), ("check_counterparty_history", {"entity_name": "ACME"}),
             ("check_counterparty_history", {"entity_name": "nobody"}), ("lookup_clause_library", "{broken"), ("web", {})]
    turns = _turns(spark, [("r", 0, "thinking", asked), ("r", 0, "thinking", asked), ("r", 1, "done", []),
                           *(("cap", t, None, [("web", {})]) for t in range(6))])
    results = transcripts.tool_results(turns, _registry(spark))
    got = {(r.request_id, r.turn, r.pos): json.loads(r.result) for r in results.collect()}
    assert [e["clause_id"] for e in got["r", 0, 0]["results"]] == [1, 3]
    assert got["r", 0, 1] == {"status": "known", "known_name": "Acme", "contracts": 3}
    assert got["r", 0, 2] == {"status": "unknown", "entity_name": "nobody"}
    assert got["r", 0, 3]["error"].startswith("invalid arguments") and got["r", 0, 4] == {"error": "unknown tool: web"}
    assert len(got) == 5 + 4        # a re-delivered turn counts once; the cap holds
    prompts = spark.createDataFrame([("r", "the prompt"), ("cap", "p2")], "request_id string, prompt string")
    m = transcripts.request_messages(prompts, turns, results, "sys")
    mine = m.where("request_id = 'r'").orderBy("turn", "pos").collect()
    assert [x.role for x in mine] == ["system", "user", "assistant"] + ["tool"] * 5
    assert [x.tool_call_id for x in mine[3:]] == [f"id{i}" for i in range(5)] and mine[2].tool_calls[0].name == "lookup_clause_library"
    last = m.where("request_id = 'cap'").orderBy("turn", "pos").collect()[-1]
    assert last.role == "system" and last.content == transcripts.CAP_MESSAGE
    said = transcripts.complete(m, lambda msgs: {"content": f"{len(msgs)} {msgs[-1]['role']}", "model": "own", "tokens_in": 2})
    assert rows(said, "request_id", "turn", "content", "model") == [("cap", 4, "11 system", "own"), ("r", 1, "8 tool", "own")]


def test_redelivered_turns_pick_one_copy_by_rule(spark):
    a = _turns(spark, [("r", 0, "b", []), ("r", 0, "a", []), ("r", 0, "b", [])])
    for df in (a, a.orderBy("content"), a.orderBy(F.desc("content"))):
        assert rows(transcripts.fold_transcripts(df), "answer", "llm_calls") == [("a", 1)]
    assert transcripts.tool_dispatch(_turns(spark, [("r", 0, "", [("web", {})])] * 2)).count() == 1


def test_a_null_passage_supports_no_quote(spark):
    from docflow.operators import guardrails

    resp = spark.createDataFrame([("r", "nda", [("c", "quote")], None)],
                                 "request_id string, intent string, citations array<struct<chunk_id:string,quote:string>>, "
                                 "extracted_fields array<struct<name:string,value:string,citations:array<struct<chunk_id:string,quote:string>>>>")
    p = spark.createDataFrame([("r", "c", None)], "request_id string, chunk_id string, text string")
    assert guardrails.citation_verdict(resp, p).first().violation == "quote_not_found"


def test_entries_that_hold_the_same_asked_tokens_are_one_kind(spark):
    import random

    rng = random.Random(3)
    parts = ["ab", "abc", "Été", "x", "bca", "ring", "spring", "a#"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    lib = [(i, i // 2, f"{word()} {word()}\t{word()} only{i}") for i in range(600)]
    queries = [(f"q{i}", "  ".join(word() for _ in range(rng.randint(0, 6))), 3) for i in range(30)] + [("n", None, 3)]
    ldf = spark.createDataFrame(lib, "clause_id int, position int, text string")
    qdf = spark.createDataFrame(queries, "query_id string, query string, top_k int")
    got = {}
    for r in lookups.clause_lookup(qdf, ldf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.clause_id, r.score))
    for qid, q, k in queries:
        scored = sorted((-sum(t in text.lower() for t in (q or "").lower().split()), pos, cid) for cid, pos, text in lib)
        assert got[qid] == [(cid, -s) for s, _, cid in scored[:k]], qid
    asked = spark.createDataFrame([("ring",), ("x",), ("zz",)], "tok string")
    kinds = lookups.entry_kinds(asked, ldf, 3).collect()
    assert {tuple(r.held) for r in kinds} == {(), ("ring",), ("x",), ("ring", "x")} and len(kinds) == 12


def test_completions_of_few_bytes_run_on_several_tasks(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(200)], "request_id bigint, prompt string")
    m = transcripts.opening_messages(prompts.groupBy("request_id").agg(F.min("prompt").alias("prompt")), "s")
    said = transcripts.complete(m, lambda msgs: {"content": msgs[1]["content"] + msgs[0]["role"]})
    got = said.withColumn("p", F.spark_partition_id()).collect()
    assert {r.request_id: r.content for r in got} == {i: f"p{i}system" for i in range(200)}
    assert len({r.p for r in got}) > 4


def test_queries_of_one_token_read_lists_and_are_scored_by_no_block(spark, monkeypatch):
    import random

    rng = random.Random(5)
    parts = ["ab", "abc", "Été", "x", "bca", "ring", "a#"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    lib = [(i // 3, i // 4, f"{word()} {word()} w{i % 70}") for i in range(200)]      # keys repeat
    lib += [(99, 2, "ab ab"), (99, 2, "ab ab"), (98, 2, None), (97, 60, "only"), (97, 60, "only ONLYx")]
    asked = ["ab", "ab AB  ab", "été", "only", "nowhere", "", None, "w1", "#", *(word() for _ in range(20))]
    queries = [(i, text, k) for i, (text, k) in enumerate((t, k) for t in asked for k in (None, 1, 5, 0))]
    ldf = spark.createDataFrame(lib, "clause_id int, position int, text string")
    qdf = spark.createDataFrame(queries, "query_id int, query string, top_k int")
    monkeypatch.setattr(lookups, "ClauseSlice", None)
    monkeypatch.setattr(lookups, "slices_of", None)
    got = {}
    for r in lookups.clause_lookup(qdf, ldf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.clause_id, r.score))
    for qid, q, k in queries:
        scored = sorted((-sum(t in (text or "").lower() for t in (q or "").lower().split()), pos, cid) for cid, pos, text in lib)
        assert got.get(qid, []) == [(cid, -s) for s, _, cid in scored[:3 if k is None else k]], (qid, q, k)
    assert lookups.clause_lookup(qdf.limit(0), ldf).count() == 0 and lookups.clause_lookup(qdf, ldf.limit(0)).count() == 0


def test_queries_of_one_and_of_several_tokens_are_ranked_together(spark):
    lib = spark.createDataFrame([(1, 0, "payment due"), (2, 1, "cap"), (3, 2, "payment terms")], "clause_id int, position int, text string")
    q = spark.createDataFrame([("q", "payment"), ("q", "terms payment"), ("r", "cap")], "query_id string, query string")
    got = [(r.query_id, r.clause_id, r.score, r.rank) for r in lookups.clause_lookup(q, lib).orderBy("query_id", "rank").collect()]
    assert got == [("q", 3, 2, 1), ("q", 1, 1, 2), ("q", 1, 1, 3), ("r", 2, 1, 1), ("r", 1, 0, 2), ("r", 3, 0, 3)]
