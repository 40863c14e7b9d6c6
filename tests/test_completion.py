import uuid

import pytest
from pyspark.sql import functions as F

from docflow.operators import completion, transcripts

TURN = ("request_id bigint, turn int, content string, tool_calls array<struct<id:string,name:string,arguments:string>>, "
        "tokens_in int, tokens_out int, model string, finish_reason string")


def _call(i, name="check_counterparty_history", arguments='{"entity_name": "Acme"}'):
    return (f"c{i}", name, arguments)


def _registry(spark):
    library = spark.createDataFrame([(1, 1, "late payment interest")], "clause_id bigint, position bigint, text string")
    directory = spark.createDataFrame([("Acme", 3)], "entity_name string, active_contracts int")
    return transcripts.tool_registry(library, directory)


def _prompts(spark, n=4):
    return spark.createDataFrame([(i, f"prompt {i}") for i in range(n)], "request_id bigint, prompt string")


RECORDED = [
    (0, 0, "done at once", [], 5, 6, "m", "stop"),
    (1, 0, None, [_call(1), _call(2, "web_search")], 1, 1, "", "tool_calls"), (1, 1, "after tools", None, 2, 2, "m2", "stop"),
    *[(2, t, f"turn {t}", [_call(t)], 1, 1, "m", "tool_calls") for t in range(6)],
    (3, 0, "", [_call(9, "lookup_clause_library", "not json")], 1, 1, "m", "tool_calls"),
]


def test_loop_folds_like_the_recorded_turns(spark):
    recorded = spark.createDataFrame(RECORDED, TURN)
    done = completion.complete_requests(_prompts(spark), completion.from_recorded(recorded), _registry(spark), "sys")
    got = {r["request_id"]: r for r in transcripts.fold_transcripts(done.completions).collect()}
    want = {r["request_id"]: r for r in transcripts.fold_transcripts(recorded).collect()}
    assert got == want and done.rounds == 4
    assert [got[i]["fold_status"] for i in range(4)] == ["answered", "answered", "cap_reached", "exhausted"]
    rows = {i: [(r["role"], r["content"]) for r in done.messages.where(F.col("request_id") == i).orderBy("turn", "pos").collect()]
            for i in range(4)}
    assert rows[0] == [("system", "sys"), ("user", "prompt 0")]
    assert [r for r, _ in rows[1]] == ["system", "user", "assistant", "tool", "tool"]
    assert '"active_contracts":3' in rows[1][3][1] and "unknown tool: web_search" in rows[1][4][1]
    assert rows[2][-1] == ("system", transcripts.CAP_MESSAGE) and [r for r, _ in rows[2]].count("assistant") == 4
    assert "error" in rows[3][-1][1]
    whole = transcripts.request_messages(_prompts(spark), recorded, transcripts.tool_results(recorded, _registry(spark)), "sys")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole) == key(done.messages)


def test_only_open_requests_are_asked(spark):
    recorded, asked = spark.createDataFrame(RECORDED, TURN), []
    replay = completion.from_recorded(recorded)

    def completer(messages, turn):
        asked.append(sorted(r[0] for r in messages.select("request_id").distinct().collect()))
        return replay(messages, turn)

    completion.complete_requests(_prompts(spark), completer, _registry(spark), "sys")
    assert asked == [[0, 1, 2, 3], [1, 2, 3], [2], [2]]


def test_a_restarted_job_takes_its_rounds_from_storage(spark):
    recorded, job, calls = spark.createDataFrame(RECORDED, TURN), f"loop-{uuid.uuid4().hex}", []
    replay = completion.from_recorded(recorded)

    def broken(messages, turn):
        calls.append(turn)
        if turn == 2:
            raise RuntimeError("the service went away")
        return replay(messages, turn)

    with pytest.raises(RuntimeError):
        completion.complete_requests(_prompts(spark), broken, _registry(spark), "sys", job=job)
    done = completion.complete_requests(_prompts(spark), replay, _registry(spark), "sys", job=job)
    assert done.reused == [0, 1] and done.rounds == 4 and calls == [0, 1, 2]
    assert done.completions.count() == 8


def test_a_function_as_completer_and_edge_cases(spark):
    def fn(messages):
        said = sum(m["role"] == "assistant" for m in messages)
        return {"content": f"saw {len(messages)}", "tool_calls": [] if said else [
            {"id": "x", "name": "check_counterparty_history", "arguments": '{"entity_name": "nobody"}'}], "tokens_in": 1}

    run = lambda p, **k: completion.complete_requests(p, completion.from_function(fn), _registry(spark), "sys", **k)
    done = run(_prompts(spark, 3))
    assert [r["content"] for r in done.completions.where("turn = 1").collect()] == ["saw 4"] * 3
    assert {r["result"] for r in done.results.collect()} == {'{"status":"unknown","entity_name":"nobody"}'}
    assert run(_prompts(spark, 1), max_turns=1).messages.where("role = 'system'").count() == 2
    none = run(_prompts(spark).limit(0))
    assert none.completions.count() == 0 and none.results.count() == 0 and none.messages.count() == 0
    with pytest.raises(ValueError):
        run(_prompts(spark), max_turns=0)
