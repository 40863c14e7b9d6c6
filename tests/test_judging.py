import json

import pytest
from pyspark.sql import functions as F

from docflow import contracts
from docflow.operators import completion, judging

GOOD = {"intent_correctness": 5, "citation_grounding": 4, "field_extraction_quality": 4, "conciseness_and_style": 4, "notes": "fine"}


def _parse(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["p"] for r in df.select("i", judging.parse_score(F.col("t")).alias("p")).orderBy("i").collect()]


def test_good_replies(spark):
    odd = GOOD | {"intent_correctness": "3", "citation_grounding": True, "field_extraction_quality": 2.0, "more": [1], "notes": ""}
    a, b = _parse(spark, json.dumps(GOOD, indent=2), json.dumps(odd))
    assert a["error"] is None and tuple(a["score"]) == (5, 4, 4, 4, "fine")
    assert b["error"] is None and tuple(b["score"]) == (3, 1, 2, 4, "")


def test_every_error_of_the_taxonomy(spark):
    texts = {"no_reply": None, "empty": "", "malformed": "no json"}
    for d in contracts.JUDGE_DIMENSIONS:
        texts |= {f"missing:{d}": json.dumps({k: v for k, v in GOOD.items() if k != d}),
                  f"not_integer:{d}": json.dumps(GOOD | {d: 4.5}), f"out_of_range:{d}": json.dumps(GOOD | {d: 6})}
    texts |= {"missing:notes": json.dumps({k: v for k, v in GOOD.items() if k != "notes"}),
              "not_text:notes": json.dumps(GOOD | {"notes": None}), "too_long:notes": json.dumps(GOOD | {"notes": "x" * 401})}
    assert set(texts) == set(judging.ERRORS)
    got = _parse(spark, *texts.values())
    assert [r["error"] for r in got] == list(texts)
    more = _parse(spark, "[1]", "7", "null", "{", json.dumps(GOOD | {"intent_correctness": "five"}), json.dumps(GOOD | {"intent_correctness": 1e300}),
                  json.dumps(GOOD | {"intent_correctness": [5]}), json.dumps(GOOD | {"notes": "x" * 400}))
    assert [r["error"] for r in more] == ["malformed"] * 4 + ["not_integer:intent_correctness", "out_of_range:intent_correctness",
                                                               "not_integer:intent_correctness", None]


def test_judging_over_the_completion_loop(spark):
    responses = spark.createDataFrame([("a", ("nda", 0.5)), ("b", ("msa", 0.7)), ("c", ("other", 0.1))],
                                      "doc_id string, response struct<intent:string,confidence:double>")

    def judge(messages):
        asked = json.loads(messages[1]["content"].split("\n", 1)[1])
        assert messages[0]["content"] == "rubric"
        return {"content": "oops" if asked["intent"] == "other" else json.dumps(GOOD | {"notes": asked["intent"]})}

    judged, messages = judging.judge_replies(responses, completion.from_function(judge), "rubric")
    got = {r["doc_id"]: r for r in judged.collect()}
    assert got["a"]["mean"] == 4.25 and got["b"]["notes"] == "msa" and got["c"]["error"] == "malformed" and got["c"]["mean"] is None
    assert messages.count() == 6
    s = judging.score_summary(judged).first()
    assert (s["n_traces"], s["n_invalid"], s["mean_score"]) == (2, 1, 4.25) and s["citation_grounding"] == pytest.approx(4.0)
    none, _ = judging.judge_replies(responses, lambda m, t: completion.from_function(judge)(m, t).limit(0), "rubric")
    assert {r["error"] for r in none.collect()} == {"no_reply"}
