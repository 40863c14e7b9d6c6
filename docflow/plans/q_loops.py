"""Registered queries: the completion loop (U4, P2, JN7, W7) and the judge."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docflow import contracts
from docflow.operators import completion, judging, lookups, transcripts
from docflow.plans import q_transcripts as qt
from docflow.plans.registry import QUERIES, register
from docflow.session import table

SYSTEM = "Answer from the passages."


def _asks(turns):
    return turns.select("request_id").distinct().select(
        "request_id", F.concat(F.lit("Request "), F.col("request_id").cast("string")).alias("prompt"))


def _with_sizes(done):
    """The folded completions, with the sizes of each request's message list and results."""
    folded = transcripts.fold_transcripts(done.completions).withColumn("tools_used", F.array_join("tools_used", ","))
    size = done.messages.groupBy("request_id").agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("role") == "tool").alias("n_results"))
    return folded.join(size, "request_id").withColumn("rounds", F.lit(done.rounds).cast("bigint"))


@register("completion_loop", "U4 P2 JN7 W7 A8 A9 A10 A11", f"""
WITH {qt._COMPLETIONS_SQL},
m AS (SELECT request_id, count_if(has_tools) AS asked, count_if(has_tools AND t = 3) AS capped FROM k GROUP BY request_id)
SELECT request_id, llm_calls, answer, pending_tools, tools_used, turns, tokens_in, tokens_out,
       0.0::DOUBLE AS latency_ms, model, fold_status, (2 + 2 * asked + capped)::BIGINT AS n_messages,
       asked::BIGINT AS n_results, (SELECT max(llm_calls) FROM f)::BIGINT AS rounds
FROM f JOIN m USING (request_id)""")
def completion_loop(spark, sf):
    """The recorded turns as the completer's answers, all conversations: the loop's turns fold
    to what the recorded ones fold to."""
    turns = qt._tool_turns(spark, sf)
    done = completion.complete_requests(_asks(turns), completion.from_recorded(turns), qt._registry(spark, sf), SYSTEM)
    return _with_sizes(done)


@register("reason_loop", "P2 P3 U4 V3 A14 V10 J12 J8 U-5", QUERIES["reason_resolve"].sql)
def reason_loop(spark, sf):
    """Loop, fold, parse, citations, safety and cost: the recorded JSON answers of every kind."""
    turns = qt.answered(spark, sf)
    done = completion.complete_requests(_asks(turns), completion.from_recorded(turns), qt._registry(spark, sf), SYSTEM)
    folded = transcripts.fold_transcripts(done.completions)
    out = transcripts.resolve(folded, qt._passages(spark, sf), lookups.price_table(spark))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint")
    return out.select("request_id", "status", "detail", "doc_id", "intent", "confidence", "reasoning",
                      size("extracted_fields").alias("n_fields"), size("citations").alias("n_citations"),
                      "tools_used", "model_version", "tokens_in", "tokens_out", "turns", "cost_usd")


def agent(messages: list[dict]) -> dict:
    """A rule in place of a model. It asks for (id mod 6) turns of tools, one call on even turns
    and two on odd ones, by the words of the prompt; then it says what its messages hold."""
    request, done = messages[0]["request_id"], sum(m["role"] == "assistant" for m in messages)
    words = messages[1]["content"].split(" ")
    facts = {"tokens_in": len(messages), "tokens_out": done, "model": "agent"}
    if done >= request % 6:
        told = [json.loads(m["content"]) for m in messages if m["role"] == "tool"]
        wrong = sum("error" in x for x in told)
        return facts | {"content": f"{len(messages)} messages, {len(told)} results, {wrong} errors"}
    word = words[done] if done < len(words) else ""
    names = [qt.TOOLS[(request + done) % 3]] + ["web_search"] * (done % 2)
    calls = [{"id": f"{request}.{done}.{i}", "name": n, "arguments": json.dumps({"query": word, "entity_name": word})}
             for i, n in enumerate(names)]
    return facts | {"content": "", "tool_calls": calls, "finish_reason": "tool_calls"}


@register("completion_agent", "U4 U5 P2 JN7 V4 J5", """
WITH p AS (SELECT conv_id AS request_id, string_split(arg_min(text, turn), ' ') AS words, conv_id % 6 AS want
           FROM conversations GROUP BY conv_id),
t AS (SELECT *, unnest(range(0, least(want, 4))) AS t FROM p),
c AS (SELECT request_id, t, 1 + t % 2 AS calls, coalesce(words[t + 1], '') AS word,
             (['lookup_clause_library', 'check_counterparty_history', 'web_search'])[((request_id + t) % 3) + 1] AS tool FROM t),
e AS (SELECT *, t % 2 + CASE WHEN tool = 'lookup_clause_library' THEN length(word) < 3
                             WHEN tool = 'check_counterparty_history' THEN length(word) < 2 ELSE TRUE END::INTEGER AS errors,
             tool <> 'web_search' AS known FROM c),
g AS (SELECT request_id, sum(calls) AS results, sum(errors) AS errors, count(*) AS asked, count_if(known) AS tools,
             string_agg(CASE WHEN known THEN tool END, ',' ORDER BY t) AS used FROM e GROUP BY request_id),
s AS (SELECT p.request_id, want, coalesce(results, 0) AS results, coalesce(errors, 0) AS errors, coalesce(asked, 0) AS asked,
             coalesce(tools, 0) AS tools, coalesce(used, '') AS used FROM p LEFT JOIN g USING (request_id)),
seen AS (  -- messages that the model saw at each of its turns
  SELECT p.request_id, sum(n) AS tokens_in FROM (
    SELECT request_id, unnest(range(0, least(want, 3) + 1)) AS upto FROM p) x JOIN p USING (request_id)
  CROSS JOIN LATERAL (SELECT 2 + coalesce(sum(2 + i % 2), 0) AS n FROM (SELECT unnest(range(0, upto)) AS i)) y GROUP BY p.request_id)
SELECT request_id, least(want + 1, 4)::BIGINT AS llm_calls,
       CASE WHEN want < 4 THEN (2 + asked + results)::VARCHAR || ' messages, ' || results::VARCHAR || ' results, '
                                || errors::VARCHAR || ' errors' ELSE '' END AS answer,
       want >= 4 AS pending_tools, used AS tools_used, (tools + 1)::BIGINT AS turns, tokens_in::BIGINT AS tokens_in,
       (least(want, 3) * (least(want, 3) + 1) // 2)::BIGINT AS tokens_out, 0.0::DOUBLE AS latency_ms, 'agent' AS model,
       CASE WHEN want < 4 THEN 'answered' ELSE 'cap_reached' END AS fold_status,
       (2 + asked + results + (want >= 4)::INTEGER)::BIGINT AS n_messages, results::BIGINT AS n_results,
       (SELECT max(least(want + 1, 4)) FROM p)::BIGINT AS rounds
FROM s JOIN seen USING (request_id)""")
def completion_agent(spark, sf):
    """A completer that reads its messages: what it answers depends on the whole list."""
    conv = table(spark, sf, "conversations")
    prompts = conv.groupBy(F.col("conv_id").alias("request_id")).agg(F.min_by("text", "turn").alias("prompt"))
    return _with_sizes(completion.complete_requests(prompts, completion.from_function(agent), qt._registry(spark, sf), SYSTEM))


# Kinds of a judge's replies by document id modulo their number: JSON pieces that replace the good
# reply's (None: the key is absent), or the whole text; and the error expected.
_GOOD = {"intent_correctness": "5", "citation_grounding": "4", "field_extraction_quality": "3",
         "conciseness_and_style": "@", "notes": '"fair"'}
_REPLIES = (
    ({}, None), ({"surplus": "[1]"}, None), ({"intent_correctness": '"5"'}, None), ({"citation_grounding": "4.0"}, None),
    (None, "no_reply"), ("", "empty"), ("The score is 5.", "malformed"), ("[5, 4, 3, 2]", "malformed"), ("null", "malformed"),
    *(({d: None}, f"missing:{d}") for d in contracts.JUDGE_DIMENSIONS),
    *(({d: '"good"'}, f"not_integer:{d}") for d in contracts.JUDGE_DIMENSIONS),
    ({"citation_grounding": "4.5"}, "not_integer:citation_grounding"), ({"intent_correctness": "null"}, "not_integer:intent_correctness"),
    *(({d: "6"}, f"out_of_range:{d}") for d in contracts.JUDGE_DIMENSIONS), ({"intent_correctness": "0"}, "out_of_range:intent_correctness"),
    ({"notes": None}, "missing:notes"), ({"notes": "7"}, "not_text:notes"), ({"notes": '"' + "n" * 401 + '"'}, "too_long:notes"),
    ({"notes": '"' + "n" * 400 + '"'}, None), ({"notes": "7", "intent_correctness": "9"}, "out_of_range:intent_correctness"),
)


def _reply(kind) -> str | None:
    if not isinstance(kind, dict):
        return kind
    return "{" + ", ".join(f'"{k}": {v}' for k, v in (_GOOD | kind).items() if v is not None) + "}"


_REPLY_ROWS = ", ".join(f"({i}, {repr(e) if e else 'NULL'})" for i, (_, e) in enumerate(_REPLIES))


@register("judge_replies", "U6 J10 V5 J9 U4", f"""
WITH kinds(i, error) AS (VALUES {_REPLY_ROWS}),
r AS (SELECT doc_id, n_chars % 5 + 1 AS style, error, doc_id % {len(_REPLIES)} AS i
      FROM documents JOIN kinds ON kinds.i = doc_id % {len(_REPLIES)})
SELECT doc_id, error, CASE WHEN error IS NULL THEN (12 + style) / 4.0::DOUBLE END AS mean,
       CASE WHEN error IS NULL THEN 5 END AS intent_correctness, CASE WHEN error IS NULL THEN 4 END AS citation_grounding,
       CASE WHEN error IS NULL THEN 3 END AS field_extraction_quality, CASE WHEN error IS NULL THEN style::INTEGER END AS conciseness_and_style,
       CASE WHEN error IS NULL THEN length(CASE WHEN i = {[i for i, (k, _) in enumerate(_REPLIES) if k == {"notes": '"' + "n" * 400 + '"'}][0]}
            THEN repeat('n', 400) ELSE 'fair' END) END AS notes_length, TRUE AS asked
FROM r""")
def judge_replies(spark, sf):
    """Every document's answer judged by a recorded reply; every error of the taxonomy occurs.
    ``asked``: the rubric and the response, as JSON, were the messages."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    responses = docs.select("doc_id", F.struct("doc_id", "lang", F.lit(0.9).alias("confidence")).alias("response"))
    said = F.element_at(F.array(*[F.lit(_reply(k)) for k, _ in _REPLIES]), (F.pmod("doc_id", F.lit(len(_REPLIES))) + 1).cast("int"))
    style = (F.col("n_chars") % 5 + 1).cast("string")
    recorded = docs.select(F.col("doc_id").alias("request_id"), F.lit(0).alias("turn"), F.replace(said, F.lit("@"), style).alias("content"),
                           F.array().cast(transcripts._TC).alias("tool_calls"), F.lit(1).alias("tokens_in"), F.lit(1).alias("tokens_out"),
                           F.lit("judge").alias("model"), F.lit("stop").alias("finish_reason")).where("content IS NOT NULL")
    judged, messages = judging.judge_replies(responses, completion.from_recorded(recorded), "Score the answer from 1 to 5.")
    asked = messages.groupBy(F.col("request_id").alias("doc_id")).agg(F.every(
        F.when(F.col("role") == "system", F.col("content") == "Score the answer from 1 to 5.").otherwise(
            (F.col("role") == "user") & F.startswith("content", F.lit("Response to score:\n"))
            & (F.get_json_object(F.substr("content", F.lit(20)), "$.doc_id").cast("bigint") == F.col("request_id")))).alias("asked"))
    return judged.join(asked, "doc_id").select("doc_id", "error", "mean", *contracts.JUDGE_DIMENSIONS,
                                               F.length("notes").alias("notes_length"), "asked")
