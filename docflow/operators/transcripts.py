"""Recorded LLM turns -> answers (A8-A11, W7, JN7, V3, J5, J12, P2, P3).

The LLM is never called: its turns arrive as a ``completions`` table keyed by
(request_id, turn). One shuffle on request_id groups a request's turns (at most
``max_turns`` of them after the turn filter, so the group is bounded) and the fold is
array arithmetic inside that row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow import contracts
from docflow.operators import guardrails, lookups
from docflow.session import parallelism, saved

# The callable tools and the loop bound.
KNOWN_TOOLS = ("lookup_clause_library", "check_counterparty_history")
MAX_TURNS = 4

_TC = "array<struct<id:string,name:string,arguments:string>>"


def first_delivery(completions: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """One row per (request, turn) below ``max_turns``: of re-delivered turns the least by
    (content, tool calls, tokens, model), so every copy of the job picks the same one. The
    aggregation combines before the shuffle."""
    keys = ("request_id", "turn")
    rest = [c for c in ("content", "tool_calls", "tokens_in", "tokens_out", "model", "finish_reason", "latency_ms")
            if c in completions.columns]
    first = completions.where(F.col("turn") < max_turns).groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_f"))
    return first.select(*keys, "_f.*")


def fold_transcripts(completions: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """A9-A11 + A8 + W7: keep LLM turns up to the first one without tool calls, capped at
    ``max_turns``; the last kept turn is the answer.

    Output per request_id: llm_calls, answer (content of the last kept turn),
    pending_tools (cap reached while the last turn still asked for tools),
    tools_used (ordered names of *known* tools called, argument errors included),
    turns (= 1 + size(tools_used), the reference's count), tokens_in, tokens_out,
    latency_ms (sum), model (first non-empty), fold_status: 'answered' | 'cap_reached' | 'exhausted'
    (recorded turns ran out before an answer: an upstream error).
    """
    c = first_delivery(completions, max_turns)
    latency = F.col("latency_ms") if "latency_ms" in c.columns else F.lit(None)
    c = c.select(
        "request_id",
        F.struct(F.col("turn").cast("int").alias("turn"), "content",
                 F.coalesce("tool_calls", F.array().cast(_TC)).alias("tool_calls"),
                 F.coalesce("tokens_in", F.lit(0)).cast("bigint").alias("tokens_in"),
                 F.coalesce("tokens_out", F.lit(0)).cast("bigint").alias("tokens_out"),
                 F.coalesce(latency.cast("double"), F.lit(0.0)).alias("latency_ms"),
                 F.coalesce("model", F.lit("")).alias("model")).alias("t"))
    g = c.groupBy("request_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    # Only a contiguous run of turns 0,1,2,... is usable: a gap means the script ran out.
    contiguous = F.filter("ts", lambda x, i: x["turn"] == i)
    stop = F.array_min(F.transform(F.filter(contiguous, lambda x: F.size(x["tool_calls"]) == 0),
                                   lambda x: x["turn"]))
    g = g.select("request_id", contiguous.alias("ts"), stop.alias("_stop"))
    kept = F.filter("ts", lambda x: F.col("_stop").isNull() | (x["turn"] <= F.col("_stop")))
    g = g.select("request_id", "_stop", kept.alias("k"))
    last = F.try_element_at("k", F.lit(-1))
    calls = F.flatten(F.transform("k", lambda x: x["tool_calls"]))
    tools = F.transform(F.filter(calls, lambda t: t["name"].isin(*KNOWN_TOOLS)), lambda t: t["name"])
    status = (F.when(F.col("_stop").isNotNull(), F.lit("answered"))
               .when(F.size("k") >= max_turns, F.lit("cap_reached"))
               .otherwise(F.lit("exhausted")))
    sum_of = lambda f: F.aggregate("k", F.lit(0).cast("bigint"), lambda a, x: a + x[f])
    first_model = F.try_element_at(F.filter(F.transform("k", lambda x: x["model"]),
                                            lambda m: m != ""), F.lit(1))
    return g.select(
        "request_id",
        F.size("k").cast("bigint").alias("llm_calls"),
        last["content"].alias("answer"),
        (F.size(F.coalesce(last["tool_calls"], F.array().cast(_TC))) > 0).alias("pending_tools"),
        tools.alias("tools_used"),
        (F.size(tools) + 1).cast("bigint").alias("turns"),
        sum_of("tokens_in").alias("tokens_in"),
        sum_of("tokens_out").alias("tokens_out"),
        F.aggregate("k", F.lit(0.0), lambda a, x: a + x["latency_ms"]).alias("latency_ms"),
        F.coalesce(first_model, F.lit("")).alias("model"),
        status.alias("fold_status"))


def _calls(completions: DataFrame, max_turns: int) -> DataFrame:
    """One row per tool call of a kept turn: request_id, turn, pos, tc."""
    folded = fold_transcripts(completions, max_turns).select("request_id", "llm_calls")
    c = first_delivery(completions, max_turns).join(folded, "request_id").where(F.col("turn") < F.col("llm_calls"))
    ex = c.select("request_id", F.col("turn").cast("bigint").alias("turn"),
                  F.posexplode(F.coalesce("tool_calls", F.array().cast(_TC))).alias("pos", "tc"))
    return ex.withColumn("pos", F.col("pos").cast("bigint"))


def tool_dispatch(completions: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """JN7 + V4: one row per tool call of a kept turn with its validation outcome.

    Output: request_id, turn, pos, call_id, name, known, error (null when the arguments
    are valid; 'unknown tool: x' for an unregistered name).
    """
    return _calls(completions, max_turns).select(
        "request_id", "turn", "pos", F.col("tc.id").alias("call_id"), F.col("tc.name").alias("name"),
        F.col("tc.name").isin(*KNOWN_TOOLS).alias("known"),
        lookups.validate_tool_args(F.col("tc.name"), F.col("tc.arguments")).alias("error"))


def clause_tool(calls: DataFrame, library: DataFrame) -> DataFrame:
    """call, arguments -> call, result: the entries found, as JSON."""
    q = calls.select(F.col("call").alias("query_id"), F.get_json_object("arguments", "$.query").alias("query"),
                     F.get_json_object("arguments", "$.top_k").try_cast("int").alias("top_k"))
    found = lookups.clause_lookup(q, library)
    text = library.select("clause_id", F.col("text").alias("_t"))
    hits = found.join(text, "clause_id").groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "clause_id", F.col("_t").alias("text")))).alias("h"))  # at most top_k a call
    entry = F.transform("h", lambda x: F.struct(x["clause_id"].alias("clause_id"), x["text"].alias("text")))
    return hits.select(F.col("query_id").alias("call"), F.to_json(F.struct(entry.alias("results"))).alias("result"))


def counterparty_tool(calls: DataFrame, directory: DataFrame) -> DataFrame:
    """call, arguments -> call, result: the directory's record or 'unknown', as JSON."""
    q = calls.select("call", F.get_json_object("arguments", "$.entity_name").alias("entity_name"))
    found = lookups.counterparty_lookup(q, directory)
    record = F.struct("status", *[c for c in found.columns if c not in ("call", "entity_name", "status")])
    return found.select("call", F.when(F.col("status") == "known", F.to_json(record)).otherwise(
        F.to_json(F.struct("status", "entity_name"))).alias("result"))


def tool_registry(library: DataFrame, directory: DataFrame) -> dict:
    """Tool name -> function of (call, arguments) rows. Add entries to register tools."""
    return {"lookup_clause_library": lambda calls: clause_tool(calls, library),
            "check_counterparty_history": lambda calls: counterparty_tool(calls, directory)}


def tool_results(completions: DataFrame, registry: dict, max_turns: int = MAX_TURNS) -> DataFrame:
    """JN7: every kept call answered, see ``run_calls``."""
    return run_calls(_calls(completions, max_turns), registry)


def run_calls(calls: DataFrame, registry: dict) -> DataFrame:
    """Calls (request_id, turn, pos, tc) answered: request_id, turn, pos, call_id, name, result
    (JSON: the tool's payload, or its error). Each tool runs once over all of its valid calls."""
    calls = calls.select(
        "request_id", "turn", "pos", F.col("tc.id").alias("call_id"), F.col("tc.name").alias("name"),
        F.col("tc.arguments").alias("arguments"),
        lookups.validate_tool_args(F.col("tc.name"), F.col("tc.arguments")).alias("error"))
    calls = saved(calls.withColumn("call", F.concat_ws("/", "request_id", "turn", "pos")), "calls")
    payload = None
    for name, tool in registry.items():
        part = tool(calls.where(F.col("error").isNull() & (F.col("name") == name)).select("call", "arguments"))
        payload = part if payload is None else payload.unionByName(part)
    out = calls.join(payload, "call", "left") if payload is not None else calls.withColumn("result", F.lit(None).cast("string"))
    return out.select("request_id", "turn", "pos", "call_id", "name",
                      F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(F.col("result")).alias("result"))


# ---- V3: strict parse -------------------------------------------------------


def _kind(v: Column, path: str) -> Column:
    """JSON type at ``path``: STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, ARRAY, OBJECT, VOID
    (a JSON null); null when absent."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _number(v: Column, path: str) -> Column:
    """A number, a boolean as 0 or 1, or a string that holds a number; else null."""
    kind = _kind(v, path)
    return (F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean").cast("double"))
             .when(kind.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), F.try_variant_get(v, path, "double"))
             .when(kind == "STRING", F.trim(_text(v, path)).try_cast("double")))


def _wrong(v: Column, path: str, kinds: tuple[str, ...], required: bool = False) -> Column:
    kind = _kind(v, path)
    return F.coalesce(~kind.isin(*kinds), F.lit(required))


def _citations(v: Column, path: str) -> Column:
    return F.transform(_items(v, path), lambda c: F.struct(_text(c, "$.chunk_id").alias("chunk_id"),
                                                           _text(c, "$.quote").alias("quote")))


def _bad_citations(v: Column, path: str) -> Column:
    """Some element is no citation: an object with a string id and a quote of 1-400 characters."""
    return F.exists(_items(v, path), lambda c: _wrong(c, "$.chunk_id", ("STRING",), True)
                    | _wrong(c, "$.quote", ("STRING",), True)
                    | ~F.coalesce(F.char_length(_text(c, "$.quote")).between(1, 400), F.lit(False)))


def parse_response(content: Column) -> Column:
    """V3: strict parse of a response JSON -> struct(response, error).

    error: 'empty' | 'malformed' | 'unknown_key' | 'schema:<rule>' | null. Types are checked on
    the JSON itself: strings must be strings, lists lists (null is neither), numbers may be
    numeric strings or booleans. Absent optional keys take their defaults; unknown top-level
    keys are rejected, unknown nested ones ignored."""
    v = F.try_parse_json(content)
    keys = F.json_object_keys(content)
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in contracts.RESPONSE_KEYS]))
    confidence = _number(v, "$.confidence")
    whole = lambda p: (_kind(v, p).isNotNull()
                       & F.coalesce(_number(v, p) != F.floor(_number(v, p)), F.lit(True)))
    bad_field = F.exists(_items(v, "$.extracted_fields"), lambda f: _wrong(f, "$.name", ("STRING",), True)
                         | F.coalesce(F.char_length(_text(f, "$.name")) < 1, F.lit(True))
                         | _wrong(f, "$.value", ("STRING",), True) | _wrong(f, "$.citations", ("ARRAY",), True)
                         | (F.size(_items(f, "$.citations")) < 1) | _bad_citations(f, "$.citations"))
    error = (F.when(F.coalesce(F.length(content), F.lit(0)) == 0, F.lit("empty"))
              .when(v.isNull() | keys.isNull(), F.lit("malformed"))
              .when(F.size(extra) > 0, F.lit("unknown_key"))
              .when(_wrong(v, "$.doc_id", ("STRING",), True), F.lit("schema:doc_id"))
              .when(_wrong(v, "$.intent", ("STRING",), True) | contracts.not_intent(_text(v, "$.intent")), F.lit("schema:intent"))
              .when(contracts.out_of_range(confidence, 0.0, 1.0) | F.isnan(confidence), F.lit("schema:confidence"))
              .when(_wrong(v, "$.reasoning", ("STRING",), True) | contracts.length_between(_text(v, "$.reasoning"), lo=10),
                    F.lit("schema:reasoning"))
              .when(_wrong(v, "$.citations", ("ARRAY",)) | _bad_citations(v, "$.citations"), F.lit("schema:citation"))
              .when(_wrong(v, "$.extracted_fields", ("ARRAY",)) | bad_field, F.lit("schema:extracted_fields"))
              .when(_wrong(v, "$.tools_used", ("ARRAY",)) | F.exists(
                  _items(v, "$.tools_used"), lambda t: _wrong(t, "$", ("STRING",), True)), F.lit("schema:tools_used"))
              .when(_wrong(v, "$.model_version", ("STRING",)), F.lit("schema:model_version"))
              .when(whole("$.tokens_in") | whole("$.tokens_out"), F.lit("schema:tokens"))
              .when(_kind(v, "$.latency_ms").isNotNull() & _number(v, "$.latency_ms").isNull(), F.lit("schema:latency_ms")))
    fields = F.transform(_items(v, "$.extracted_fields"), lambda f: F.struct(
        _text(f, "$.name").alias("name"), _text(f, "$.value").alias("value"), _citations(f, "$.citations").alias("citations")))
    response = F.struct(_text(v, "$.doc_id").alias("doc_id"), _text(v, "$.intent").alias("intent"),
                        confidence.alias("confidence"), _text(v, "$.reasoning").alias("reasoning"),
                        fields.alias("extracted_fields"), _citations(v, "$.citations").alias("citations"))
    return F.struct(response.alias("response"), error.alias("error"))


def resolve(folded: DataFrame, passages: DataFrame, prices: DataFrame) -> DataFrame:
    """P2+P3+J12: fold -> strict parse -> citation check -> safety -> enrich -> cost.

    folded: output of ``fold_transcripts`` (request_id = doc_id of the request).
    passages: request_id, chunk_id, text (what that request retrieved).
    Output: request_id, status (ok | upstream_error | invalid_response |
    citation_violation | unsafe_output), detail; the answer, null unless ok: doc_id (the
    request's, whatever the model wrote), intent, confidence, reasoning, extracted_fields,
    citations; and tools_used, model_version, tokens_in, tokens_out, latency_ms, turns, cost_usd.
    Checks run in this order: parse, citations, safety.
    """
    p = saved(folded.withColumn("_p", parse_response(F.col("answer")))
              .select("*", F.col("_p.response").alias("r"), F.col("_p.error").alias("parse_error")).drop("_p"), "parsed")
    resp = p.where(F.col("parse_error").isNull()).select(
        "request_id", F.col("r.intent").alias("intent"), F.col("r.citations").alias("citations"),
        F.col("r.extracted_fields").alias("extracted_fields"))
    verdict = guardrails.citation_verdict(resp, passages).select(
        "request_id", F.col("ok").alias("_cit_ok"), F.col("violation").alias("_cit_v"))
    j = p.join(verdict, "request_id", "left")
    status = (F.when(F.col("fold_status") == "exhausted", F.lit("upstream_error"))
               .when(F.col("parse_error").isNotNull(), F.lit("invalid_response"))
               .when(~F.col("_cit_ok"), F.lit("citation_violation"))
               .when(guardrails.unsafe(F.col("r.reasoning")), F.lit("unsafe_output"))
               .otherwise(F.lit("ok")))
    detail = (F.when(F.col("fold_status") == "exhausted", F.lit("no recorded turn left"))
               .when(F.col("parse_error").isNotNull(), F.col("parse_error"))
               .when(~F.col("_cit_ok"), F.col("_cit_v")))
    j = j.withColumn("status", status).withColumn("detail", detail)
    priced = F.when(F.col("model") == "", F.lit(lookups.DEFAULT_MODEL)).otherwise(F.col("model"))
    ok = F.col("status") == "ok"
    out = j.select(
        "request_id", "status", "detail", F.when(ok, F.col("request_id").cast("string")).alias("doc_id"),
        *(F.when(ok, F.col(f"r.{c}")).alias(c) for c in ("intent", "confidence", "reasoning", "extracted_fields", "citations")),
        F.array_join("tools_used", ",").alias("tools_used"),
        F.when(F.col("model") == "", F.lit("unknown")).otherwise(F.col("model")).alias("model_version"),
        "tokens_in", "tokens_out", "latency_ms", "turns", priced.alias("_priced"))
    return lookups.with_cost(out, prices, "_priced").drop("_priced")


# Fixed value: what the model is told once its tool turns are used up.
CAP_MESSAGE = "You have used the maximum number of tool calls. Return the final JSON object per the schema now."


MESSAGE_COLUMNS = ("request_id", "turn", "pos", "role", "content", "tool_call_id", "tool_calls")


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _message(turn: Column, pos: Column, role: str, content: Column, call: Column | None = None,
             calls: Column | None = None) -> list[Column]:
    return [F.col("request_id"), turn.cast("bigint").alias("turn"), pos.cast("bigint").alias("pos"), F.lit(role).alias("role"),
            content.alias("content"), (F.lit(None).cast("string") if call is None else call).alias("tool_call_id"),
            (F.lit(None) if calls is None else calls).cast(_TC).alias("tool_calls")]


def opening_messages(prompts: DataFrame, system: str) -> DataFrame:
    """The system and the user message of each request (turn -1)."""
    return prompts.select(*_message(F.lit(-1), F.lit(0), "system", F.lit(system))).unionByName(
        prompts.select(*_message(F.lit(-1), F.lit(1), "user", F.col("prompt"))))


def turn_messages(asked: DataFrame, results: DataFrame, cap: bool | Column) -> list[DataFrame]:
    """The messages of turns that asked for tools: the assistant's, each result in call order,
    and where ``cap`` holds the cap message."""
    said = asked.select(*_message(F.col("turn"), F.lit(0), "assistant", F.coalesce("content", F.lit("")), None, F.col("tool_calls")))
    told = results.select(*_message(F.col("turn"), F.col("pos") + 1, "tool", F.col("result"), F.col("call_id")))
    if cap is False:
        return [said, told]
    last = asked if cap is True else asked.where(cap)
    return [said, told, last.select(*_message(F.col("turn"), F.size("tool_calls") + 1, "system", F.lit(CAP_MESSAGE)))]


def request_messages(prompts: DataFrame, completions: DataFrame, results: DataFrame, system: str,
                     max_turns: int = MAX_TURNS) -> DataFrame:
    """The whole message list in long form: request_id, turn, pos, role, content,
    tool_call_id, tool_calls. The system and user messages come first (turn -1), then per kept
    turn that asked for tools the assistant's message and each result in call order, and the
    cap message after the last allowed turn. No request has to fit in one row.

    prompts: request_id, prompt. results: ``tool_results``."""
    folded = fold_transcripts(completions, max_turns).select("request_id", "llm_calls")
    asked = (first_delivery(completions, max_turns).join(folded, "request_id")
             .where((F.col("turn") < F.col("llm_calls")) & (F.size("tool_calls") > 0)))
    parts = turn_messages(asked, results, F.col("turn") == max_turns - 1)
    return union_all([opening_messages(prompts, system), *parts]).select(*MESSAGE_COLUMNS)


def complete(messages: DataFrame, fn, key: str = "request_id") -> DataFrame:
    """U4: a user-supplied completion function. ``fn(list of messages) -> dict`` (content,
    tool_calls, tokens_in, tokens_out, model) runs once per request in Arrow tasks over the
    cluster's cores, however few bytes the messages are (a call costs time, not bytes); a
    request's messages are one row, bounded by its turns and calls. Output: one completions row
    per request, its turn = number of assistant messages so far."""
    spark = messages.sparkSession
    kind = messages.schema[key].dataType.simpleString()
    said = pa.struct([("content", pa.string()), ("tool_calls", pa.list_(pa.struct(
        [("id", pa.string()), ("name", pa.string()), ("arguments", pa.string())]))), ("tokens_in", pa.int32()),
        ("tokens_out", pa.int32()), ("model", pa.string()), ("finish_reason", pa.string())])

    def run(batches):
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            turns, out = [], []
            for request, rows in zip(batch.column(key).to_pylist(), batch.column("_m").to_pylist(), strict=True):
                rows = [{key: request} | r for r in sorted(rows, key=lambda r: (r["turn"], r["pos"]))]
                got = fn(rows)
                turns.append(sum(r["role"] == "assistant" for r in rows))
                out.append({"content": got.get("content"), "tool_calls": got.get("tool_calls") or [],
                            "tokens_in": int(got.get("tokens_in", 0)), "tokens_out": int(got.get("tokens_out", 0)),
                            "model": got.get("model") or "", "finish_reason": got.get("finish_reason") or "stop"})
            columns = pa.array(out, said).flatten()
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(turns, pa.int32()), *columns],
                                             names=[key, "turn", *(f.name for f in said)])

    parts = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = messages.groupBy(key).agg(F.collect_list(F.struct(*[c for c in messages.columns if c != key])).alias("_m"))
    return whole.repartition(parts, F.xxhash64(key)).mapInArrow(  # else small shuffles are read by one task
        run, f"{key} {kind}, turn int, content string, tool_calls {_TC}, tokens_in int, tokens_out int, model string, finish_reason string")


def chat_messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """The ordered message list of each conversation in long form - one row per
    message (key, turn, line = ``role: text``), ordered by turn. No grouping, so a
    conversation of any length never has to fit in one row or one task."""
    return turns.select(key, F.col("turn").cast("bigint").alias("turn"),
                        F.concat(F.col("role"), F.lit(": "),
                                 F.coalesce(F.col("text"), F.lit(""))).alias("line"))
