"""Registered queries: recorded LLM turns, tools, lookups, cost (A8-A11, W7, JN5-JN8, J5,
J8, V3, V4, P2, P3).

Recorded completions are derived from ``conversations``: every assistant turn is one
LLM call; an assistant turn that is not the conversation's last one asked for a tool.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docflow.functions.text import count_tokens
from docflow.operators import lookups, transcripts
from docflow.plans.registry import register
from docflow.plans.sql_snippets import SPACE
from docflow.session import table

# Fixed derivation rules for the recorded turns (model and tool picked by position).
MODELS = ("gpt-4o", "gpt-4o-mini", "", "gpt-5.1")
TOOLS = ("lookup_clause_library", "check_counterparty_history", "web_search")


def completions(spark, sf):
    """Recorded LLM turns from ``conversations``: the first ``MAX_TURNS`` assistant turns
    of each conversation (the fold never reads further), each asking for a tool unless it
    is the conversation's last assistant turn. Hot conversations stay distributed: the
    previous message (turns are consecutive message positions) comes from an equi-join
    on (conv_id, turn - 1), the last assistant
    turn from a partial max aggregation, and the turn index from ``row_number() <= k``,
    which Spark limits per partition before the shuffle."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    prev = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("_prev"))
    a = conv.where(F.col("role") == "assistant").join(prev, ["conv_id", "turn"], "left")
    last = a.groupBy("conv_id").agg(F.max("turn").alias("_last_turn"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    a = (a.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= transcripts.MAX_TURNS)
          .join(last, "conv_id")
          .withColumn("_t", (F.col("_rn") - 1).cast("int"))
          .withColumn("_last", F.col("turn") == F.col("_last_turn")))
    pos = F.col("conv_id") + F.col("turn")
    model = F.try_element_at(F.array(*[F.lit(m) for m in MODELS]),
                             (F.pmod(pos, F.lit(len(MODELS))) + 1).cast("int"))
    tool = F.try_element_at(F.array(*[F.lit(t) for t in TOOLS]),
                            (F.pmod(pos, F.lit(len(TOOLS))) + 1).cast("int"))
    word = F.try_element_at(F.split("text", " ", -1), F.lit(1))
    args = F.to_json(F.struct(word.alias("query"), word.alias("entity_name")))
    call = F.struct(F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"),
                             F.col("turn").cast("string")).alias("id"),
                    tool.alias("name"), args.alias("arguments"))
    calls = F.when(F.col("_last"), F.array().cast("array<struct<id:string,name:string,arguments:string>>")) \
             .otherwise(F.array(call))
    return a.select(
        F.col("conv_id").alias("request_id"), F.col("_t").alias("turn"), F.col("text").alias("content"),
        calls.alias("tool_calls"),
        F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(count_tokens("_prev")).cast("int").alias("tokens_in"),
        count_tokens("text").cast("int").alias("tokens_out"),
        model.alias("model"),
        F.when(F.col("_last"), F.lit("stop")).otherwise(F.lit("tool_calls")).alias("finish_reason"))


_COMPLETIONS_SQL = """
conv AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
a AS (SELECT conv_id AS request_id, turn AS cturn,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t,
             lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS has_tools,
             text AS content,
             CASE WHEN prev IS NULL THEN 0 ELSE len(string_split(prev, ' ')) END AS tokens_in,
             len(string_split(text, ' ')) AS tokens_out,
             (['gpt-4o', 'gpt-4o-mini', '', 'gpt-5.1'])[((conv_id + turn) % 4) + 1] AS model,
             (['lookup_clause_library', 'check_counterparty_history', 'web_search'])[((conv_id + turn) % 3) + 1] AS tool,
             string_split(text, ' ')[1] AS word
      FROM conv WHERE role = 'assistant'),
s AS (SELECT request_id, min(t) FILTER (WHERE t < 4 AND NOT has_tools) AS stop FROM a GROUP BY request_id),
k AS (SELECT a.*, s.stop FROM a JOIN s USING (request_id) WHERE a.t < 4 AND (s.stop IS NULL OR a.t <= s.stop)),
f AS (SELECT request_id, count(*)::BIGINT AS llm_calls, arg_max(content, t) AS answer,
        arg_max(has_tools, t) AS pending_tools,
        coalesce(string_agg(CASE WHEN has_tools AND tool IN ('lookup_clause_library', 'check_counterparty_history')
                                 THEN tool END, ',' ORDER BY t), '') AS tools_used,
        (count(*) FILTER (WHERE has_tools AND tool IN ('lookup_clause_library', 'check_counterparty_history')) + 1)::BIGINT AS turns,
        sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
        coalesce(arg_min(model, t) FILTER (WHERE model <> ''), '') AS model,
        CASE WHEN any_value(stop) IS NOT NULL THEN 'answered' WHEN count(*) >= 4 THEN 'cap_reached'
             ELSE 'exhausted' END AS fold_status
      FROM k GROUP BY request_id),
prices AS (SELECT * FROM (VALUES ('gpt-4o', 0.005::DOUBLE, 0.015::DOUBLE),
    ('gpt-4o-mini', 0.00015::DOUBLE, 0.0006::DOUBLE), ('gpt-4-turbo', 0.01::DOUBLE, 0.03::DOUBLE),
    ('text-embedding-3-large', 0.00013::DOUBLE, 0.0::DOUBLE),
    ('text-embedding-3-small', 0.00002::DOUBLE, 0.0::DOUBLE)) p(model, pin, pout))"""


def _folded(spark, sf):
    return transcripts.fold_transcripts(completions(spark, sf))


@register("transcript_fold", "A8 A9 A10 A11 W7", f"""
WITH {_COMPLETIONS_SQL}
SELECT request_id, llm_calls, answer, pending_tools, tools_used, turns, tokens_in, tokens_out,
       0.0::DOUBLE AS latency_ms, model, fold_status FROM f""")
def transcript_fold(spark, sf):
    return _folded(spark, sf).withColumn("tools_used", F.array_join("tools_used", ","))


@register("transcript_cost", "A8 JN8 J8", f"""
WITH {_COMPLETIONS_SQL},
fp AS (SELECT f.*, CASE WHEN model = '' THEN 'gpt-4o' ELSE model END AS priced FROM f)
SELECT request_id, CASE WHEN fp.model = '' THEN 'unknown' ELSE fp.model END AS model_version,
       tokens_in, tokens_out,
       (tokens_in::DOUBLE / 1000.0::DOUBLE) * coalesce(p.pin, 0.005::DOUBLE)
         + (tokens_out::DOUBLE / 1000.0::DOUBLE) * coalesce(p.pout, 0.015::DOUBLE) AS cost_usd
FROM fp LEFT JOIN prices p ON p.model = fp.priced""")
def transcript_cost(spark, sf):
    f = _folded(spark, sf)
    priced = F.when(F.col("model") == "", F.lit(lookups.DEFAULT_MODEL)).otherwise(F.col("model"))
    f = f.select("request_id",
                 F.when(F.col("model") == "", F.lit("unknown")).otherwise(F.col("model")).alias("model_version"),
                 "tokens_in", "tokens_out", priced.alias("_priced"))
    return lookups.with_cost(f, lookups.price_table(spark), "_priced").drop("_priced")


@register("tool_dispatch", "JN7 V4 U5", f"""
WITH {_COMPLETIONS_SQL}
SELECT request_id, t::BIGINT AS turn, 0::BIGINT AS pos,
       'call_' || request_id::VARCHAR || '_' || cturn::VARCHAR AS call_id, tool AS name,
       tool IN ('lookup_clause_library', 'check_counterparty_history') AS known,
       CASE WHEN tool = 'lookup_clause_library' THEN
              CASE WHEN word IS NULL OR length(word) < 3 THEN 'invalid arguments: query' END
            WHEN tool = 'check_counterparty_history' THEN
              CASE WHEN word IS NULL OR length(word) < 2 THEN 'invalid arguments: entity_name' END
            ELSE 'unknown tool: ' || tool END AS error
FROM k WHERE has_tools""")
def tool_dispatch(spark, sf):
    return transcripts.tool_dispatch(completions(spark, sf))


# Kinds of recorded answers, by request id: what the model wrote (JSON pieces that replace
# the good answer's) and the outcome expected.
_GOOD = {"doc_id": '"x"', "intent": '"nda"', "confidence": "0.5", "reasoning": '"grounded in the passages"',
         "citations": "[@]", "extracted_fields": '[{"name":"f","value":"v","citations":[@]}]'}
_KINDS = (
    ({}, "ok", None), ({"intent": '"other"', "citations": "[]", "extracted_fields": "[]"}, "ok", None),
    ({"confidence": '"0.5"'}, "ok", None), ({"confidence": "true"}, "ok", None),
    ("", "invalid_response", "empty"), ("plain words", "invalid_response", "malformed"), ("[]", "invalid_response", "malformed"),
    ({"surplus": "1"}, "invalid_response", "unknown_key"), ({"doc_id": "7"}, "invalid_response", "schema:doc_id"),
    ({"intent": '"invoice"'}, "invalid_response", "schema:intent"), ({"confidence": "1.5"}, "invalid_response", "schema:confidence"),
    ({"reasoning": '"short"'}, "invalid_response", "schema:reasoning"), ({"citations": "null"}, "invalid_response", "schema:citation"),
    ({"citations": '["x"]'}, "invalid_response", "schema:citation"),
    ({"citations": '[{"chunk_id":"c","quote":"' + "q" * 401 + '"}]'}, "invalid_response", "schema:citation"),
    ({"extracted_fields": '"abc"'}, "invalid_response", "schema:extracted_fields"),
    ({"extracted_fields": '[{"name":"f","value":"v","citations":[]}]'}, "invalid_response", "schema:extracted_fields"),
    ({"tools_used": "[1]"}, "invalid_response", "schema:tools_used"), ({"tokens_in": '"abc"'}, "invalid_response", "schema:tokens"),
    ({"citations": "[]", "extracted_fields": "[]"}, "citation_violation", "no_citations"),
    ({"citations": '[{"chunk_id":"none","quote":"q"}]'}, "citation_violation", "unknown_chunk"),
    ({"extracted_fields": '[{"name":"f","value":"v","citations":[@,#]}]'}, "citation_violation", "quote_not_found"),
    ({"reasoning": '"then Kill  it, kill it all"'}, "unsafe_output", None),
)


def _answer(kind) -> str:
    return kind if isinstance(kind, str) else "{" + ",".join(f'"{k}":{v}' for k, v in (_GOOD | kind).items()) + "}"


def answered(spark, sf):
    """The recorded turns with JSON answers: a conversation's last turn says the answer of
    kind (id mod number of kinds), citing its first user turn; every 29th loses it."""
    c = completions(spark, sf).where(~((F.size("tool_calls") == 0) & (F.col("request_id") % 29 == 7)))
    p = _passages(spark, sf).withColumnRenamed("text", "_ptext")
    cite = F.to_json(F.struct(F.col("chunk_id"), F.substring("_ptext", 1, 30).alias("quote")))
    wrong = F.to_json(F.struct(F.col("chunk_id"), F.lit("an invented quote").alias("quote")))
    said = F.element_at(F.array(*[F.lit(_answer(k)) for k, _, _ in _KINDS]),
                        (F.pmod("request_id", F.lit(len(_KINDS))) + 1).cast("int"))
    said = F.replace(F.replace(said, F.lit("@"), F.coalesce(cite, F.lit("{}"))), F.lit("#"), F.coalesce(wrong, F.lit("{}")))
    j = c.join(p, "request_id", "left")
    return j.withColumn("content", F.when(F.size("tool_calls") == 0, said).otherwise(F.col("content"))).drop("chunk_id", "_ptext")


def _passages(spark, sf):
    """Per conversation its first message as the one passage retrieved."""
    conv = table(spark, sf, "conversations")
    first = conv.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select(F.col("conv_id").alias("request_id"), F.concat(F.lit("c"), "conv_id").alias("chunk_id"), "text")


_KIND_ROWS = ", ".join(f"({i}, '{st}', {repr(d) if d else 'NULL'})" for i, (_, st, d) in enumerate(_KINDS))


@register("reason_resolve", "P2 P3 V3 A14 V10 J12 J8 U-5", f"""
WITH {_COMPLETIONS_SQL},
kinds(i, st, why) AS (VALUES {_KIND_ROWS}),
k2 AS (SELECT * FROM k WHERE has_tools OR request_id % 29 <> 7),
g AS (SELECT request_id, bool_or(NOT has_tools) AS answered, count(*) AS n,
        coalesce(string_agg(CASE WHEN has_tools AND tool IN ('lookup_clause_library', 'check_counterparty_history')
                                 THEN tool END, ',' ORDER BY t), '') AS tools_used,
        (count(*) FILTER (WHERE has_tools AND tool IN ('lookup_clause_library', 'check_counterparty_history')) + 1)::BIGINT AS turns,
        sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
        coalesce(arg_min(model, t) FILTER (WHERE model <> ''), '') AS model
      FROM k2 GROUP BY request_id),
r AS (SELECT g.*, request_id % {len(_KINDS)} AS kind,
        CASE WHEN answered THEN st WHEN n >= 4 THEN 'invalid_response' ELSE 'upstream_error' END AS status,
        CASE WHEN answered THEN why WHEN n >= 4 THEN 'malformed' ELSE 'no recorded turn left' END AS detail
      FROM g JOIN kinds ON kinds.i = request_id % {len(_KINDS)})
SELECT request_id, status, detail, CASE WHEN status = 'ok' THEN request_id::VARCHAR END AS doc_id,
       CASE WHEN status = 'ok' THEN CASE WHEN kind = 1 THEN 'other' ELSE 'nda' END END AS intent,
       CASE WHEN status = 'ok' THEN CASE WHEN kind = 3 THEN 1.0 ELSE 0.5 END END::DOUBLE AS confidence,
       CASE WHEN status = 'ok' THEN 'grounded in the passages' END AS reasoning,
       CASE WHEN status = 'ok' THEN CASE WHEN kind = 1 THEN 0 ELSE 1 END END::BIGINT AS n_fields,
       CASE WHEN status = 'ok' THEN CASE WHEN kind = 1 THEN 0 ELSE 1 END END::BIGINT AS n_citations, tools_used,
       CASE WHEN r.model = '' THEN 'unknown' ELSE r.model END AS model_version, tokens_in, tokens_out, turns,
       (tokens_in::DOUBLE / 1000.0::DOUBLE) * coalesce(p.pin, 0.005::DOUBLE)
         + (tokens_out::DOUBLE / 1000.0::DOUBLE) * coalesce(p.pout, 0.015::DOUBLE) AS cost_usd
FROM r LEFT JOIN prices p ON p.model = (CASE WHEN r.model = '' THEN 'gpt-4o' ELSE r.model END)""")
def reason_resolve(spark, sf):
    """Recorded JSON answers of every kind: all five statuses, every parse error and every
    citation outcome occur."""
    folded = transcripts.fold_transcripts(answered(spark, sf))
    out = transcripts.resolve(folded, _passages(spark, sf), lookups.price_table(spark))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("bigint")
    return out.select("request_id", "status", "detail", "doc_id", "intent", "confidence", "reasoning",
                      size("extracted_fields").alias("n_fields"), size("citations").alias("n_citations"),
                      "tools_used", "model_version", "tokens_in", "tokens_out", "turns", "cost_usd")


def _tool_turns(spark, sf):
    """The recorded turns; a counterparty call asks for a customer by number (some unknown)."""
    name = F.format_string("CUSTOMER#%09d", F.col("request_id") * 40)
    return completions(spark, sf).withColumn("tool_calls", F.transform("tool_calls", lambda t: F.struct(
        t["id"].alias("id"), t["name"].alias("name"),
        F.when(t["name"] == "check_counterparty_history", F.to_json(F.struct(name.alias("entity_name"))))
        .otherwise(t["arguments"]).alias("arguments"))))


def _registry(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("clause_id"), F.col("p_partkey").alias("position"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    directory = table(spark, sf, "customer").select(F.col("c_name").alias("entity_name"), "c_mktsegment")
    return transcripts.tool_registry(part, directory)


_TOOL_RESULTS_SQL = rf"""{_COMPLETIONS_SQL},
lib AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type || ' ' || p_brand) AS lt FROM part),
w AS (SELECT DISTINCT word FROM k WHERE has_tools AND tool = 'lookup_clause_library' AND length(word) >= 3),
sc AS (SELECT word, id, row_number() OVER (PARTITION BY word ORDER BY
              len(list_filter(regexp_split_to_array(lower(word), '{SPACE}'), lambda t: length(t) > 0 AND contains(lt, t))) DESC, id) AS rn
       FROM w CROSS JOIN lib),
cl AS (SELECT word, string_agg(id::VARCHAR, ',' ORDER BY rn) AS ids FROM sc WHERE rn <= 3 GROUP BY word),
tr AS (SELECT request_id, t::BIGINT AS turn, 0::BIGINT AS pos,
       'call_' || request_id::VARCHAR || '_' || cturn::VARCHAR AS call_id, tool AS name,
       CASE WHEN tool = 'lookup_clause_library' AND (k.word IS NULL OR length(k.word) < 3) THEN 'invalid arguments: query'
            WHEN tool NOT IN ('lookup_clause_library', 'check_counterparty_history') THEN 'unknown tool: ' || tool END AS error,
       CASE WHEN tool = 'lookup_clause_library' THEN cl.ids END AS clause_ids,
       CASE WHEN tool = 'check_counterparty_history' THEN CASE WHEN c.c_name IS NULL THEN 'unknown' ELSE 'known' END END AS status,
       CASE WHEN tool = 'check_counterparty_history' THEN c.c_name END AS known_name,
       CASE WHEN tool = 'check_counterparty_history' THEN c.c_mktsegment END AS segment
  FROM k LEFT JOIN cl ON cl.word = k.word AND length(k.word) >= 3
  LEFT JOIN customer c ON lower(c.c_name) = lower(printf('CUSTOMER#%09d', request_id * 40)) WHERE has_tools)"""


@register("tool_results", "JN7 U5 JN5 JN6 V4", f"""
WITH {_TOOL_RESULTS_SQL} SELECT * FROM tr""")
def tool_results(spark, sf):
    """Every recorded tool call run: clause entries, counterparty records or errors."""
    r = transcripts.tool_results(_tool_turns(spark, sf), _registry(spark, sf))
    at = lambda path: F.get_json_object("result", path)
    ids = F.transform(F.from_json("result", "results array<struct<clause_id:bigint>>")["results"], lambda x: x["clause_id"].cast("string"))
    return r.select("request_id", "turn", "pos", "call_id", "name", at("$.error").alias("error"),
                    F.array_join(ids, ",").alias("clause_ids"), at("$.status").alias("status"),
                    at("$.known_name").alias("known_name"), at("$.c_mktsegment").alias("segment"))


@register("request_messages", "J5 JN7 W7", f"""
WITH {_TOOL_RESULTS_SQL},
m AS (
  SELECT request_id, -1 AS turn, 0 AS pos, 'system' AS role, 'Answer from the passages.' AS content, NULL AS call FROM f
  UNION ALL SELECT request_id, -1, 1, 'user', 'Request ' || request_id::VARCHAR, NULL FROM f
  UNION ALL SELECT request_id, t, 0, 'assistant', content, NULL FROM k WHERE has_tools
  UNION ALL SELECT request_id, turn, pos + 1, 'tool', NULL, call_id FROM tr
  UNION ALL SELECT request_id, t, 2, 'system',
    'You have used the maximum number of tool calls. Return the final JSON object per the schema now.', NULL
    FROM k WHERE has_tools AND t = 3)
SELECT request_id, turn::BIGINT AS turn, pos::BIGINT AS pos, role, content, call::VARCHAR AS tool_call_id FROM m""")
def request_messages(spark, sf):
    """System, user, assistant, tool and cap messages of every request (tool payloads are
    checked by ``tool_results``)."""
    turns = _tool_turns(spark, sf)
    ask = turns.select("request_id").distinct().select(
        "request_id", F.concat(F.lit("Request "), F.col("request_id").cast("string")).alias("prompt"))
    m = transcripts.request_messages(ask, turns, transcripts.tool_results(turns, _registry(spark, sf)), "Answer from the passages.")
    return m.select("request_id", "turn", "pos", "role",
                    F.when(F.col("role") != "tool", F.col("content")).alias("content"), "tool_call_id")


@register("chat_messages", "J5", """
SELECT conv_id, turn::BIGINT AS turn, role || ': ' || coalesce(text, '') AS line FROM conversations""")
def chat_messages(spark, sf):
    return transcripts.chat_messages(table(spark, sf, "conversations"))


@register("clause_lookup", "JN6 W2 V4", rf"""
WITH q AS (SELECT conv_id::VARCHAR || '/' || turn::VARCHAR AS query_id, text AS query FROM conversations WHERE role = 'user'),
qt AS (SELECT query_id, tok, count(*) AS mult FROM (
         SELECT query_id, unnest(regexp_split_to_array(lower(query), '{SPACE}')) AS tok FROM q)
       WHERE length(tok) > 0 GROUP BY query_id, tok),
lib AS (SELECT p_partkey AS clause_id, p_partkey AS position,
               lower(p_name || ' ' || p_type || ' ' || p_brand) AS lt FROM part),
sc AS (SELECT q.query_id, lib.clause_id, lib.position,
              coalesce(sum(CASE WHEN contains(lib.lt, qt.tok) THEN qt.mult ELSE 0 END), 0)::BIGINT AS score
       FROM q CROSS JOIN lib LEFT JOIN qt ON qt.query_id = q.query_id
       GROUP BY q.query_id, lib.clause_id, lib.position)
SELECT query_id, clause_id, position, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM sc)
WHERE rank <= 3""")
def clause_lookup(spark, sf):
    conv = table(spark, sf, "conversations").where(F.col("role") == "user")
    q = conv.select(F.concat_ws("/", "conv_id", "turn").alias("query_id"),
                    F.col("text").alias("query"))
    part = table(spark, sf, "part")
    lib = part.select(F.col("p_partkey").alias("clause_id"), F.col("p_partkey").alias("position"),
                      F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return lookups.clause_lookup(q, lib)


@register("counterparty_lookup", "JN5", """
WITH calls AS (SELECT o_orderkey AS request_id, printf('CUSTOMER#%09d', o_custkey) AS entity_name FROM orders
               UNION ALL SELECT -1 - s_suppkey, s_name FROM supplier),
dir AS (SELECT lower(c_name) AS k, c_name, c_acctbal, c_mktsegment FROM customer)
SELECT request_id, entity_name, c_name AS known_name, c_acctbal, c_mktsegment,
       CASE WHEN k IS NULL THEN 'unknown' ELSE 'known' END AS status
FROM calls LEFT JOIN dir ON dir.k = lower(calls.entity_name)""")
def counterparty_lookup(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.format_string("CUSTOMER#%09d", F.col("o_custkey")).alias("entity_name"))
    s = table(spark, sf, "supplier").select((F.lit(-1) - F.col("s_suppkey")).alias("request_id"),
                                            F.col("s_name").alias("entity_name"))
    d = table(spark, sf, "customer").select(F.col("c_name").alias("entity_name"), "c_acctbal",
                                            "c_mktsegment")
    return lookups.counterparty_lookup(o.unionByName(s), d)
