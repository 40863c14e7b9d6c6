"""Judge scores from a judge model's reply texts.

The rubric and the response make a message list (J10), a completer (``completion``) answers it, and
the reply is parsed strictly by the score's schema. A reply that cannot be used is kept with
its error, never dropped; valid scores aggregate as in ``regression.judge_aggregate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow import contracts
from docflow.operators import completion, transcripts
from docflow.operators.regression import judge_mean, judge_message

MAX_NOTES = 400
#: What can be wrong with a reply, in the order of the checks.
ERRORS = ("no_reply", "empty", "malformed", *(f"{kind}:{d}" for d in contracts.JUDGE_DIMENSIONS for kind in (
    "missing", "not_integer", "out_of_range")), "missing:notes", "not_text:notes", "too_long:notes")


def _dimension_error(v: Column, name: str) -> Column:
    path = f"$.{name}"
    number = transcripts._number(v, path)
    return (F.when(transcripts._kind(v, path).isNull(), F.lit(f"missing:{name}"))
             .when(number.isNull() | F.isnan(number) | (number % 1 != 0), F.lit(f"not_integer:{name}"))
             .when(~number.between(1, 5), F.lit(f"out_of_range:{name}")))


def parse_score(content: Column) -> Column:
    """A judge's reply -> struct(score, error). ``score`` has the four dimensions and the notes; ``error`` is
    null or one of ``ERRORS``, the first that holds. Numbers may be whole numeric strings or
    booleans, as elsewhere; further keys are ignored."""
    v = F.try_parse_json(content)
    notes = transcripts._kind(v, "$.notes")
    error = (F.when(content.isNull(), F.lit("no_reply"))
              .when(F.length(content) == 0, F.lit("empty"))
              .when(v.isNull() | F.json_object_keys(content).isNull(), F.lit("malformed")))
    checks = [_dimension_error(v, d) for d in contracts.JUDGE_DIMENSIONS]
    checks += [F.when(notes.isNull(), F.lit("missing:notes")).when(notes != "STRING", F.lit("not_text:notes"))
               .when(F.char_length(transcripts._text(v, "$.notes")) > MAX_NOTES, F.lit("too_long:notes"))]
    score = F.struct(*(transcripts._number(v, f"$.{d}").try_cast("int").alias(d) for d in contracts.JUDGE_DIMENSIONS),
                     transcripts._text(v, "$.notes").alias("notes"))
    return F.struct(score.alias("score"), F.coalesce(error, *checks).alias("error"))


def judge_prompts(responses: DataFrame) -> DataFrame:
    """request_id (the document's id) and the message that asks for a score of its ``response`` struct."""
    return responses.select(F.col("doc_id").alias("request_id"), judge_message(F.col("response")).alias("prompt"))


def judge_replies(responses: DataFrame, completer: completion.Completer, rubric: str, job: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every response (doc_id, response) judged: (doc_id, content, error, mean, the dimensions,
    notes), null scores where there is an error; and the messages that were sent. One round: a
    judge has no tools. A response without a reply has the error 'no_reply'."""
    prompts = judge_prompts(responses)
    done = completion.complete_requests(prompts, completer, {}, rubric, max_turns=1, job=job)
    said = done.completions.select(F.col("request_id").alias("doc_id"), "content", F.lit(True).alias("_there"))
    parsed = responses.select("doc_id").join(said, "doc_id", "left").withColumn(
        "_p", parse_score(F.when(F.col("_there"), F.coalesce("content", F.lit("")))))
    ok = F.col("_p.error").isNull()
    parsed = parsed.select("doc_id", "content", F.col("_p.error").alias("error"),
                           *(F.when(ok, F.col(f"_p.score.{c}")).alias(c) for c in (*contracts.JUDGE_DIMENSIONS, "notes")))
    parsed = parsed.withColumn("mean", F.when(F.col("error").isNull(), judge_mean()))
    return parsed, done.messages


def score_summary(judged: DataFrame) -> DataFrame:
    """A7 over parsed replies, one row: n_traces (scored), n_invalid, mean_score, the dimensions' means."""
    ok = F.col("error").isNull()
    return judged.agg(F.count_if(ok).alias("n_traces"), F.count_if(~ok).alias("n_invalid"), F.avg("mean").alias("mean_score"),
                      *(F.avg(d).alias(d) for d in contracts.JUDGE_DIMENSIONS))
