"""The whole completion loop over all requests at once.

A round asks the completer for the next turn of every request that is still open, answers the
tool calls of those turns, appends the messages, and goes on with the requests that asked for
tools: the active set shrinks from round to round, and there are at most ``max_turns`` rounds.
The driver loops over rounds, never over requests; it learns one bit a round (anything left?).

Completions cost money and time, so each round's turns and tool results are written before
they are used. With ``job`` they lie under that name in the shared checkpoint folder: a
restarted driver takes whole rounds from there and asks only for the rest.

A completer is a function (messages, turn) -> completions: one row per request of ``messages``
(request_id, turn, content, tool_calls, tokens_in, tokens_out, model, finish_reason). A request
that it leaves out has failed upstream; it is not asked again and folds to 'exhausted'.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators import transcripts
from docflow.session import job_path, scratch_path
from docflow.sources.files import exists

Completer = Callable[[DataFrame, int], DataFrame]


@dataclass
class Conversation:
    """What a loop leaves: ``completions`` (all turns, for ``fold_transcripts``), ``results``
    (all tool results), ``messages`` (the whole lists, long form) and the rounds' sizes."""

    completions: DataFrame
    results: DataFrame
    messages: DataFrame
    rounds: int
    reused: list[int] = field(default_factory=list)


def from_recorded(recorded: DataFrame) -> Completer:
    """A completer that replays recorded turns: request by request and turn by turn."""
    first = transcripts.first_delivery(recorded)

    def completer(messages: DataFrame, turn: int) -> DataFrame:
        asked = messages.select("request_id").distinct()
        return first.where(F.col("turn") == turn).join(asked, "request_id", "left_semi")

    return completer


def from_function(fn) -> Completer:
    """A completer around ``fn(list of messages) -> dict`` (see ``transcripts.complete``): runs
    once per open request and round, in Arrow tasks."""
    return lambda messages, turn: transcripts.complete(messages, fn)


def _round(df: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """``df`` written at ``path``, or what lies there whole already."""
    spark = df.sparkSession
    there = exists(spark, f"{path}/_SUCCESS")
    if not there:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), there


def complete_requests(prompts: DataFrame, completer: Completer, registry: dict, system: str,
                      max_turns: int = transcripts.MAX_TURNS, job: str | None = None) -> Conversation:
    """Run every request of ``prompts`` (request_id, prompt) to its answer.

    Per round: complete the open requests, dispatch their tool calls through ``registry``
    (errors and unknown tools answer with their error), append the assistant's message, each
    result in call order and, after the last allowed turn, the cap message."""
    if max_turns < 1:
        raise ValueError("max_turns must be at least 1")
    spark = prompts.sparkSession
    base = job_path(spark, job) if job else scratch_path(spark, "loop")
    cols = transcripts.MESSAGE_COLUMNS
    opening = transcripts.opening_messages(prompts, system)
    parts, turns, results, reused = [opening], [], [], []
    open_ids = None
    for turn in range(max_turns):
        history = transcripts.union_all(parts)
        if open_ids is not None:
            history = history.join(open_ids, "request_id", "left_semi")
        said, there = _round(completer(history.select(*cols), turn).where(F.col("turn") == turn), f"{base}/turn-{turn}")
        if there:
            reused.append(turn)
        turns.append(said)
        asked = said.where(F.size(F.coalesce("tool_calls", F.array().cast(transcripts._TC))) > 0)
        if asked.isEmpty():
            break
        calls = asked.select("request_id", F.col("turn").cast("bigint").alias("turn"), F.posexplode("tool_calls").alias("pos", "tc"))
        calls = calls.withColumn("pos", F.col("pos").cast("bigint"))
        told, _ = _round(transcripts.run_calls(calls, registry), f"{base}/results-{turn}")
        results.append(told)
        parts += transcripts.turn_messages(asked, told, cap=turn == max_turns - 1)
        open_ids = asked.select("request_id")
    calls_schema = "request_id " + prompts.schema["request_id"].dataType.simpleString() + (
        ", turn bigint, pos bigint, call_id string, name string, result string")
    told = transcripts.union_all(results) if results else spark.createDataFrame([], calls_schema)
    return Conversation(transcripts.union_all(turns), told, transcripts.union_all(parts).select(*cols), len(turns), reused)
