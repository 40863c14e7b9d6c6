"""Schemas (StructTypes), the intent enum, and rule-based validation (V1, V2, V5, V9).

A rule is (code, failing-condition Column). ``with_errors`` adds an ``errors`` array of
the codes of failed rules; ``split_valid`` returns (valid, quarantine). Invalid rows are
never dropped silently: they go to the quarantine frame with their codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed set of intents, in declaration order.
INTENTS = ("nda", "msa", "purchase_order", "rfp", "termination", "price_change", "other")
ROUTES = ("fast", "escalate_to_reason")

CITATION = T.StructType([T.StructField("chunk_id", T.StringType()),
                         T.StructField("quote", T.StringType())])
FIELD = T.StructType([T.StructField("name", T.StringType()),
                      T.StructField("value", T.StringType()),
                      T.StructField("citations", T.ArrayType(CITATION))])
TOOL_CALL = T.StructType([T.StructField("id", T.StringType()),
                          T.StructField("name", T.StringType()),
                          T.StructField("arguments", T.StringType())])

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
])
CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("n_tokens", T.LongType()),
])
GOLD_INTENT = T.StructType([T.StructField("doc_id", T.StringType()),
                            T.StructField("intent", T.StringType())])
GOLD_FIELDS = T.StructType([T.StructField("doc_id", T.StringType()),
                            T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
JUDGE_PROMPT = T.StructType([T.StructField("doc_id", T.StringType()),
                             T.StructField("prompt", T.StringType()),
                             T.StructField("reference_intent", T.StringType())])
COMPLETION = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("turn", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
    T.StructField("tokens_in", T.IntegerType()),
    T.StructField("tokens_out", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("finish_reason", T.StringType()),
])
RESPONSE = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("extracted_fields", T.ArrayType(FIELD)),
    T.StructField("citations", T.ArrayType(CITATION)),
    T.StructField("tools_used", T.ArrayType(T.StringType())),
    T.StructField("model_version", T.StringType()),
    T.StructField("tokens_in", T.IntegerType()),
    T.StructField("tokens_out", T.IntegerType()),
    T.StructField("latency_ms", T.DoubleType()),
])
RESPONSE_KEYS = tuple(f.name for f in RESPONSE.fields)
JUDGE_SCORE = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("intent_correctness", T.IntegerType()),
    T.StructField("citation_grounding", T.IntegerType()),
    T.StructField("field_extraction_quality", T.IntegerType()),
    T.StructField("conciseness_and_style", T.IntegerType()),
    T.StructField("notes", T.StringType()),
])
JUDGE_DIMENSIONS = ("intent_correctness", "citation_grounding", "field_extraction_quality",
                    "conciseness_and_style")
TRACE = T.StructType([T.StructField("timestamp", T.TimestampType()),
                      T.StructField("name", T.StringType()),
                      T.StructField("customDimensions", T.StringType())])

Rule = tuple[str, Column]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def length_between(col, lo: int | None = None, hi: int | None = None) -> Column:
    """Failing condition for a string length constraint (null fails)."""
    n = F.char_length(_c(col))
    bad = _c(col).isNull()
    if lo is not None:
        bad = bad | (n < lo)
    if hi is not None:
        bad = bad | (n > hi)
    return bad


def out_of_range(col, lo=None, hi=None, lo_strict=False) -> Column:
    bad = _c(col).isNull()
    if lo is not None:
        bad = bad | ((_c(col) <= lo) if lo_strict else (_c(col) < lo))
    if hi is not None:
        bad = bad | (_c(col) > hi)
    return bad


def not_intent(col) -> Column:
    """V2: enum membership (null counts as unknown)."""
    return ~F.coalesce(_c(col).isin(*INTENTS), F.lit(False))


def document_rules() -> list[Rule]:
    return [("doc_id_null", F.col("doc_id").isNull()),
            ("text_empty", length_between("text", lo=1))]


def chunk_rules() -> list[Rule]:
    return [("chunk_index_negative", out_of_range("chunk_index", lo=0)),
            ("text_empty", length_between("text", lo=1)),
            ("n_tokens_not_positive", out_of_range("n_tokens", lo=0, lo_strict=True))]


def classify_rules() -> list[Rule]:
    return [("intent_unknown", not_intent("intent")),
            ("confidence_out_of_range", out_of_range("confidence", 0.0, 1.0)),
            ("route_unknown", ~F.coalesce(F.col("route").isin(*ROUTES), F.lit(False))),
            ("latency_negative", out_of_range("latency_ms", lo=0.0))]


def judge_rules() -> list[Rule]:
    """V5: four integer scores in 1..5 and notes of at most 400 characters."""
    return ([(f"{d}_out_of_range", out_of_range(d, 1, 5)) for d in JUDGE_DIMENSIONS]
            + [("notes_too_long", F.col("notes").isNull() | (F.char_length("notes") > 400))])


def errors_col(rules: list[Rule]) -> Column:
    """Codes of the failed rules, in rule order (empty array when valid)."""
    if not rules:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]),
                    lambda x: x.isNotNull())


def with_errors(df: DataFrame, rules: list[Rule], col: str = "errors") -> DataFrame:
    return df.withColumn(col, errors_col(rules))


def split_valid(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the errors column, quarantined rows with it)."""
    checked = with_errors(df, rules)
    return (checked.where(F.size("errors") == 0).drop("errors"),
            checked.where(F.size("errors") > 0))
