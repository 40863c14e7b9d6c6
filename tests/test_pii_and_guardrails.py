import re

from docflow.functions import pii
from docflow.functions.text import normalize_ws
from docflow.operators import guardrails
from tests.conftest import rows

# Python model of the redaction contract (same patterns, Python `re`).
_E = re.compile(pii.EMAIL_PATTERN)
_C = re.compile(pii.CARD_PATTERN)
_P = re.compile(pii.PHONE_PATTERN)


def py_redact(t):
    return _P.sub("[PHONE]", _C.sub("[CARD]", _E.sub("[EMAIL]", t)))


CASES = [
    "Contact jane.doe@example.com for details.",
    "Call +14155552671 tomorrow",
    "Card 4111 1111 1111 1111 on file",
    "Nothing sensitive here.",
    "run 12345678901234567 stays",          # 17-digit run: neither card nor phone
    "two phones 5551234567,5559876543 end",
    "mixed a@b.io and 4111-1111-1111-1111 and (555) 123-4567",
    "",
]


def test_redaction_matches_python_model(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    got = dict(rows(df.select("i", pii.redact("t").alias("r"))))
    for i, t in enumerate(CASES):
        assert got[i] == py_redact(t), t
    assert got[0] == "Contact [EMAIL] for details."
    assert got[1] == "Call [PHONE] tomorrow"
    assert got[2] == "Card [CARD] on file"
    assert got[3] == CASES[3]
    assert got[4] == CASES[4]


def test_normalize_and_contains(spark):
    df = spark.createDataFrame([("A  b\n\tC ", "a b c", "")], "h string, q string, blank string")
    r = df.select(normalize_ws("h").alias("n"),
                  guardrails.contains_normalized("h", "q").alias("hit"),
                  guardrails.contains_normalized("h", "blank").alias("blank_hit")).first()
    assert r.n == "a b c" and r.hit and r.blank_hit


def test_safety_blocklist(spark):
    df = spark.createDataFrame([("a fine answer",), ("we will KILL the process",),
                                ("a skill set",), ("charm it",), (None,)], "t string")
    got = [r.u for r in df.select(guardrails.unsafe("t").alias("u")).collect()]
    assert got == [False, True, True, True, False]


def test_severity_threshold(spark):
    df = spark.createDataFrame([
        ([("hate", 4)],), ([("hate", 3), ("violence", None)],), ([],), (None,)],
        "categories array<struct<category:string,severity:int>>")
    got = [r.b for r in df.select(guardrails.severity_blocked("categories").alias("b")).collect()]
    assert got == [True, False, False, False]


def _responses(spark, data):
    return spark.createDataFrame(data, "request_id string, intent string, "
                                 "citations array<struct<chunk_id:string,quote:string>>, "
                                 "extracted_fields array<struct<name:string,value:string,"
                                 "citations:array<struct<chunk_id:string,quote:string>>>>")


def test_citation_verdicts(spark):
    passages = spark.createDataFrame([
        ("r1", "c1", "The term is  TWELVE months."), ("r1", "c2", "Payment net 30."),
        ("r2", "c9", "Other request passage."),
    ], "request_id string, chunk_id string, text string")
    resp = _responses(spark, [
        ("r1", "nda", [("c1", "the term is twelve months")], []),                 # ok
        ("r2", "nda", [("c1", "The term")], []),                                  # another request's chunk
        ("r3", "other", [], []),                                                  # none, intent other
        ("r4", "msa", [], []),                                                    # none -> fail
        ("r5", "nda", [("c1", "invented")], []),                                  # unknown (no passages)
        ("r1", "msa", [("c2", "net 30")], [("f", "v", [("c1", "invented quote")])]),
    ])
    # r1 appears twice (two responses for one request id): keep them apart via intent
    v = {(r.request_id, r.n_citations): (r.ok, r.violation)
         for r in guardrails.citation_verdict(resp, passages).collect()}
    assert v[("r2", 1)] == (False, "unknown_chunk")
    assert v[("r3", 0)] == (True, None)
    assert v[("r4", 0)] == (False, "no_citations")
    assert v[("r5", 1)] == (False, "unknown_chunk")
    assert v[("r1", 2)] == (False, "quote_not_found")
    assert v[("r1", 1)] == (True, None)


def test_blank_quote_matches(spark):
    passages = spark.createDataFrame([("r", "c", "text")], "request_id string, chunk_id string, text string")
    resp = _responses(spark, [("r", "nda", [("c", " ")], [])])
    assert guardrails.citation_verdict(resp, passages).first().ok


def test_redaction_equals_the_plain_patterns(spark):
    import random

    from pyspark.sql import functions as F

    r = random.Random(11)
    part = ["+", "1", "234", "5551234567", " ", "-", "(", ")", "a", "b@c.io", "@", ".", "x_y@z.org", "\u0663", "\u00e9", "\n", "4111 1111 1111 1111"]
    texts = ["".join(r.choice(part) for _ in range(r.randint(0, 25))) for _ in range(3000)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = F.col("t")
    for pattern, mask in ((pii.EMAIL_PATTERN, pii.EMAIL_MASK), ("(?U)" + pii.CARD_PATTERN, pii.CARD_MASK), ("(?U)" + pii.PHONE_PATTERN, pii.PHONE_MASK)):
        plain = F.regexp_replace(plain, F.lit(pattern), F.lit(mask))
    assert df.where(~pii.redact("t").eqNullSafe(plain)).count() == 0


def test_redaction_looks_for_the_mark_first(spark):
    """An address is only searched in a text with an @, a phone number only where one can start."""
    plan = spark.createDataFrame([("x",)], "t string").select(pii.redact("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(t" in plan.replace("contains", "Contains") and "(?=[+\\d])" in plan


def test_upsert_redacts_before_the_chunkers_filters(spark):
    """The chunker's filters on the redacted text would each redact again."""
    from docflow.plans import q_index

    plan = q_index.upsert_index(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
