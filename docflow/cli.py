"""Command line for the batch jobs: ``python -m docflow.cli <command> ...``.

Commands read and write through Spark, print one JSON summary line, and exit non-zero
when a gate fails (macro-F1 below the floor, judge regression), like the scheduled jobs
they replace.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from docflow import contracts
from docflow.operators import judging, metrics
from docflow.plans import jobs
from docflow.session import build_session
from docflow.sources import files


def _row(df) -> dict:
    r = df.first()
    return {} if r is None else r.asDict(recursive=True)


def cmd_index(spark, a) -> int:
    s = jobs.index_job(spark, a.corpus, a.out, push=a.push, max_tokens=a.max_tokens,
                       overlap_tokens=a.overlap, dim=a.dim, buckets=a.buckets)
    print(json.dumps(_row(s)))
    return 0


def cmd_train_eval(spark, a) -> int:
    docs = files.read_corpus(spark, a.corpus)
    labels = files.load_labels_last_wins(spark, a.labels)[0].withColumnRenamed("intent", "label")
    gold, bad = files.load_intents(spark, a.gold)
    if bad.limit(1).count():
        print(json.dumps({"error": "unknown intent in gold file"}))
        return 2
    ev = jobs.train_evaluate_job(spark, docs, labels, gold.withColumnRenamed("intent", "label"),
                                 a.model_dir, dim=a.dim, floor=a.min_macro_f1)
    out = _row(ev)
    print(json.dumps(out))
    return 0 if out.get("passed") else 1


def cmd_regress(spark, a) -> int:
    traces = spark.read.text(a.traces).where(F.length(F.trim("value")) > 0) \
                  .select(F.col("value").alias("response"))
    if traces.limit(1).count() == 0:
        print(json.dumps({"error": "no traces to score"}))
        return 1
    bad = None
    if a.replies:
        replies = spark.read.schema("doc_id string, content string").json(a.replies)
        parsed = replies.select("doc_id", judging.parse_score(F.col("content")).alias("p"))
        scores = parsed.where(F.col("p.error").isNull()).select("doc_id", "p.score.*")
        bad = {r["error"]: r["count"] for r in parsed.groupBy(F.col("p.error").alias("error")).count().where("error IS NOT NULL").collect()}
    else:
        scores = files.read_jsonl(spark, a.scores, contracts.JUDGE_SCORE)
    header, _per_doc = jobs.regression_job(spark, traces, scores, a.baseline, a.generated_at,
                                           a.threshold)
    out = _row(header)
    if bad is not None:
        out["unusable_replies"] = bad  # an entry a kind of error
    print(json.dumps(out, default=str))
    return 1 if out.get("regressed") else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docflow")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="chunk a corpus folder, write chunks + manifest [+ index]")
    i.add_argument("--corpus", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--push", action="store_true")
    i.add_argument("--max-tokens", type=int, default=400)
    i.add_argument("--overlap", type=int, default=40)
    i.add_argument("--dim", type=int, default=384)
    i.add_argument("--buckets", type=int, help="push into a bucketed table of so many buckets")
    t = sub.add_parser("train-eval", help="train the classifier head, evaluate, gate on macro-F1")
    t.add_argument("--corpus", required=True)
    t.add_argument("--labels", required=True)
    t.add_argument("--gold", required=True)
    t.add_argument("--model-dir", required=True)
    t.add_argument("--dim", type=int, default=256)
    t.add_argument("--min-macro-f1", type=float, default=metrics.MACRO_F1_FLOOR)
    r = sub.add_parser("regress", help="judge-score traces and compare with the baseline")
    r.add_argument("--traces", required=True)
    told = r.add_mutually_exclusive_group(required=True)
    told.add_argument("--scores", help="JSON lines of scores")
    told.add_argument("--replies", help="JSON lines of the judge's replies: doc_id, content")
    r.add_argument("--baseline", required=True)
    r.add_argument("--generated-at", required=True)
    r.add_argument("--threshold", type=float, default=0.5)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or build_session("docflow-cli")
    return {"index": cmd_index, "train-eval": cmd_train_eval, "regress": cmd_regress}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())
