import json
import os
import tempfile

from docflow import cli
from tests.test_classifier_sources_streams import CORPUS, LABELS


def _corpus(d):
    os.makedirs(d, exist_ok=True)
    for doc_id, text in CORPUS:
        with open(os.path.join(d, f"{doc_id}.txt"), "w") as fh:
            fh.write(text)


def test_cli_index_and_train_eval(spark, capsys):
    d = tempfile.mkdtemp(prefix="docflow-cli-")
    _corpus(f"{d}/corpus")
    assert cli.main(["index", "--corpus", f"{d}/corpus", "--out", f"{d}/out", "--max-tokens", "4",
                     "--overlap", "1"], spark) == 0
    summary = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert summary["n_documents"] == 9 and summary["uploaded"] == 0
    with open(f"{d}/labels.jsonl", "w") as fh:
        fh.write("\n".join(json.dumps({"doc_id": k, "intent": LABELS[k[0]]}) for k, _ in CORPUS) + "\n")
    rc = cli.main(["train-eval", "--corpus", f"{d}/corpus", "--labels", f"{d}/labels.jsonl",
                   "--gold", f"{d}/labels.jsonl", "--model-dir", f"{d}/model", "--dim", "64"], spark)
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert rc == 0 and out["passed"] and out["n"] == 9


def test_cli_regress_exit_codes(spark, capsys):
    d = tempfile.mkdtemp(prefix="docflow-cli-")
    resp = {"doc_id": "a", "intent": "nda", "confidence": 0.9, "reasoning": "Grounded reasoning text.",
            "citations": [{"chunk_id": "a_chunk_0000", "quote": "q"}]}
    with open(f"{d}/traces.jsonl", "w") as fh:
        fh.write(json.dumps(resp) + "\n\n")
    def scores(v):
        with open(f"{d}/scores.jsonl", "w") as fh:
            fh.write(json.dumps({"doc_id": "a", "intent_correctness": v, "citation_grounding": v,
                                 "field_extraction_quality": v, "conciseness_and_style": v,
                                 "notes": "ok"}) + "\n")
    args = ["regress", "--traces", f"{d}/traces.jsonl", "--scores", f"{d}/scores.jsonl",
            "--baseline", f"{d}/baseline.json", "--generated-at", "2024-01-01"]
    scores(5)
    assert cli.main(args, spark) == 0          # no baseline yet: saved, not a regression
    scores(3)
    assert cli.main(args, spark) == 1          # 3.0 vs 5.0: drop 2.0 > 0.5
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["regressed"] and out["baseline_mean"] == 5.0
    good = {"intent_correctness": 3, "citation_grounding": 3, "field_extraction_quality": "3", "conciseness_and_style": 3, "notes": ""}
    with open(f"{d}/replies.jsonl", "w") as fh:
        for content in (json.dumps(good), "no json", json.dumps(good | {"notes": 5})):
            fh.write(json.dumps({"doc_id": "a", "content": content}) + "\n")
    args[3:5] = ["--replies", f"{d}/replies.jsonl"]
    assert cli.main(args, spark) == 1
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["mean_score"] == 3.0 and out["unusable_replies"] == {"malformed": 1, "not_text:notes": 1}
