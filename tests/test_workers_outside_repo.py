import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})          # the driver can import docflow, the workers cannot
from docflow.plans.registry import load_all
from docflow.session import build_session
spark = build_session("outside", cpus=2, shuffle_partitions=2)
qs = load_all()
for name in ("embed_blake2b", "chunk_documents_encoder", "vector_topk", "keyword_topk_stored", "ann_topk", "completion_agent", "boosted_head"):
    n = qs[name].build(spark, "/root/testdata/sf0.001").count()
    print(name, n)
"""


def test_python_worker_code_ships_by_value():
    cwd = tempfile.mkdtemp(prefix="docflow-outside-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                       text=True, timeout=600)
    assert r.returncode == 0, r.stderr[-2000:]
    got = dict(line.split() for line in r.stdout.strip().splitlines())
    assert int(got["embed_blake2b"]) == 200 and int(got["vector_topk"]) == 25  # ids divisible by 100, five each
