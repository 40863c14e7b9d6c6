import importlib.util
import os

from tests.conftest import SF0001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs_and_contract_is_consistent(spark):
    mod = load_entry()
    df = mod.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "doc_id", "chunk_index", "score", "rank"]
    assert df.count() > 0
    q, sql = mod.queries(), mod.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 40


def test_every_query_builds_a_plan(spark):
    """Every registered query resolves its plan at sf0.001 (analysis only, except the
    streaming and model queries, which execute while building)."""
    mod = load_entry()
    for name, build in mod.queries().items():
        df = build(spark, SF0001)
        assert df.schema is not None, name
