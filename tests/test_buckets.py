import pytest
from pyspark.sql import functions as F

from docflow.session import scratch_path
from docflow.sources.buckets import BucketTable
from tests.conftest import rows

SCHEMA = "chunk_id string, text string, version bigint"


def _table(spark, buckets=8):
    empty = spark.createDataFrame([], SCHEMA)
    return BucketTable(spark, scratch_path(spark, "bucket-test"), empty.schema, buckets=buckets)


def _rows(spark, ids, text, version):
    return spark.createDataFrame([(f"c{i}", f"{text}{i}", version) for i in ids], SCHEMA)


def test_a_commit_writes_only_the_buckets_of_its_keys(spark):
    t = _table(spark)
    assert t.read().count() == 0 and t.number() == 0 and t.manifest() == ({}, -1)
    t.upsert(_rows(spark, range(100), "a", 1))
    before = t.files()
    assert len(before) == 8
    touched = t.upsert(_rows(spark, [3], "b", 2))
    after = t.files()
    assert len(touched) == 1 and all(after[b] == before[b] for b in before if b not in touched)
    assert not set(after[touched[0]]) & set(before[touched[0]])
    got = {r["chunk_id"]: r for r in t.read().collect()}
    assert len(got) == 100 and got["c3"]["text"] == "b3" and got["c4"]["text"] == "a4"
    t.upsert(_rows(spark, [3], "older", 1))  # a lower version loses
    assert {r["text"] for r in t.lookup(["c3", "c4", "nobody"]).collect()} == {"b3", "a4"}
    assert t.upsert(_rows(spark, [], "x", 9)) == [] and t.number() == 3


def test_old_files_stay_for_readers_until_they_are_retired(spark):
    t = _table(spark, 4)
    t.upsert(_rows(spark, range(20), "a", 1))
    old = t.read()
    t.upsert(_rows(spark, range(20), "b", 2))
    assert t.retire(keep=2) == 0 and {r["text"][0] for r in old.collect()} == {"a"}
    assert t.retire(keep=1) == 4 and {r["text"][0] for r in t.read().collect()} == {"b"}


def test_a_failed_commit_leaves_the_live_one(spark, monkeypatch):
    t = _table(spark, 4)
    t.upsert(_rows(spark, range(20), "a", 1))
    monkeypatch.setattr(t, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        t.upsert(_rows(spark, range(20), "b", 2))
    monkeypatch.undo()
    assert t.number() == 1 and {r["text"][0] for r in t.read().collect()} == {"a"}
    t.upsert(_rows(spark, [1], "c", 3))  # takes the number anew; the leftovers count for nothing
    assert sorted(r["text"][0] for r in t.read().collect()) == ["a"] * 19 + ["c"]


def test_deltas_are_read_folded_once_and_retired(spark):
    t = _table(spark, 4)
    t.upsert(_rows(spark, range(10), "a", 0))
    t.append_delta(_rows(spark, [1, 20], "b", 1), 0)
    t.append_delta(_rows(spark, [1], "c", 2), 1)
    want = rows(t.read_all(), "chunk_id", "text")
    assert ("c1", "c1") in want and ("c20", "b20") in want and len(want) == 11
    assert rows(t.read(), "chunk_id", "text") != want
    t.fold()
    assert rows(t.read(), "chunk_id", "text") == want and t._deltas() == [] and t.manifest()[1] == 1
    t.append_delta(_rows(spark, [1, 20], "b", 1), 0)  # the folded batch is replayed
    assert rows(t.read_all(), "chunk_id", "text") == want
    n = t.number()
    assert t.fold() == [] and t.number() == n and t._deltas() == []
    t.append_delta(_rows(spark, [], "x", 3), 2)  # an empty batch
    assert t.fold() == [] and t.manifest()[1] == 2 and rows(t.read(), "chunk_id", "text") == want


def test_copies_of_a_key_in_one_batch(spark):
    t = _table(spark, 2)
    t.upsert(_rows(spark, [1], "a", 1).unionByName(_rows(spark, [1], "b", 5)).withColumn("extra", F.lit(1)))
    assert rows(t.read()) == [("c1", "b1", 5)]
    with pytest.raises(ValueError):
        _table(spark, 0)
