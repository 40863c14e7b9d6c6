import pytest
from pyspark.sql import functions as F

from docflow import session
from tests.conftest import rows


def test_spread_runs_nothing_and_leaves_large_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert session.spread(one).rdd.getNumPartitions() == cores
    assert session.spread(one, split_bytes=1).rdd.getNumPartitions() == 1
    ran = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    session.spread(one.groupBy((F.col("id") % 3).alias("k")).count())
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == ran


def test_slices_cover_the_frame(spark):
    df = spark.range(50)
    for max_bytes in (100, 1 << 30):
        parts = session.slices_of(df, "id", F.lit(10), max_bytes)
        assert sorted(r.id for p in parts for r in p.collect()) == list(range(50))
    assert len(session.slices_of(df.limit(0), "id", F.lit(10), 1)) == 1


def test_cut_and_saved_keep_rows(spark):
    df = spark.range(50).withColumn("sq", F.col("id") * F.col("id"))
    assert rows(session.cut(df)) == rows(df)
    m = session.saved(df, "test-mat")
    assert rows(m) == rows(df)
    assert spark.conf.get("spark.checkpoint.dir") in m.inputFiles()[0]


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_cluster_conf_scales_with_input():
    small = session.cluster_conf(10 << 30, 10, 4)
    big = session.cluster_conf(100 << 40, 1000, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 120          # 3 waves of 40 cores
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
