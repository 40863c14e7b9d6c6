"""Session construction, table loading, partitioning and shared folders."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "docflow", cpus: int | str = "*", shuffle_partitions: int = 8,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, submit with your own conf;
    the operators read nothing from here."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the cluster (a shared filesystem); we only fall back
    to a scratch folder when it is unset, which happens in local tests.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="docflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:  # classic sessions: also the folder for DataFrame.checkpoint()
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        pass
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), "docflow", f"{name}-{uuid.uuid4().hex}")


def job_path(spark: SparkSession, job: str) -> str:
    """The one path of a named job under the shared checkpoint folder: a restarted driver
    finds it again (streaming checkpoints)."""
    return os.path.join(ensure_checkpoint_dir(spark), "docflow", "jobs", job)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet under the shared checkpoint folder and read again: computed
    once, of known size, readable by every executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    """The cluster's task slots (default parallelism), or the shuffle partition count when
    no SparkContext handle exists (Spark Connect)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, split_bytes: int = 16 << 20) -> DataFrame:
    """Spread ``df`` over the cluster's cores when its input is too small to be split over
    them (e.g. one file of one row group), before expensive per-row work such as tokenising
    or regex redaction. Decided from the plan's size estimate alone: nothing runs, and
    inputs of ``split_bytes`` a core or more - the normal case - pass through untouched."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - e.g. Spark Connect: leave partitioning to the engine
        return df
    cores = parallelism(df.sparkSession)
    return df.repartition(cores) if size < cores * split_bytes else df


#: Rows and text bytes that a Python task works on at a time.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def text_slices(texts: pa.Array, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """``texts`` in slices of at most ``rows`` rows and ``size`` bytes (or one longer text), so that a
    task's Python objects are bounded however many rows and bytes an Arrow batch has."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield texts.slice(start, stop - start)
        start = stop


class Shipped:
    """A broadcast object of the package's own classes: pickled by value, so that workers that do not
    have the package can read it; unpickled once a task."""

    def __init__(self, spark: SparkSession, obj):
        self._broadcast, self._held = spark.sparkContext.broadcast(cloudpickle.dumps(obj)), None

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "_held": None}

    @property
    def value(self):
        if self._held is None:
            self._held = pickle.loads(self._broadcast.value)
        return self._held


def slices_of(df: DataFrame, key: str, row_bytes, max_bytes: int) -> list[DataFrame]:
    """``df`` in hash slices of about ``max_bytes`` each (``row_bytes``: a column), so that a
    stated query set of any size can be collected and broadcast block by block."""
    total = df.agg(F.sum(row_bytes)).first()[0] or 0
    n = max(1, -(-int(total) // max_bytes))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint into the shared checkpoint folder (never a local one):
    computes ``df`` once and truncates its lineage, so several consumers read the saved
    partitions and a lost executor does not force recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized from the input volume for a cluster submission (pass them with
    ``--conf``). Shuffle partitions start at input/partition_bytes (at least 3 waves of
    the cluster's cores) and AQE coalesces small ones and splits skewed ones at runtime;
    file splits of half a partition keep scan tasks well inside executor memory."""
    cores = executors * cores_per_executor
    shuffle = max(3 * cores, input_bytes // partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes // 2),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
