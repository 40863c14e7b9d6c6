"""S8, S9, ST2: a keyed table in hash buckets with copy-on-write of the touched ones.

A key belongs to one of ``buckets`` buckets. A commit merges its rows into the buckets that hold their
keys and writes only those, under the commit's number (``_v=<n>/bucket=<b>``); every other bucket
stays the file it was. A manifest per commit says which number each bucket has now, and a pointer
says which manifest is live: readers see whole commits only, and a commit that fails leaves the
live one as it was. The cost of a commit follows the buckets it touches, not the table.

``retire`` deletes bucket files that none of the last manifests names. Deltas (``append_delta``) are a
log beside the buckets, one folder per batch id; ``fold`` merges them into the buckets and its
manifest records up to which id, so that readers and replayed batches know which deltas count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.session import saved
from docflow.sources.files import current, exists, set_current, upsert

BUCKETS = 256


class BucketTable:
    """The table at ``base``: rows of ``schema`` with one row per ``key``, the highest ``version`` wins."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, key: str = "chunk_id",
                 version: str = "version", buckets: int = BUCKETS):
        if buckets < 1:
            raise ValueError("a table has at least one bucket")
        self.spark, self.base, self.schema = spark, base, schema
        self.key, self.version, self.buckets = key, version, buckets

    # -- manifests ------------------------------------------------------------------------------
    def _path(self, n: int) -> str:
        return f"{self.base}/manifests/{n}"

    def number(self) -> int:
        """The live commit's number, 0 for a new table."""
        live = current(self.spark, self.base)
        return int(live.rsplit("/", 1)[1]) if live else 0

    def manifest(self, n: int | None = None) -> tuple[dict[int, int], int]:
        """(bucket -> commit that wrote it, highest folded batch id or -1) of commit ``n``, else the live one."""
        n = self.number() if n is None else n
        if not n:
            return {}, -1
        rows = self.spark.read.schema("bucket int, v int, folded bigint").parquet(self._path(n)).collect()  # a row a bucket
        return {r["bucket"]: r["v"] for r in rows if r["bucket"] >= 0}, max((r["folded"] for r in rows), default=-1)

    def _commit(self, n: int, held: dict[int, int], folded: int) -> None:
        rows = [(b, v, folded) for b, v in sorted(held.items())] or [(-1, 0, folded)]
        self.spark.createDataFrame(rows, "bucket int, v int, folded bigint").coalesce(1).write.mode("overwrite").parquet(self._path(n))
        set_current(self.spark, self.base, self._path(n))

    # -- rows -------------------------------------------------------------------------------------
    def bucket_of(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, held: dict[int, int], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.base}/rows/_v={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in set(only)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The rows of the live commit."""
        return self._rows(self.manifest()[0])

    def lookup(self, keys: list) -> DataFrame:
        """The rows of a bounded list of keys; only their buckets are read."""
        kind = self.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, kind)]))
        only = [r[0] for r in asked.select(self.bucket_of()).distinct().collect()]
        return self._rows(self.manifest()[0], only).join(F.broadcast(asked.distinct()), self.key, "left_semi")

    def upsert(self, rows: DataFrame, folded: int | None = None) -> list[int]:
        """Merge ``rows`` and commit; the buckets that were written."""
        held, before = self.manifest()
        n = self.number() + 1
        folded = before if folded is None else folded
        new = saved(rows.select(*self.schema.names).withColumn("_b", self.bucket_of()), "batch")
        touched = sorted(r[0] for r in new.select("_b").distinct().collect())  # ``buckets`` at most
        if touched:
            merged = upsert(self._rows(held, touched), new.drop("_b"), self.key, self.version)
            out = merged.select(*self.schema.names).withColumn("bucket", self.bucket_of()).withColumn("_v", F.lit(n))
            (out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy("_v", "bucket").parquet(f"{self.base}/rows"))
        if touched or folded != before:
            self._commit(n, held | dict.fromkeys(touched, n), folded)
        return touched

    # -- deltas -----------------------------------------------------------------------------------
    def _deltas(self) -> list[int]:
        return [i for i in self._listed(f"{self.base}/delta", "") if exists(self.spark, f"{self.base}/delta/{i}/_SUCCESS")]

    def _listed(self, folder: str, prefix: str) -> list[int]:
        if not exists(self.spark, folder):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [f.getPath().getName() for f in found]
        return sorted(int(x[len(prefix):]) for x in names if x.startswith(prefix) and x[len(prefix):].isdigit())

    def append_delta(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch beside the buckets; a replayed batch overwrites its own folder."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.base}/delta/{batch_id}")

    def read_all(self) -> DataFrame:
        """Buckets and the deltas that are not folded yet, one row per key."""
        held, folded = self.manifest()
        open_ = [f"{self.base}/delta/{i}" for i in self._deltas() if i > folded]
        rows = self._rows(held)
        if not open_:
            return rows
        return upsert(rows, self.spark.read.schema(self.schema).parquet(*open_), self.key, self.version).select(*self.schema.names)

    def fold(self) -> list[int]:
        """Merge the open deltas into the buckets, commit, and delete all folded deltas; the buckets
        that were written."""
        _, folded = self.manifest()
        known = self._deltas()
        open_ = [i for i in known if i > folded]
        touched = []
        if open_:
            rows = self.spark.read.schema(self.schema).parquet(*(f"{self.base}/delta/{i}" for i in open_))
            touched = self.upsert(rows, folded=open_[-1])
        for i in known:  # the commit stands: these count no more
            self._delete(f"{self.base}/delta/{i}")
        return touched

    # -- clean-up -----------------------------------------------------------------------------------
    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def files(self) -> dict[int, list[str]]:
        """Bucket -> its live files."""
        out: dict[int, list[str]] = {}
        for name in self._rows(self.manifest()[0]).inputFiles():
            out.setdefault(int(name.split("/bucket=")[1].split("/")[0]), []).append(name)
        return out

    def retire(self, keep: int = 2) -> int:
        """Delete bucket folders that none of the last ``keep`` commits names; how many."""
        live = self.number()
        wanted = {(v, b) for n in range(max(1, live - keep + 1), live + 1) for b, v in self.manifest(n)[0].items()}
        gone = 0
        for v in self._listed(f"{self.base}/rows", "_v="):
            if v > live:
                continue  # a commit under way
            for b in self._listed(f"{self.base}/rows/_v={v}", "bucket="):
                if (v, b) not in wanted:
                    self._delete(f"{self.base}/rows/_v={v}/bucket={b}")
                    gone += 1
        return gone
