"""A stored approximate index of vectors: coarse cells and product-quantised codes.

``build`` fits two small models on a bounded sample (``sample_rows`` rows by hash order: a documented
parameter): cell centres, and code books of what is left of a vector after its cell's centre. Then
every row is indexed: its cell, its code of one byte per sub-space, and the vector itself, in a table
partitioned by cell.

``search`` probes, per query, the nearest cells that hold ``share`` of the rows; cells that no
query of the slice probes are not read (partition pruning). First only keys and codes are read: the
inner product is summed from a query's table of sub-space products. The best ``depth`` rows of a
query are then compared exactly: only their vectors take part. Queries come in slices of bounded
bytes; no (query, row) pair is a row beyond the ``depth`` best of a task.

How much must be probed depends on how clustered the vectors are; ``share`` = 1 probes all cells
and still reads a fraction of the bytes. Recall against the exact search is ``ann.recall_at_k``.
Vectors are taken as unit vectors (inner product order); a cell of any size is split over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.vectors import dot
from docflow.operators.retrieval import MAX_QUERY_BYTES, Floor, topk_per_group
from docflow.session import Shipped, saved, slices_of

SAMPLE_ROWS = 16_384
MAX_CELLS = 256
SUBSPACES = 32
BLOCK_CELLS = 1 << 20


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of ``k`` groups of the rows of ``x`` (a sample), by Lloyd's rounds."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, c, len(centres)) for c in x.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, BLOCK_CELLS // max(1, len(centres)))
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[i:i + step] @ centres.T - half).argmax(1) for i in range(0, len(x), step))])


class Quantiser:
    """Cell centres and code books; ``encode`` and ``tables`` are the two sides of the estimate."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books  # cells x dim, sub-spaces x codes x width

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int, subspaces: int, seed: int = 42) -> Quantiser:
        centres = k_means(sample, cells, 12, seed)
        rest = sample - centres[nearest(sample, centres)]
        parts = rest.reshape(len(rest), subspaces, -1)
        codes = max(1, min(256, len(sample)))
        return cls(centres, np.stack([k_means(parts[:, j], codes, 8, seed + j) for j in range(subspaces)]))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of each row."""
        cell = nearest(x, self.centres)
        parts = (x - self.centres[cell]).reshape(len(x), len(self.books), self.books.shape[2])
        return cell, np.stack([nearest(parts[:, j], b) for j, b in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query's sub-vectors with all code words: queries x sub-spaces x codes."""
        parts = q.reshape(len(q), len(self.books), self.books.shape[2])
        return np.einsum("qjw,jcw->qjc", parts, self.books).astype(np.float32)

    def rows(self) -> list[tuple]:
        return [("centres", list(self.centres.shape), self.centres.ravel().tolist()),
                ("books", list(self.books.shape), self.books.ravel().tolist())]

    @classmethod
    def load(cls, rows: list) -> Quantiser:
        got = {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in rows}
        return cls(got["centres"], got["books"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build(vectors: DataFrame, base: str, key: str, vec: str, dim: int, cells: int | None = None,
          subspaces: int = SUBSPACES, sample_rows: int = SAMPLE_ROWS) -> None:
    """Fit the quantiser on ``sample_rows`` rows and index all rows of ``vectors`` at ``base``.
    ``cells``: an eighth of the sample and ``MAX_CELLS`` at most, unless given."""
    if dim % subspaces:
        raise ValueError("dim must be a multiple of subspaces")
    spark = vectors.sparkSession
    rows = vectors.select(key, F.col(vec).cast("array<double>").alias(vec))
    sample = rows.orderBy(F.xxhash64(key), key).limit(sample_rows).collect()
    sample = np.array([r[vec] for r in sample]).reshape(-1, dim)
    cells = cells or max(1, min(MAX_CELLS, len(sample) // 8))
    model = Quantiser.fit(sample, cells, subspaces) if len(sample) else Quantiser(np.zeros((1, dim)), np.zeros((subspaces, 1, dim // subspaces)))
    spark.createDataFrame(model.rows(), "name string, shape array<int>, numbers array<double>").coalesce(1).write.parquet(f"{base}/model")
    add(rows, base, key, vec)


def add(vectors: DataFrame, base: str, key: str, vec: str) -> None:
    """Index more rows with the stored model."""
    spark = vectors.sparkSession
    model = _model(spark, base)
    dim, kind = model.centres.shape[1], vectors.schema[key].dataType.simpleString()
    shared = Shipped(spark, model)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            cell, code = shared.value.encode(x)
            code = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), code, batch.column(1)], names=["key", "cell", "code", "vec"])

    rows = vectors.select(key, F.col(vec).cast("array<double>").alias("vec"))
    made = rows.mapInArrow(run, f"key {kind}, cell int, code binary, vec array<double>").withColumn("vec", F.col("vec").cast("array<float>"))
    made.hint("rebalance", "cell").sortWithinPartitions("cell", "key").write.mode("append").partitionBy("cell").parquet(f"{base}/rows")
    sizes = made.sparkSession.read.schema(_schema(kind)).parquet(f"{base}/rows").groupBy("cell").agg(F.count("*").alias("n"))
    sizes.coalesce(1).write.mode("overwrite").parquet(f"{base}/sizes")  # a row a cell


def _schema(kind: str) -> str:
    return f"key {kind}, code binary, vec array<float>, cell int"


def _model(spark: SparkSession, base: str) -> Quantiser:
    return Quantiser.load(spark.read.parquet(f"{base}/model").collect())


def probes(model: Quantiser, sizes: dict[int, int], q: np.ndarray, share: float) -> np.ndarray:
    """Which cells each query probes: by inner product with the centre, until they hold ``share``
    of all rows."""
    n = np.array([sizes.get(c, 0) for c in range(len(model.centres))])
    order = np.argsort(-(q @ model.centres.T), axis=1, kind="stable")
    before = np.cumsum(n[order], 1) - n[order]
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, before < share * n.sum(), 1)
    return out & (n > 0)


def _kernel(shared, depth: int):
    def run(batches):
        model, q, probe = shared.value
        table, floor = model.tables(q), Floor(len(q), depth)
        centre = (q @ model.centres.T).astype(np.float32)
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            keys = batch.column("key")
            for cell in np.unique(cells):
                ask, here = np.flatnonzero(probe[:, cell]), np.flatnonzero(cells == cell)
                if not len(ask):
                    continue
                step = max(1, BLOCK_CELLS // len(ask))
                for at in range(0, len(here), step):
                    part = here[at:at + step]
                    s = np.repeat(centre[ask, cell][:, None], len(part), 1)
                    for j in range(table.shape[1]):
                        s += table[ask, j][:, codes[part, j]]
                    row, col = floor.best(s, ask)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ask[row], pa.int32()), pa.array(np.full(len(row), cell), pa.int32()),
                         keys.take(pa.array(part[col])), pa.array(s[row, col], pa.float32())], names=["q", "cell", "key", "about"])
    return run


def search(queries: DataFrame, base: str, key: str, vec: str, k: int = 5, share: float = 0.6, depth: int = 48,
           digits: int = 6, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """Approximate top-k of ``queries`` (<key>, <vec>) in the index at ``base``, without a row's own
    key. Output: query_id, <key>, score (exact, rounded to ``digits``), rank, compared (vectors that were
    compared exactly for the query), probed (share of the rows whose codes were read for it)."""
    spark = queries.sparkSession
    model = _model(spark, base)
    sizes = {r["cell"]: r["n"] for r in spark.read.parquet(f"{base}/sizes").collect()}  # MAX_CELLS at most
    kind = queries.schema[key].dataType.simpleString()
    rows = spark.read.schema(_schema(kind)).parquet(f"{base}/rows")
    asked = saved(queries.select(F.col(key).alias("query_id"), F.col(vec).cast("array<double>").alias("v")), "queries")
    total, out = max(1, sum(sizes.values())), None
    row_bytes = F.size("v") * 8 + model.books.shape[0] * model.books.shape[1] * 4 + 64
    for part in slices_of(asked, "query_id", row_bytes, max_query_bytes):
        got = part.collect()
        q = np.array([r["v"] for r in got], np.float64).reshape(len(got), -1) if got else np.zeros((0, model.centres.shape[1]))
        probe = probes(model, sizes, q, share)
        read = (probe @ np.array([sizes.get(c, 0) for c in range(len(model.centres))])) / total
        shared = Shipped(spark, (model, q, probe))
        wanted = rows.where(F.col("cell").isin(np.flatnonzero(probe.any(0)).tolist() or [-1]))
        near = wanted.select("key", "cell", "code").mapInArrow(_kernel(shared, depth + 1), f"q int, cell int, key {kind}, about float")
        names = spark.createDataFrame([(i, r["query_id"], r["v"], float(p)) for i, (r, p) in enumerate(zip(got, read, strict=True))],
                                      f"q int, query_id {kind}, v array<double>, probed double")
        cand = topk_per_group(near, ["q"], [F.col("about").desc(), F.col("key")], depth + 1).join(F.broadcast(names), "q")
        cand = topk_per_group(cand.where(~F.col("key").eqNullSafe(F.col("query_id"))).drop("rank"), ["q"],
                              [F.col("about").desc(), F.col("key")], depth)
        cand = cand.dropDuplicates(["query_id", "key", "cell"])  # equal keys are met once each below
        cand = saved(cand.select("query_id", "v", "key", "cell", "probed"), "candidates")  # depth rows a query of the slice
        met = wanted.select("cell", "key", "vec").join(F.broadcast(cand), ["cell", "key"])
        met = met.select("query_id", F.col("key").alias(key), F.round(dot(F.col("v"), F.col("vec").cast("array<double>")), digits).alias("score"), "probed")
        out = met if out is None else out.unionByName(met)
    count = out.groupBy("query_id").agg(F.count("*").alias("compared"))
    best = topk_per_group(out.join(count, "query_id"), ["query_id"], [F.col("score").desc(), F.col(key)], k)
    return best.select("query_id", key, "score", "rank", "compared", "probed")

