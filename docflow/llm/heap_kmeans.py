"""Exact centroid clustering with heap-ordered bounds.

Vectors are whole numbers (floor of ``scale`` times each component), centroids too, so every
distance is exact and ties go to the smaller number. Vectors lie in blocks; a block keeps one
heap per cluster. A vector's heap entry is its gap: the distance to the nearest other centroid
less that to its own, when it was last scanned, plus the drift that its cluster had accumulated
by then. A round adds to a cluster's drift how far its own centroid moved and how far any other
moved at most. Only while the least gap of a heap does not exceed the drift may the vector's
centroid have changed: it is popped, scanned exactly against all centroids, and pushed again.
All others stay untouched.

Sums of the clusters change by the vectors that moved; blocks report these changes, a task
adds them up and Spark sums the tasks'. The driver holds centroids and sums: clusters x
components. Blocks are written once a round in the shared checkpoint folder, and those of the
round before are deleted then.

Bounds are doubles and widened by more than their rounding error; they only decide what is
scanned, never a result.

Defined cases: a vector of another length, or with a null, an infinite component or NaN, is
left out; with fewer vectors than clusters there are as many clusters as vectors; an empty
cluster keeps its centroid; vectors of equal ids each count, a null id is hashed as empty;
numbers beyond 2^27 count as 2^27 (a squared distance must fit a long); sums of distances stop at
the largest long; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import forget, saved

LIMIT = 1 << 27
#: Widens bounds beyond the rounding errors of square roots and sums.
SLACK = 1e-9
STATE = ("x binary, kind string, cluster binary, gaps binary, members binary, sizes binary, moved binary, "
         "rescanned bigint")


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * vectors.astype(np.float64)), -LIMIT, LIMIT).astype(np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x centroids)."""
    far = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    if x.shape[1] * (2 * far) ** 2 < 2**53:  # exact in doubles, as a matrix product
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = (d * d).sum(1)
    return out


class Block:
    """Vectors with their clusters and one heap of (gap, place) per cluster."""

    def __init__(self, x: np.ndarray, clusters: int):
        self.x, self.cluster = x, np.full(len(x), -1, np.int32)
        self.heaps: list[list] = [[] for _ in range(clusters)]
        self.moved = np.zeros((clusters, x.shape[1] + 1), np.int64)
        self.rescanned = 0

    @classmethod
    def load(cls, row: dict, dim: int) -> Block:
        out = cls(np.frombuffer(row["x"], row["kind"]).reshape(-1, dim), len(row["sizes"]) // 4)
        out.cluster = np.frombuffer(row["cluster"], np.int32).copy()
        entries = zip(np.frombuffer(row["gaps"]).tolist(), np.frombuffer(row["members"], np.int32).tolist(), strict=True)
        out.heaps = [[next(entries) for _ in range(n)] for n in np.frombuffer(row["sizes"], np.int32)]
        return out

    def stored(self) -> dict:
        entries = [e for h in self.heaps for e in h]
        return {"x": self.x.tobytes(), "kind": self.x.dtype.str, "cluster": self.cluster.tobytes(),
                "gaps": np.array([g for g, _ in entries], np.float64).tobytes(),
                "members": np.array([m for _, m in entries], np.int32).tobytes(),
                "sizes": np.array([len(h) for h in self.heaps], np.int32).tobytes(),
                "moved": self.moved.tobytes(), "rescanned": self.rescanned}

    def assign(self, centroids: np.ndarray, drift: np.ndarray) -> None:
        """Pop the vectors whose gap has expired (at first: all), scan and push them again."""
        if len(self.x) and self.cluster[0] < 0:
            popped = np.arange(len(self.x))
        else:
            popped = []
            for heap, limit in zip(self.heaps, drift.tolist(), strict=True):
                while heap and heap[0][0] <= limit:
                    popped.append(heapq.heappop(heap)[1])
            popped = np.array(sorted(popped), np.int64)
        self.rescanned = len(popped)
        if not len(popped):
            return
        x = self.x[popped].astype(np.int64)
        d = distances(x, centroids)
        best = d.argmin(1).astype(np.int32)  # of ties the first
        own = np.sqrt(d[np.arange(len(d)), best])
        d[np.arange(len(d)), best] = np.iinfo(np.int64).max
        gaps = np.sqrt(d.min(1)) * (1 - SLACK) - own * (1 + SLACK) + drift[best]
        for entry, c in zip(zip(gaps.tolist(), popped.tolist(), strict=True), best.tolist(), strict=True):
            heapq.heappush(self.heaps[c], entry)
        old = self.cluster[popped]
        changed = np.flatnonzero(old != best)
        rows = np.concatenate([x[changed], np.ones((len(changed), 1), np.int64)], 1)
        np.add.at(self.moved, best[changed], rows)
        gone = old[changed] >= 0
        np.subtract.at(self.moved, old[changed][gone], rows[gone])
        self.cluster[popped] = best

    def distance(self, centroids: np.ndarray) -> np.ndarray:
        """Exact squared distance of each vector to its own centroid."""
        d = self.x.astype(np.int64) - centroids[self.cluster]
        return (d * d).sum(1)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The smallest integer type that holds ``x``."""
    far = np.abs(x).max(initial=0)
    return x.astype(np.int8 if far < 128 else np.int16 if far < 1 << 15 else np.int32)


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int, block: int,
            centroids: np.ndarray) -> DataFrame:
    """The vectors in blocks, assigned for the first time."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                made = Block(_narrow(whole(flat.reshape(-1, dim), scale)), len(centroids))
                made.assign(centroids, np.zeros(len(centroids)))
                ids, new = part.column(0), made.stored()
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([v]) for v in new.values())], names=["ids", *new])

    return vectors.select(id_col, vec_col).mapInArrow(run, f"ids array<{kind}>, {STATE}")


def _next(state: DataFrame, dim: int, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """The blocks after another assignment."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                made = Block.load({c: one.column(c)[0].as_py() for c in ("x", "kind", "cluster", "gaps", "members", "sizes")}, dim)
                made.assign(centroids, drift)
                new = made.stored()
                yield pa.RecordBatch.from_arrays([one.column("ids"), *(pa.array([v]) for v in new.values())], names=["ids", *new])

    return state.mapInArrow(run, state.schema)


def _moved(state: DataFrame, clusters: int, dim: int) -> list[list[int]]:
    """Changes of the clusters' sums (and sizes, last) over all blocks."""

    def run(batches):
        total = np.zeros((clusters, dim + 1), np.int64)
        for batch in batches:
            for m in batch.column("moved"):
                total += np.frombuffer(m.as_py(), np.int64).reshape(total.shape)
        cluster, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()),
                                          pa.array(total[cluster, place])], names=["cluster", "place", "n"])

    parts = state.select("moved").mapInArrow(run, "cluster int, place int, n bigint")
    out = [[0] * (dim + 1) for _ in range(clusters)]
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        out[r["cluster"]][r["place"]] = int(r["n"])
    return out


def kept(vectors: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """The rows whose vector has ``dim`` finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & ~F.exists(vec_col, odd))


def _start(vectors: DataFrame, id_col: str, vec_col: str, clusters: int, scale: int, seed: int) -> np.ndarray:
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    first = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), F.col(vec_col).alias("v")).orderBy("h", "v").limit(clusters)
    return whole(np.array([r["v"] for r in first.collect()], np.float64), scale)


def clusters_of(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, clusters: int = 16,
                rounds: int = 3, scale: int = 64, seed: int = 1, block: int = 4096,
                counts: list | None = None) -> DataFrame:
    """Per kept vector: <id_col>, cluster int, distance long (squared, to its final centroid),
    cluster_inertia, inertia long (summed over its cluster and over all), centroid_sha256.
    ``counts``, if given, receives the number of scanned vectors of each assignment."""
    good = kept(vectors.select(id_col, F.col(vec_col).cast("array<double>").alias(vec_col)), vec_col, dim)
    centroids = _start(good, id_col, vec_col, clusters, scale, seed)
    k = len(centroids)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not k:
        empty = f"{id_col} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    sums, drift = [[0] * (dim + 1) for _ in range(k)], np.zeros(k)
    state = saved(_blocks(good, id_col, vec_col, dim, scale, block, centroids), "kmeans")
    for _ in range(rounds):
        if counts is not None:
            counts.append(state.agg(F.sum("rescanned")).first()[0])
        sums = [[a + b for a, b in zip(s, m, strict=True)] for s, m in zip(sums, _moved(state, k, dim), strict=True)]
        new = np.array([[v // s[-1] for v in s[:-1]] if s[-1] else c for s, c in zip(sums, centroids.tolist(), strict=True)], np.int64)
        step = np.sqrt(((new - centroids).astype(np.float64) ** 2).sum(1))
        others = np.array([np.delete(step, j).max(initial=0) for j in range(k)])
        drift, centroids = drift + (step + others) * (1 + SLACK), new
        after = saved(_next(state, dim, centroids, drift), "kmeans")
        forget(state)
        state = after
    if counts is not None:
        counts.append(state.agg(F.sum("rescanned")).first()[0])

    def out(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("x", "kind", "cluster")}
                b = Block(np.frombuffer(row["x"], row["kind"]).reshape(-1, dim), k)
                b.cluster = np.frombuffer(row["cluster"], np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), pa.array(b.cluster),
                                                  pa.array(b.distance(centroids))], names=["id", "cluster", "distance"])

    found = saved(state.select("ids", "x", "kind", "cluster").mapInArrow(out, f"id {kind}, cluster int, distance bigint"), "kmeans")
    forget(state)
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    inertia = sum(int(r["own"]) for r in each)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = vectors.sparkSession.createDataFrame(
        [(r["cluster"], min(int(r["own"]), (1 << 63) - 1), min(inertia, (1 << 63) - 1), sha[r["cluster"]]) for r in each],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(  # at most ``clusters`` rows
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
