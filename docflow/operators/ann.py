"""Approximate nearest neighbours by signed random projections.

Every hash table gives a vector a bucket: the signs of ``bits`` projections. The index is kept
by (table, bucket); a query probes its own bucket and those next to it (the signs of its
least certain projections flipped), so a neighbour is missed only if every table puts it
farther away. Candidates are scored exactly in the task that holds their bucket block and only
``k`` rows per query and block leave it: no candidate pair is a row.

A bucket of any size is split over blocks of the index (a hash of the key), and the queries'
probes are replicated to those blocks; a stated query set is small against the index. Recall
against the exact kernel is measured by ``recall_at_k``. A query finds fewer than ``k``
neighbours only if fewer lie in its probed buckets of all tables.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.operators.retrieval import BLOCK_CELLS, BLOCK_ROWS, best_rows, matrix, topk_per_group


def planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dim))


def _hashed(df: DataFrame, key: str, vec: str, dim: int, tables: int, bits: int, seed: int, probes: int) -> DataFrame:
    """(tbl, bucket, k, v): each vector in its bucket of every table, and in the ``probes``
    buckets that are nearest after it."""
    kind = df.schema[key].dataType.simpleString()
    normals = planes(dim, tables * bits, seed)

    def run(batches):
        for batch in (b.slice(i, BLOCK_ROWS) for b in batches for i in range(0, b.num_rows, BLOCK_ROWS)):
            m = matrix(batch.column(1), batch.num_rows, dim)
            again = pa.array(np.tile(np.arange(len(m)), probes + 1))
            for t in range(tables):
                p = m @ normals[t * bits:(t + 1) * bits].T
                code = (p >= 0) @ (1 << np.arange(bits))
                flips = np.argsort(np.abs(p), axis=1)[:, :probes]
                bucket = np.concatenate([code, *(code ^ (1 << flips[:, j]) for j in range(probes))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bucket), t), pa.int32()), pa.array(bucket, pa.int64()), *(batch.column(c).take(again) for c in (0, 1))],
                    names=["tbl", "bucket", "k", "v"])

    return df.select(key, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(run, f"tbl int, bucket bigint, k {kind}, v array<double>")


def lsh_topk(queries: DataFrame, index: DataFrame, key: str, vec: str, dim: int, k: int = 5, tables: int = 8,
             bits: int = 5, probes: int = 4, blocks: int = 8, seed: int = 42, digits: int = 6) -> DataFrame:
    """Approximate top-k neighbours (excluding itself) of ``queries`` in ``index`` by dot
    product. Output: query_id, <key>, score, rank. ``blocks`` splits every bucket."""
    kind = index.schema[key].dataType.simpleString()
    part = F.pmod("bucket", F.lit(16)).alias("part")   # buckets of one group share a call
    near = _hashed(queries, key, vec, dim, tables, bits, seed, probes)
    near = near.select("*", part, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    held = _hashed(index, key, vec, dim, tables, bits, seed, 0)
    held = held.select("*", part, F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block"))

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], key: [], "score": []})]
        there = dict(list(x.sort_values("k", kind="stable").groupby("bucket")))
        for bucket, mine in q.groupby("bucket"):
            rows = there.get(bucket)
            if rows is None:
                continue
            a, b = (np.stack([np.asarray(v, np.float64) for v in d["v"]]) for d in (mine, rows))
            qk, xk = mine["k"].to_numpy(), rows["k"].to_numpy()
            step = max(1, BLOCK_CELLS // len(a))
            for at in range(0, len(b), step):
                s = np.round(a @ b[at:at + step].T, digits)
                s[qk[:, None] == xk[None, at:at + step]] = -np.inf
                row, col = best_rows(s, k)
                real = np.isfinite(s[row, col])
                out.append(pd.DataFrame({"query_id": qk[row[real]], key: xk[at + col[real]], "score": s[row[real], col[real]]}))
        return pd.concat(out)

    group = ("tbl", "part", "block")
    found = near.groupBy(*group).cogroup(held.groupBy(*group)).applyInPandas(run, f"query_id {kind}, {key} {kind}, score double")
    return topk_per_group(found.distinct(), ["query_id"], [F.col("score").desc(), F.col(key)], k)


def recall_at_k(approx: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """Share of exact top-k neighbours that the approximate list found."""
    hit = exact.join(approx.select("query_id", key).withColumn("_h", F.lit(1)), ["query_id", key], "left")
    return hit.agg((F.count("_h") / F.count(F.lit(1))).alias("recall"))
