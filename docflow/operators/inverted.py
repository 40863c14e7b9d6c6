"""R2, R4 over a stored inverted index: keyword top-k that reads the queries' tokens only.

``build`` writes two tables. ``chunks`` numbers the chunks in (doc_id, chunk_index) order, so a
smaller number wins a tie. ``postings`` has one row per token and block of ``2^BLOCK_BITS``
consecutive numbers: the places in the block whose chunk holds the token. It is partitioned by
a hash of the token and sorted by it, so a search reads the partitions of its tokens and no others.

A search is exact. A token adds at most one hit to a chunk, so the number of a query's tokens
that occur in a block bounds every chunk in it (the block maximum). Three steps:

1. From tokens and blocks alone (places are not read) each query gets the block of its largest
   bound.
2. Scoring these blocks gives each query a threshold: its ``k``-th best chunk there.
3. All blocks are scored, but those whose bound is below the query's threshold (or equal to it,
   with later chunks only) are skipped: no chunk in them can be among the first ``k``.

Queries are collected in slices of bounded bytes, like in ``retrieval``. Blocks meet their
rows in groups of ``2^GROUP_BITS`` blocks: a group holds a bounded number of chunks, whatever the
tokens' frequency. Chunks without a hit rank by number; the first ``2k`` numbers fill them in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.text import keyword_set
from docflow.operators.retrieval import DEFAULT_TOP_K, MAX_QUERY_BYTES, QuerySlice, best_rows, topk_per_group
from docflow.session import Shipped, saved, slices_of, spread

BUCKETS = 64
BLOCK_BITS = 9
GROUP_BITS = 4
POSTINGS = "token string, block bigint, places array<smallint>, bucket int"


def bucket_of(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _block_rows(bits: int, names: list[str]):
    """Arrow batches of chunks in number order -> a row per block: its chunks, and per token its places.
    A block's numbers are consecutive and so in one task; a task holds one block and a batch."""

    def whole(block: int, parts: list) -> pa.RecordBatch:
        mine = pa.Table.from_batches(parts).combine_chunks()
        lists = mine.column("toks").combine_chunks()
        place = (mine.column("number").to_numpy() & ((1 << bits) - 1)).astype(np.int16)[pc.list_parent_indices(lists).to_numpy()]
        held = lists.flatten().dictionary_encode()
        code = held.indices.to_numpy()
        size = np.bincount(code, minlength=len(held.dictionary))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        places = pa.ListArray.from_arrays(ends, pa.array(place[np.argsort(code, kind="stable")]))
        one = lambda cols, named: pa.ListArray.from_arrays(
            pa.array([0, len(cols[0])], pa.int32()), pa.StructArray.from_arrays(cols, named))
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), one([mine.column(c).combine_chunks() for c in names], names),
             one([held.dictionary, places], ["token", "places"])], names=["block", "chunks", "tokens"])

    def run(batches):
        block, parts = None, []
        for batch in batches:
            of = batch.column("number").to_numpy() >> bits
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                if start == stop:
                    continue
                if parts and of[start] != block:
                    yield whole(block, parts)
                    parts = []
                block = int(of[start])
                parts.append(batch.slice(start, stop - start))
        if parts:
            yield whole(block, parts)

    return run


def build(chunks: DataFrame, base: str) -> None:
    """Write the index of ``chunks`` (chunk_id, doc_id, chunk_index, text) at ``base``. Tokens are written
    before the sort, which reads its input twice; a block's postings are made where its chunks are sorted,
    so no (token, chunk) row is shuffled."""
    rows = saved(spread(chunks.select("chunk_id", "doc_id", "chunk_index", keyword_set("text").alias("toks"))), "tokens")
    ordered = rows.orderBy("doc_id", "chunk_index").withColumn("number", F.monotonically_increasing_id())
    names = [c for c in ordered.columns if c != "toks"]
    chunk = ", ".join(f"{c}: {ordered.schema[c].dataType.simpleString()}" for c in names)
    blocks = saved(ordered.mapInArrow(_block_rows(BLOCK_BITS, names), (
        f"block bigint, chunks array<struct<{chunk}>>, tokens array<struct<token: string, places: array<smallint>>>")), "blocks")
    blocks.select(F.inline("chunks")).write.mode("errorifexists").parquet(f"{base}/chunks")
    rows = blocks.select("block", F.inline("tokens")).select("token", "block", "places", bucket_of("token").alias("bucket"))
    (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "block")
         .write.mode("errorifexists").partitionBy("bucket").parquet(f"{base}/postings"))


def postings(spark: SparkSession, base: str, tokens: list[str], columns: tuple[str, ...] = ("block", "places")) -> DataFrame:
    """Rows of ``tokens``: t (the token's place in the list) and ``columns``. Only the tokens'
    partitions are read; the token list is one query slice's and so bounded."""
    wanted = spark.createDataFrame(list(zip(tokens, range(len(tokens)), strict=True)), "token string, t int")
    buckets = [r[0] for r in wanted.select(bucket_of("token")).distinct().collect()]  # BUCKETS at most
    table = spark.read.schema(POSTINGS).parquet(f"{base}/postings").where(F.col("bucket").isin(buckets or [-1]))
    return table.join(F.broadcast(wanted), "token").select("t", *columns)


def _presence(q: QuerySlice, part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, bounds of queries x blocks): how many of a query's tokens occur in a block."""
    blocks, at = np.unique(part["block"].to_numpy(np.int64), return_inverse=True)
    return blocks, q.hits(part["t"].to_numpy(np.int64), at, len(blocks))


def _by_group(rows: DataFrame, kernel, schema: str) -> DataFrame:
    return rows.withColumn("group", F.shiftright("block", GROUP_BITS)).groupBy("group").applyInPandas(kernel, schema)


def _likely_blocks(rows: DataFrame, shared) -> list[tuple[int, int]]:
    """(query's place in the slice, block of its largest bound)."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        blocks, bound = _presence(shared.value, part)
        best = bound.argmax(1)
        most = bound[np.arange(len(bound)), best]
        held = np.flatnonzero(most > 0)
        return pd.DataFrame({"q": held, "block": blocks[best[held]], "bound": most[held]})

    found = _by_group(rows, kernel, "q int, block bigint, bound int")
    best = found.groupBy("q").agg(F.max_by("block", F.struct("bound", -F.col("block"))).alias("block"))
    return [(r["q"], r["block"]) for r in best.collect()]  # one a query of the slice


def _scored(rows: DataFrame, shared, k: int, least: dict[int, tuple[int, int]] | None) -> DataFrame:
    """The ``k`` best chunks with a hit of each query and group: q, number, hits, skipped (blocks
    of the group that the query left out, on its first row). ``least``: per query the hits and the number
    of its ``k``-th best chunk so far."""

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        q = shared.value
        blocks, bound = _presence(q, part)
        hits, last = np.zeros(len(q.ids), np.int64), np.full(len(q.ids), np.iinfo(np.int64).max)
        for i, (n, number) in (least or {}).items():
            hits[i], last[i] = n, number
        low = blocks << BLOCK_BITS
        open_ = (bound > hits[:, None]) | ((bound == hits[:, None]) & (low[None, :] <= last[:, None]))
        open_ &= bound > 0
        out = [pd.DataFrame({"q": [], "number": [], "hits": [], "skipped": []})]
        skipped = ((bound > 0) & ~open_).sum(1)
        best: dict[int, list] = {}
        for block, mine in part.groupby("block"):
            ask = np.flatnonzero(open_[:, np.searchsorted(blocks, block)])
            if not len(ask):
                continue
            sizes = [len(p) for p in mine["places"]]
            token, place = np.repeat(mine["t"].to_numpy(np.int64), sizes), np.concatenate(mine["places"].to_list()).astype(np.int64)
            got = q.hits(token, place, 1 << BLOCK_BITS)[ask]
            row, col = best_rows(got, k)
            real = got[row, col] > 0
            for i, c, n in zip(ask[row[real]].tolist(), col[real].tolist(), got[row[real], col[real]].tolist(), strict=True):
                best.setdefault(i, []).append((-n, (int(block) << BLOCK_BITS) + c))
        for i, found in best.items():
            found = sorted(found)[:k]
            out.append(pd.DataFrame({"q": i, "number": [x for _, x in found], "hits": [-n for n, _ in found],
                                     "skipped": [int(skipped[i])] + [0] * (len(found) - 1)}))
        return pd.concat(out)

    return _by_group(rows, kernel, "q int, number bigint, hits int, skipped int")


def _slice_topk(spark: SparkSession, base: str, rows: list, k: int) -> DataFrame:
    """q, number, hits of the ``k`` best chunks of each query of one slice."""
    q = QuerySlice(rows, 0)
    shared, tokens = Shipped(spark, q), list(q.number)
    likely = _likely_blocks(postings(spark, base, tokens, ("block",)), shared)
    first = sorted({b for _, b in likely})
    seeds = spark.createDataFrame([(b,) for b in first], "block bigint")  # a block a query at most
    some = postings(spark, base, tokens).join(F.broadcast(seeds), "block", "left_semi")
    order = [F.col("hits").desc(), F.col("number")]
    kth = topk_per_group(_scored(some, shared, k, None), ["q"], order, k).where(F.col("rank") == k)
    least = {r["q"]: (r["hits"], r["number"]) for r in kth.collect()}  # one a query of the slice
    found = _scored(postings(spark, base, tokens), shared, k, least)
    fill = [r[0] for r in spark.read.parquet(f"{base}/chunks").select("number").orderBy("number").limit(2 * k).collect()]
    zero = spark.range(len(q.ids)).select(F.col("id").cast("int").alias("q"), F.explode(F.array(
        *[F.lit(n) for n in fill]).cast("array<bigint>")).alias("number"), F.lit(0).alias("hits"), F.lit(0).alias("skipped"))
    all_ = found.unionByName(zero).groupBy("q", "number").agg(F.max("hits").alias("hits"))
    names = spark.createDataFrame([(i, x, float(n)) for i, (x, n) in enumerate(zip(q.ids, q.sizes.tolist(), strict=True))],
                                  f"q int, query_id {_kind(q.ids)}, size double")
    best = topk_per_group(all_, ["q"], order, k).join(F.broadcast(names), "q")
    return best.select("query_id", "number", F.when(F.col("size") > 0, F.col("hits") / F.col("size")).otherwise(0.0).alias("score"), "rank")


def _kind(ids: list) -> str:
    return "string" if any(isinstance(i, str) for i in ids) else "bigint"


def keyword_topk(queries: DataFrame, base: str, k: int = DEFAULT_TOP_K, query_col: str = "query_id",
                 max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """R2+R4 from the index at ``base``: the rows of ``retrieval.keyword_topk`` over its chunks.
    Output: query_id, chunk_id, doc_id, chunk_index, score, rank."""
    spark = queries.sparkSession
    asked = saved(queries.select(F.col(query_col).alias("query_id"), keyword_set("text").alias("toks")), "queries")
    row_bytes = F.coalesce(F.size("toks"), F.lit(0)) * 48 + 64
    blank = {"idx": None, "norm": None}
    found = None
    for part in slices_of(asked, "query_id", row_bytes, max_query_bytes):
        best = _slice_topk(spark, base, [r.asDict() | blank for r in part.collect()], max(k, 1))
        best = saved(best, "best")  # k rows a query of the slice
        named = spark.read.parquet(f"{base}/chunks").join(F.broadcast(best), "number")
        found = named if found is None else found.unionByName(named)
    out = found.select("query_id", "chunk_id", "doc_id", "chunk_index", "score", "rank")
    return out if k > 0 else out.where(F.lit(False))

