"""Exact retrieval of a stated query set against the whole index.

The queries are collected in slices of bounded bytes and broadcast; the index streams
through the tasks once per slice. A task splits the texts of a block of index rows and looks
all their words up at once among the queries' tokens, scores the block against all queries
of the slice (postings of the queries' tokens for the keyword overlap R2, a matrix product for
the cosine R1), blends both (R3) and emits only the block's best ``k`` rows per query, so no
(query, chunk) pair is ever a row. The final top-k is ``row_number() <= k``, which Spark
limits per partition before the shuffle. Every chunk is ranked, zero scores too; ties break
by (doc_id, chunk_index).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.functions.text import GROWS, keyword_set, may_meet_shorter
from docflow.session import saved, slices_of, text_slices

DEFAULT_TOP_K = 5
DEFAULT_VECTOR_WEIGHT = 0.7
CHUNK_ORDER = ("doc_id", "chunk_index")
MAX_QUERY_BYTES = 64 << 20
BLOCK_CELLS, BLOCK_ROWS, BLOCK_BYTES = 2 << 20, 1024, 4 << 20


def check_vector_weight(w: float) -> None:
    """V8."""
    if not 0.0 <= w <= 1.0:
        raise ValueError("vector_weight must be in [0, 1]")


def topk_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                   rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per group under ``order``; adds ``rank`` (BIGINT, from 1)."""
    if k <= 0:
        return df.withColumn(rank_col, F.lit(None).cast("bigint")).where(F.lit(False))
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
              .where(F.col(rank_col) <= k)
              .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def best_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest of each row; of equal ones the first columns."""
    n = scores.shape[1]
    if k >= n:
        return np.repeat(np.arange(len(scores)), n), np.tile(np.arange(n), len(scores))
    limit = np.partition(scores, n - k, axis=1)[:, n - k:n - k + 1]
    row, col = np.nonzero(scores >= limit)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


class Floor:
    """Per query the ``k``-th best score that a task has seen: a lower one can't be among the first ``k``."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)

    def best(self, scores: np.ndarray, who: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """``best_rows`` of a block (of the queries ``who``), without those below the floor, which it raises."""
        row, col = best_rows(scores, self.k)
        held, least = scores[row, col], self.least[who]
        lowest = np.full(len(scores), np.inf)
        np.minimum.at(lowest, row, held)
        full = (np.bincount(row, minlength=len(scores)) >= max(self.k, 1)) & ~np.isnan(lowest)
        self.least[who] = least = np.where(full, np.maximum(least, lowest), least)
        open_ = ~(held < least[row])
        return row[open_], col[open_]


class QuerySlice:
    """The queries of one slice: token -> query postings, sizes, vectors and norms."""

    def __init__(self, rows: list, dim: int):
        self.ids = [r["query_id"] for r in rows]
        lists = [r["toks"] if r["toks"] is not None else () for r in rows]
        self.number = {t: j for j, t in enumerate(dict.fromkeys(t for ts in lists for t in ts))}
        self.sizes = np.array([len(ts) for ts in lists], np.float64)
        token = np.array([self.number[t] for ts in lists for t in ts], np.int64)
        order = np.argsort(token, kind="stable")
        self.postings = np.repeat(np.arange(len(rows)), self.sizes.astype(np.int64))[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(self.number)))])
        self.vectors = np.zeros((len(rows), dim))
        self.norms = np.zeros(len(rows))
        for i, r in enumerate(rows):
            if r["idx"]:
                self.vectors[i, r["idx"]] = r["cnt"]
            self.norms[i] = r["norm"] or 0.0

    def hits(self, token: np.ndarray, column: np.ndarray, columns: int, step: int = 1 << 19) -> np.ndarray:
        """|Q n C| for every query and column, of distinct (token number, column) pairs. Tokens that
        fill much of the result are added by a matrix product, others of many cells as rectangles,
        the rest cell by cell, ``step`` at a time."""
        out = np.zeros((len(self.ids), columns), np.int32)
        order = np.argsort(token, kind="stable")
        token, column = token[order], column[order]
        size = self.ends[token + 1] - self.ends[token]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else token
        runs = np.diff(np.append(first, len(token)))
        cells = runs * size[first]
        dense, wide = (cells * 256 >= out.size) & (out.size <= 4 * BLOCK_CELLS), cells > 4096
        full = np.flatnonzero(dense)
        for group in (full[i:i + 256] for i in range(0, len(full), 256)):
            asked, held = np.zeros((len(group), len(self.ids)), np.float32), np.zeros((len(group), columns), np.float32)
            for i, (at, n) in enumerate(zip(first[group].tolist(), runs[group].tolist(), strict=True)):
                asked[i, self.postings[self.ends[token[at]]:self.ends[token[at] + 1]]] = 1
                held[i, column[at:at + n]] = 1
            out += (asked.T @ held).astype(np.int32)  # whole numbers up to 256: exact
        for at, n in zip(first[wide & ~dense].tolist(), runs[wide & ~dense].tolist(), strict=True):
            t = token[at]
            out[np.ix_(self.postings[self.ends[t]:self.ends[t + 1]], column[at:at + n])] += 1
        rest = ~np.repeat(wide | dense, runs)
        token, column, size = token[rest], column[rest], size[rest]
        flat, total = out.reshape(-1), np.cumsum(size)
        start = 0
        while start < len(token):
            before = total[start] - size[start]
            stop = max(start + 1, int(np.searchsorted(total, before + step, "right")))
            n = size[start:stop]
            at = np.arange(n.sum()) + np.repeat(self.ends[token[start:stop]] - np.cumsum(n) + n, n)
            at = self.postings[at] * columns + np.repeat(column[start:stop], n)
            if len(at) * 16 >= len(flat):
                flat += np.bincount(at, minlength=len(flat)).astype(np.int32)
            else:
                np.add.at(flat, at, 1)
            start = stop
        return out

    def pairs(self, low: pa.Array, toks: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (token number, row) of the queries' tokens that the rows hold, by token. A row has
        its lower-cased text or its ``keyword_set``."""
        lists = [pc.utf8_split_whitespace(low), *([] if toks is None else [toks])]
        held = pa.concat_arrays([x.flatten() for x in lists])
        row = np.concatenate([pc.list_parent_indices(x).to_numpy() for x in lists])
        code = pc.index_in(held, value_set=pa.array(list(self.number), held.type))
        asked = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        key = np.sort(code.fill_null(0).to_numpy()[asked].astype(np.int64) * len(low) + row[asked])
        return np.divmod(key[np.diff(key, prepend=-1) > 0], max(len(low), 1))

    def keyword(self, low: pa.Array, toks: pa.Array | None = None) -> np.ndarray:
        """R2: |Q n C| / |Q| for every query and chunk."""
        if not self.number:
            return np.zeros((len(self.ids), len(low)))
        return self.hits(*self.pairs(low, toks), len(low)) / np.where(self.sizes > 0, self.sizes, 1)[:, None]

    def cosine(self, idx: pa.Array, cnt: pa.Array, norms: np.ndarray) -> np.ndarray:
        """R1 over sparse integer counts: exact dot products, one rounding per division."""
        block = np.zeros((len(norms), self.vectors.shape[1]))
        some = pc.is_valid(idx)
        own = pc.indices_nonzero(some).to_numpy()
        idx, cnt = idx.filter(some), cnt.filter(some)
        row = own[pc.list_parent_indices(idx).to_numpy()]
        block[row, idx.flatten().to_numpy()] = cnt.flatten().to_numpy(zero_copy_only=False)
        scale = np.outer(self.norms, norms)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(scale > 0, (self.vectors @ block.T) / scale, 0.0)


def _kernel(shared, dim: int, weight: float, picks: tuple[tuple[str, int], ...], names: list[str]):
    late = weight == 1.0 and all(name != "kw" for name, _ in picks)  # the keyword score ranks nothing: only for what is picked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = QuerySlice(shared.value.to_pylist(), dim)
        size = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, dim + len(q.ids))))
        floors = {name: Floor(len(q.ids), k) for name, k in picks}
        ids = shared.value.column("query_id").combine_chunks()
        for batch in batches:
            at = 0
            for block in text_slices(batch.column("low"), size, BLOCK_BYTES):
                part = batch.slice(at, len(block)).sort_by([(c, "ascending") for c in CHUNK_ORDER])
                at += len(block)
                texts = [part.column(c) for c in ("low", "toks") if c in part.schema.names]
                vec = q.cosine(part.column("idx"), part.column("cnt"),
                               part.column("norm").to_numpy(zero_copy_only=False).astype(np.float64)) if dim else np.zeros((len(q.ids), part.num_rows))
                kw = np.zeros_like(vec) if late else q.keyword(*texts)
                of = {"vec": vec, "kw": kw, "score": weight * vec + (1.0 - weight) * kw}
                cells = np.concatenate([np.stack(floors[name].best(of[name]), 1) for name, _ in picks])
                row, col = np.unique(cells, axis=0).T
                if late:
                    used = np.unique(col)
                    kw[:, used] = q.keyword(*(x.take(pa.array(used)) for x in texts))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row)), *(part.column(c).take(pa.array(col)) for c in ("chunk_id", "doc_id", "chunk_index")),
                     *(pa.array(x[row, col], pa.float64()) for x in (vec, kw, of["score"]))], names=names)
    return run


def _words(index: DataFrame, dim: int, dotted: bool) -> DataFrame:
    """What a task reads of the index: its texts for ``QuerySlice.pairs``, lower-cased, or (``dotted``) those with a
    letter that lower-cases to two as their ``keyword_set``, and the vectors. A column of null arrays costs a
    task as much as one of texts, so there is none."""
    grows, texts = F.contains("text", F.lit(GROWS)), [F.lower("text").alias("low")]
    if dotted:
        texts = [F.when(~grows, F.lower("text")).alias("low"), F.when(grows, keyword_set("text")).alias("toks")]
    return index.select("chunk_id", "doc_id", "chunk_index", *texts, *(("idx", "cnt", "norm") if dim else ()))


def score_blocks(queries: DataFrame, index: DataFrame, picks: tuple[tuple[str, int], ...],
                 weight: float, dim: int, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """Per block of index rows and query, the best ``k`` by each of ``picks``
    ((vec | kw | score, k), ...), with all three scores.

    queries: query_id, toks, idx, cnt, norm (the last three null without vectors).
    index: chunk_id, doc_id, chunk_index, text and, unless ``dim`` is 0, idx, cnt, norm."""
    spark = queries.sparkSession
    kinds = {f.name: f.dataType for f in (*index.schema.fields, *queries.schema.fields)}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("query_id", "chunk_id", "doc_id", "chunk_index")]
                          + [T.StructField(c, T.DoubleType()) for c in ("vec_score", "kw_score", "score")])
    row_bytes = F.coalesce(F.size("toks"), F.lit(0)) * 48 + dim * 8 + 64
    parts, cols, out = slices_of(queries, "query_id", row_bytes, max_query_bytes), None, None
    if len(parts) > 1:  # the plans of both sides run once, not once a slice
        cols, queries = saved(_words(index, dim, True), "index"), saved(queries, "queries")
        parts = slices_of(queries, "query_id", row_bytes, max_query_bytes)
    for part in parts:
        asked = part.toArrow()
        shared = spark.sparkContext.broadcast(asked)
        dotted = may_meet_shorter(t for ts in asked.column("toks").to_pylist() for t in ts or ())
        own = cols if cols is not None else _words(index, dim, dotted)
        found = own.mapInArrow(_kernel(shared, dim, weight, picks, schema.names), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _order(score: str) -> list[Column]:
    return [F.col(score).desc(), F.col("doc_id"), F.col("chunk_index")]


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT_TOP_K,
                 query_col: str = "query_id", max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """R2+R4: top-k chunks per query by keyword overlap over all chunks.
    Output: query_id, chunk_id, doc_id, chunk_index, score, rank."""
    q = queries.select(F.col(query_col).alias("query_id"), keyword_set("text").alias("toks"), F.lit(None).cast("array<bigint>").alias("idx"),
                       F.lit(None).cast("array<double>").alias("cnt"), F.lit(None).cast("double").alias("norm"))
    found = score_blocks(q, chunks, (("kw", max(k, 1)),), 0.0, 0, max_query_bytes)
    found = found.select("query_id", "chunk_id", "doc_id", "chunk_index", F.col("kw_score").alias("score"))
    return topk_per_group(found, ["query_id"], _order("score"), k)


def _with_tokens(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", keyword_set("text").alias("toks"), "idx", "cnt", "norm")


def blended_topk(queries: DataFrame, index: DataFrame, k: int = DEFAULT_TOP_K,
                 vector_weight: float = DEFAULT_VECTOR_WEIGHT, dim: int = 384,
                 max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """R3+R4: top-k by ``w * cosine + (1 - w) * overlap`` over ALL chunks, exactly.

    queries: query_id, text, idx, cnt, norm; index: chunk_id, doc_id, chunk_index, text, idx,
    cnt, norm (embedding.embed_md5_vectors). Output: query_id, chunk_id, doc_id, chunk_index,
    vec_score, kw_score, score, rank."""
    check_vector_weight(vector_weight)
    found = score_blocks(_with_tokens(queries), index, (("score", k),), vector_weight, dim, max_query_bytes)
    return topk_per_group(found, ["query_id"], _order("score"), k)


def hybrid_topk(queries: DataFrame, index: DataFrame, k: int = DEFAULT_TOP_K,
                vector_weight: float = DEFAULT_VECTOR_WEIGHT, dim: int = 384,
                max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """R7, the candidate mode of a managed search service: candidates are the top 2k by
    vector and the matching top 2k by keyword over all chunks; the blend ranks them. One
    kernel pass gives both lists with all scores. Inputs and output as ``blended_topk``,
    which is the exact search."""
    cands = _candidates(queries, index, k, vector_weight, dim, max_query_bytes)
    return topk_per_group(cands, ["query_id"], _order("score"), k)


def _candidates(queries: DataFrame, index: DataFrame, k: int, vector_weight: float, dim: int, max_query_bytes: int) -> DataFrame:
    """The top ``2k`` of each query by vector and the matching top ``2k`` by keyword, with all scores."""
    check_vector_weight(vector_weight)
    depth = 2 * k
    found = score_blocks(_with_tokens(queries), index, (("vec", depth), ("kw", depth)), vector_weight, dim, max_query_bytes)
    ranked = found.select("*", *(F.row_number().over(Window.partitionBy("query_id").orderBy(*_order(c))).alias(r)
                                 for c, r in (("vec_score", "_v"), ("kw_score", "_k"))))
    return ranked.where((F.col("_v") <= depth) | ((F.col("_k") <= depth) & (F.col("kw_score") > 0))).drop("_v", "_k")


def shortest_cover(words: list[str], wanted: set[str]) -> tuple[int, int]:
    """(distinct ``wanted`` words among ``words``, length of the shortest run that holds them all)."""
    found = len(wanted.intersection(words))
    if not found:
        return 0, 0
    held: dict[str, int] = {}
    best, start = len(words), 0
    for end, w in enumerate(words):
        if w not in wanted:
            continue
        held[w] = held.get(w, 0) + 1
        while len(held) == found:
            best = min(best, end - start + 1)
            first = words[start]
            if first in wanted:
                held[first] -= 1
                if not held[first]:
                    del held[first]
            start += 1
    return found, best


def reranked_topk(queries: DataFrame, index: DataFrame, k: int = DEFAULT_TOP_K, vector_weight: float = DEFAULT_VECTOR_WEIGHT,
                  dim: int = 384, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """R7 with a second stage: the candidates of ``hybrid_topk`` are ranked by proximity, that is
    matched^2 / (|Q| * length of the shortest run of words that holds all matched query tokens).
    A candidate with fewer than two matched tokens has no reranker score and keeps its base score.
    Output: query_id, chunk_id, doc_id, chunk_index, base_score, matched, cover, reranker_score, score, rank."""
    cands = saved(_candidates(queries, index, k, vector_weight, dim, max_query_bytes)
                  .select("query_id", "chunk_id", "doc_id", "chunk_index", F.col("score").alias("base_score")), "candidates")
    asked = queries.select("query_id", keyword_set("text").alias("toks"))
    met = cands.join(index.select("chunk_id", F.col("text").alias("_text")), "chunk_id").join(asked, "query_id")
    kept = cands.columns
    schema = T.StructType([*cands.schema.fields, T.StructField("matched", T.IntegerType()), T.StructField("cover", T.IntegerType()),
                           T.StructField("asked", T.IntegerType())])

    def run(batches):
        for batch in (b.slice(i, BLOCK_ROWS) for b in batches for i in range(0, b.num_rows, BLOCK_ROWS)):
            toks = batch.column("toks").to_pylist()
            got = [shortest_cover([w.lower() for w in (text or "").split()], set(t or ()))
                   for text, t in zip(batch.column("_text").to_pylist(), toks, strict=True)]
            made = [[m for m, _ in got], [c for _, c in got], [len(t or ()) for t in toks]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, pa.int32()) for x in made)],
                                             names=schema.names)

    out = met.select(*kept, "_text", "toks").mapInArrow(run, schema)
    again = F.when(F.col("matched") >= 2, F.col("matched") * F.col("matched") / (F.col("asked") * F.col("cover")))
    out = out.withColumn("reranker_score", again).withColumn("score", F.coalesce("reranker_score", "base_score")).drop("asked")
    return topk_per_group(out, ["query_id"], _order("score"), k)


# ---- R1 over dense vectors -------------------------------------------------


def matrix(vectors: pa.Array, rows: int, dim: int = -1) -> np.ndarray:
    """Lists of one length (``dim``) as a matrix."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, dim)


def vector_topk(queries: DataFrame, index: DataFrame, k: int = DEFAULT_TOP_K,
                query_key: str = "query_id", index_keys: tuple[str, ...] = CHUNK_ORDER,
                vec_col: str = "vec", digits: int | None = 9,
                max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """R1+W1: exact top-k by dot product of unit vectors for every query over the whole
    index; ties (after rounding to ``digits``) break by ``index_keys``. The queries are
    broadcast in slices of ``max_query_bytes``. Output: query_key, index_keys..., score, rank."""
    spark = queries.sparkSession
    kinds = {f.name: f.dataType for f in (*index.schema.fields, *queries.schema.fields)}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in (query_key, *index_keys)]
                          + [T.StructField("score", T.DoubleType())])

    def kernel(shared):
        def run(batches):
            keys = shared.value.column(0).combine_chunks()
            if not len(keys):
                return
            q = matrix(shared.value.column(1).combine_chunks(), len(keys))
            floor, step = Floor(len(keys), k), max(1, BLOCK_CELLS // len(keys))
            for batch in batches:
                batch = batch.sort_by([(c, "ascending") for c in index_keys])
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    s = q @ matrix(part.column(vec_col), part.num_rows, q.shape[1]).T
                    s = s if digits is None else np.round(s, digits)
                    row, col = floor.best(s)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), *(part.column(c).take(pa.array(col)) for c in index_keys),
                                                      pa.array(s[row, col], pa.float64())], names=schema.names)
        return run

    row_bytes, index = F.size(vec_col) * 8 + 64, index.select(*index_keys, vec_col)
    parts, out = slices_of(queries, query_key, row_bytes, max_query_bytes), None
    if len(parts) > 1:
        index, queries = saved(index, "index"), saved(queries, "queries")
        parts = slices_of(queries, query_key, row_bytes, max_query_bytes)
    for part in parts:
        shared = spark.sparkContext.broadcast(part.select(query_key, vec_col).toArrow())
        found = index.mapInArrow(kernel(shared), schema)
        out = found if out is None else out.unionByName(found)
    return topk_per_group(out, [query_key], [F.col("score").desc(), *(F.col(c) for c in index_keys)], k)


# ---- R5 / U3: index build and the search interface -------------------------


def build_index(docs: DataFrame, max_tokens: int = 400, overlap_tokens: int = 40,
                dim: int = 384) -> DataFrame:
    """Chunk the corpus (C2) and attach sparse hashed vectors (E2): chunk_id, doc_id,
    chunk_index, text, n_tokens, idx, cnt, norm - one narrow stage. Persist it with
    ``sources.files.write_index`` to query it many times."""
    from docflow.operators import chunking, embedding

    return embedding.embed_md5_vectors(chunking.chunk_documents(docs, max_tokens, overlap_tokens), None, "text", dim)


def search(queries: DataFrame, index: DataFrame, k: int = DEFAULT_TOP_K, mode: str = "blended",
           vector_weight: float = DEFAULT_VECTOR_WEIGHT, dim: int = 384) -> DataFrame:
    """``(queries(query_id, text), index, k) -> passages``; mode 'keyword' (R2+R4),
    'vector' (R1 over the hashed vectors), 'blended' (R3+R4) or 'hybrid' (R7). Output always
    carries query_id, chunk_id, doc_id, chunk_index, score, rank."""
    from docflow.operators import embedding

    cols = ("query_id", "chunk_id", "doc_id", "chunk_index", "score", "rank")
    if mode == "keyword":
        return keyword_topk(queries, index, k).select(*cols)
    qv = embedding.embed_md5_vectors(queries, ["query_id", "text"], "text", dim)
    if mode == "hybrid":
        return hybrid_topk(qv, index, k, vector_weight, dim).select(*cols)
    if mode in ("vector", "blended"):
        return blended_topk(qv, index, k, 1.0 if mode == "vector" else vector_weight, dim).select(*cols)
    raise ValueError(f"unknown search mode {mode!r}")


def normalize_search_hits(hits: DataFrame) -> DataFrame:
    """R7 result mapping for rows returned by an external hybrid search service: the score
    is the reranker score when present, else the base score, else 0.0; a missing or zero
    ``n_tokens`` becomes 1 (the chunk contract requires n_tokens > 0)."""
    cols = set(hits.columns)
    rr = F.col("reranker_score") if "reranker_score" in cols else F.lit(None).cast("double")
    base = F.col("search_score") if "search_score" in cols else F.lit(None).cast("double")
    n = F.col("n_tokens") if "n_tokens" in cols else F.lit(None).cast("bigint")
    keep = [c for c in hits.columns if c not in ("reranker_score", "search_score", "n_tokens")]
    return hits.select(*keep, F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(1)).otherwise(n)
                       .cast("bigint").alias("n_tokens"),
                       F.coalesce(rr, base, F.lit(0.0)).cast("double").alias("score"))
