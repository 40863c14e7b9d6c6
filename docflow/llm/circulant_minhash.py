"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Signatures: a shingle's hash picks a place in a universe of ``UNIVERSE`` places, the first
permutation moves it, and coordinate k is the least value of the second permutation shifted
circularly by k. So all coordinates of a shingle are one contiguous slice of a table.
Bands of ``ROWS`` coordinates are the buckets; two texts at 80 % similarity miss all ``BANDS``
bands with a chance of about 5e-6.

Links without all pairs: equal word sequences form one class, whose smallest id stands for it.
In every bucket the representative whose buckets are fullest (the likely centre of a group of
copies) is the hub, and each member is compared with it, exactly, on full shingle sets. Members
that link with the hub are one component. Any other two members x, y of the bucket can link
only if they share a shingle that the hub lacks, or if the smaller of their intersections with
the hub would already do, as |x & y| <= min(|x & hub|, |y & hub|) + |(x & y) - hub|. Both cases
are equi-joins (on the shingles that the hub lacks; on the hub with the size condition), whose
few pairs are verified too. A member that needs k shared shingles beyond the hub leaves its k - 1
most frequent ones out of the join: two that share k still meet on another (prefix filter). So every pair of a bucket is compared, connected or ruled out by that
bound: components are those of all links, and a group of n copies costs about n comparisons.

Nothing is gathered by key: buckets are counted and their hubs picked by combining
aggregates, members meet hubs and texts in equi-joins that Spark splits when skewed, and
components come from star contraction. The driver sees counts only.

Defined cases: a text without words (or null) has no shingles and is linked with nothing; one
of fewer than ``shingle`` words is one shingle; rows that share an id are one document; a row
with a null id is linked with nothing and kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docflow.llm.common import LOWER, saved

UNIVERSE, BANDS, ROWS = 1 << 20, 40, 6


class _WordHash(dict):
    """64-bit hashes of words, of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def shingle_hashes(words: list[bytes], size: int, cache: dict) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of ``words``."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=size)], np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Circulant:
    """The two permutations; ``signature`` gives all ``n`` coordinates of a set."""

    def __init__(self, n: int = BANDS * ROWS, seed: int = 5):
        r = np.random.default_rng(seed)
        self.first = r.permutation(UNIVERSE).astype(np.int32)
        second = r.permutation(UNIVERSE).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:n - 1]]), n)
        self.n = n

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        place = self.first[(hashes >> np.uint64(13)).astype(np.int64) & (UNIVERSE - 1)]
        out = np.full(self.n, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(place), 2048):
            np.minimum(out, self.shifted[place[i:i + 2048]].min(axis=0), out=out)
        return out

    def bands(self, hashes: np.ndarray) -> list[int]:
        rows = self.signature(hashes).reshape(BANDS, ROWS)
        return [xxhash.xxh3_64_intdigest(r.tobytes(), seed=b) - 2**63 for b, r in enumerate(rows)]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, key (of the word sequence) and bands (null without words)."""

    def run(batches):
        cache, perms = _WordHash(), Circulant()
        for batch in batches:
            n, key, bands = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hashes = shingle_hashes(words, shingle, cache)
                n.append(len(hashes))
                key.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                bands.append(perms.bands(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, key binary, bands array<bigint>")


def verify(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``common`` (size of the intersection of their full shingle sets, on
    the words themselves), ``linked`` (Jaccard similarity of at least ``percent`` / 100) and
    ``novel`` (64-bit hashes of a's shingles that b lacks)."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), "text")
    both = (pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))

    def shingles(text):
        w = words_of(text)
        return set(zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else {tuple(w)}

    def run(batches):
        last, right = None, set()
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                common, linked, novel = [], [], []
                for x, y in zip(piece.column("text_a"), piece.column("text_b"), strict=True):
                    if y != last:
                        last, right = y, shingles(y.as_py())
                    left = shingles(x.as_py())
                    rest = left - right
                    common.append(len(left) - len(rest))
                    linked.append(100 * common[-1] >= percent * (len(right) + len(rest)))
                    novel.append([xxhash.xxh3_64_intdigest(b" ".join(s)) - 2**63 for s in rest])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("a"), piece.column("b"), pa.array(common, pa.int64()), pa.array(linked, pa.bool_()),
                     pa.array(novel, pa.list_(pa.int64()))], names=["a", "b", "common", "linked", "novel"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a bigint, b bigint, common bigint, linked boolean, novel array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable, for every end of ``edges`` (a, b). Alternating
    large and small stars; both are a minimum per node, joined back on the node."""
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        around = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        stars = saved(small, "stars")
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(
        stars.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _links(reps: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(rep, comp) of all representatives that share a bucket with another."""
    members = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = saved(members.join(full, "bucket"), "buckets")
    fame = shared.groupBy("rep").agg(F.sum("size").alias("fame"))
    known = shared.join(fame, "rep")
    hubs = known.groupBy("bucket").agg(F.max_by("rep", F.struct("fame", -F.col("rep"))).alias("hub"))
    pairs = shared.join(hubs, "bucket").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    versus = saved(verify(saved(pairs, "pairs"), docs, shingle, percent), "versus")
    comp = saved(components(versus.where("linked").select("a", "b")), "comps")

    size = fame.select("rep").join(reps.select("rep", "n"), "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    size = size.select(F.col("rep").alias("a"), "n", F.coalesce("comp", "rep").alias("comp"))
    told = versus.select(F.col("b").alias("hub"), "a", "common", "novel").join(size, "a")
    apart = told.groupBy("hub").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least")).where("lo < hi")
    told = saved(told.join(apart.select("hub", "least"), "hub"), "apart")

    own = ("a", "n", "common", "comp")
    other = lambda df, *keys: df.select(*keys, *(F.col(c).alias(f"{c}_b") for c in own))
    slim = told.select("hub", *own)
    ordered = (F.col("a") < F.col("a_b")) & (F.col("comp") != F.col("comp_b"))
    alike = (100 + percent) * F.least("common", "common_b") >= percent * (F.col("n") + F.col("n_b"))
    within = slim.join(other(slim, "hub"), "hub").where(ordered & alike)
    need = F.ceil(percent * (F.col("n") + F.col("least")) / (100 + percent) - 1e-9) - F.col("common")
    words = told.select("hub", *own, need.alias("need"), F.explode(F.array_distinct("novel")).alias("s"))
    both = words.groupBy("hub", "s").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("often")).where("lo < hi")
    rank = F.row_number().over(Window.partitionBy("hub", "a").orderBy(F.desc("often"), "s"))
    words = words.join(both.select("hub", "s", "often"), ["hub", "s"]).withColumn("rank", rank).where("rank >= need")
    near = 100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b")
    beyond = words.join(other(words, "hub", "s"), ["hub", "s"]).where(ordered & near)
    more = within.union(beyond.select(*within.columns)).select("a", F.col("a_b").alias("b")).distinct()
    links = verify(saved(more, "pairs"), docs, shingle, percent).where("linked").select("a", "b")
    links = saved(versus.where("linked").select("a", "b").union(links), "links")
    return components(links).select(F.col("id").alias("rep"), "comp")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sig = saved(signatures(docs, shingle), "signatures")
    linked = sig.where(F.col("doc_id").isNotNull() & F.col("bands").isNotNull())
    reps = linked.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
                                     F.first("bands").alias("bands"))
    reps = saved(reps, "classes")
    comp = _links(reps.select("rep", "n", "bands"), docs, shingle, percent)
    of_key = reps.select("key", "rep").join(comp, "rep", "left").select("key", F.coalesce("comp", "rep").alias("c"))
    by_id = sig.join(of_key, "key", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return by_id.select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
