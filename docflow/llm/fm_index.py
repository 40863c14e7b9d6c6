"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task, closed once it holds ``shard_symbols`` indexed
words. Its words become symbols: the words of the test phrases get numbers, any other word
is a separator (no phrase can cross it), and runs shorter than the shortest phrase are left
out, as no phrase fits into them. Over that symbol string the task builds the suffix array
(prefix doubling), the Burrows-Wheeler transform, a wavelet matrix for its ranks and a
sampled suffix array. All phrases are searched backward together; occurrences are located by
walking to the next sample; overlapping occurrences merge into removal spans. No shuffle, no
cap: a shard's memory follows ``shard_symbols`` and the longest single document.

Phrases are broadcast in blocks of about ``block_phrases``; each block is one more pass over
the rows in the same stage, so a benchmark of any size keeps the broadcast bounded.

Defined cases: null and empty texts have no words; a phrase with an empty word list matches
nothing; repeated rows are judged row by row; an item without an id marks hits, but is not
listed; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.common import text_of

#: A-Z to lower case, digits, a-z and all non-ASCII bytes stay, other bytes part words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))

FOUND = (T.StructType().add("n_words", T.LongType())
         .add("words", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))
         .add("items", T.ArrayType(T.LongType())))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; every separator (0) is a symbol of its own, smaller than all words
    and ordered by position, so comparisons end at the next separator."""
    n = len(symbols)
    seps = symbols == 0
    rank = symbols.astype(np.int64) + int(seps.sum())
    rank[seps] = np.arange(int(seps.sum()))
    k = 1
    while n:
        tail = np.zeros(n, np.int64)
        tail[:max(n - k, 0)] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + tail
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        k *= 2
    return np.zeros(0, np.int64)


class FMIndex:
    """BWT of ``symbols`` (0 parts segments and ends the string) with wavelet-matrix ranks
    and suffix positions sampled every ``step`` symbols and at each segment's start."""

    def __init__(self, symbols: np.ndarray, step: int = 8):
        sa = suffix_array(symbols)
        n = len(symbols)
        self.bwt = symbols[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        before = np.zeros(n, np.int64)
        before[1:] = symbols[:-1]
        keep = ((sa % step == 0) | (before[sa] == 0))
        self.kept = np.concatenate([[0], np.cumsum(keep)])
        self.sample = sa[keep]
        self.bits = max(1, int(symbols.max(initial=1)).bit_length())
        self.ones, self.zeros, level = [], [], self.bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[j] stands in the first i[j] symbols of the BWT."""
        lo = np.zeros_like(i)
        for level in range(self.bits):
            one = (c >> (self.bits - 1 - level)) & 1 == 1
            at, up, z = self.ones[level], i, self.zeros[level]
            r_lo, r_up = at[lo], at[up]
            lo, i = np.where(one, z + r_lo, lo - r_lo), np.where(one, z + r_up, up - r_up)
        return i - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase; a row of ``phrases`` is padded with -1 in front."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        top = len(self.first) - 1
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero((hi > lo) & (phrases[:, j] >= 0))
            c = phrases[live, j]
            there = c < top
            hi[live[~there]] = lo[live[~there]]
            live, c = live[there], c[there]
            start = self.first[c]
            lo[live], hi[live] = start + self.rank(c, lo[live]), start + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of BWT rows, by LF steps to the next sampled suffix."""
        pos, live, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            is_kept = self.kept[rows + 1] > self.kept[rows]
            pos[live[is_kept]] = self.sample[self.kept[rows[is_kept]]] + steps
            live, rows = live[~is_kept], rows[~is_kept]
            c = self.bwt[rows]
            rows = self.first[c] + self.rank(c, rows)
            steps += 1
        return pos


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Phrases:
    """A block of (phrase, item) rows, ready to be searched."""

    def __init__(self, rows: list[tuple[str, int | None]]):
        self.items: dict[str, list[int]] = {}
        for phrase, item in rows:
            if phrase:
                self.items.setdefault(phrase, [])
                if item is not None:
                    self.items[phrase].append(item)
        split = [p.encode().split() for p in self.items]
        self.owners = list(self.items.values())
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for p in split for w in p}))}
        self.lengths = np.array([len(p) for p in split], np.int64)
        width = int(self.lengths.max(initial=0))
        self.table = np.full((len(split), width), -1, np.int64)
        for row, p in zip(self.table, split, strict=True):
            row[width - len(p):] = [self.number[w] for w in p]

    def find(self, docs: list[np.ndarray]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """Per document (its symbols): merged word spans and items."""
        out: list = [([], set()) for _ in docs]
        size = np.array([len(d) for d in docs], np.int64)
        all_symbols = np.concatenate([x for d in docs for x in (d, np.zeros(1, d.dtype))]).astype(np.int64)
        doc = np.repeat(np.arange(len(docs)), size + 1)
        offset = np.arange(len(all_symbols)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
        ends = np.flatnonzero(all_symbols == 0)
        run = np.diff(ends, prepend=-1) - 1
        keep = np.repeat(run >= self.lengths.min(), run + 1)
        symbols, doc, offset = all_symbols[keep], doc[keep], offset[keep]
        if not len(symbols):
            return out
        index = FMIndex(symbols)
        lo, hi = index.search(self.table)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        pos = index.locate(rows)
        order = np.argsort(doc[pos], kind="stable")
        pos, which = pos[order], which[order]
        cuts = np.flatnonzero(np.diff(doc[pos])) + 1
        for p, w in zip(np.split(pos, cuts), np.split(which, cuts), strict=True):
            if len(p):
                at = offset[p]
                out[doc[p[0]]] = (merge(at, at + self.lengths[w]),
                                  {i for x in np.unique(w).tolist() for i in self.owners[x]})
        return out


def _scan(block, shard_symbols: int):
    """A function over Arrow batches that adds one block's hits to the column ``found``."""

    def run(batches):
        phrases, held, docs, told, symbols = Phrases(block.value), [], [], [], 0

        def flush():
            hits = phrases.find(docs) if len(phrases.lengths) and docs else [([], set())] * len(docs)
            at = 0
            for batch in held:
                old, new = batch.column("found").to_pylist(), []
                for was in old:
                    (spans, items), n = hits[at], told[at]
                    was = was or {"words": [], "items": []}
                    both = np.array([(s["start"], s["end"]) for s in was["words"]] + spans, np.int64).reshape(-1, 2)
                    new.append({"n_words": n, "items": sorted({*was["items"], *items}),
                                "words": [{"start": a, "end": b} for a, b in merge(both[:, 0], both[:, 1])]})
                    at += 1
                kind = batch.schema.field("found")
                yield batch.set_column(batch.schema.get_field_index("found"), kind, pa.array(new, kind.type))
            held.clear(), docs.clear(), told.clear()

        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                for text in piece.column("text").to_pylist():
                    words = words_of(text)
                    told.append(len(words))
                    docs.append(np.fromiter(map(phrases.number.get, words, repeat(0)), np.int32, len(words)))
                    symbols += len(words)
                held.append(piece)
                if symbols >= shard_symbols:
                    yield from flush()
                    symbols = 0
        yield from flush()

    return run


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(phrase, item_id): every run of ``size`` consecutive words; a shorter item is one run."""
    lower = F.translate(text_of(), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.filter(F.split(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda x: x != "")
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), w.alias("w")).where(F.size("w") > 0)
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1)))
    return rows.select("item_id", "w", at.alias("i")).select(
        F.array_join(F.expr(f"slice(w, i, {int(size)})"), " ").alias("phrase"), "item_id").distinct()


def find_phrases(docs: DataFrame, phrases: DataFrame, shard_symbols: int = 2_000_000,
                 block_phrases: int = 500_000, cut: bool = False) -> DataFrame:
    """``docs`` (its column ``text``) plus ``found``: n_words, merged word spans, item ids. With ``cut`` the
    spans are cut out of the texts in the last block's pass.

    ``phrases``: (phrase, item_id), words joined by a space. Their number is counted; each
    block of them (by hash of the phrase) is collected and broadcast by itself."""
    spark = docs.sparkSession
    blocks = max(1, math.ceil(phrases.count() / block_phrases))
    out = docs.drop("found").withColumn("found", F.lit(None).cast(FOUND))
    for b in range(blocks):
        part = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b)
        rows = [(r["phrase"], r["item_id"]) for r in part.collect()]
        scan = _scan(spark.sparkContext.broadcast(rows), shard_symbols)
        out = out.mapInArrow(_then_cut(scan) if cut and b + 1 == blocks else scan, out.schema)
    return out


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the given word spans; the rest stays as it is."""
    data = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(WORDS))]
    out, last = [], 0
    for a, b in spans:
        out.append(data[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, data[last:]]).decode()


def _cut(batches):
    for batch in batches:
        at, found = batch.schema.get_field_index("text"), batch.column("found").to_pylist()
        texts = batch.column("text").to_pylist() if any(f["words"] for f in found) else []
        cut = [remove_spans(t, [(s["start"], s["end"]) for s in f["words"]]) if f["words"] else t
               for t, f in zip(texts, found, strict=False)]
        yield batch.set_column(at, batch.schema.field("text"), pa.array(cut, batch.schema.field("text").type)) if cut else batch


def _then_cut(scan):
    return lambda batches: _cut(scan(batches))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` with every occurrence of a benchmark window cut out of the text; a document
    that keeps no word goes. ``n_chars``, if there, follows the text."""
    found = find_phrases(docs, windows(benchmark, size), cut=True)
    hit = F.size("found.words") > 0
    n_hit = F.aggregate("found.words", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    out = found.where(~hit | (n_hit < F.col("found.n_words")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
