"""Brown class-based n-gram scoring.

P(w | v) = (1 - u) P(c(w) | c(v)) P(w | c(w)) for a word seen in training, u for any other:
u is the smoothed unigram's unknown mass, the class transitions are smoothed towards the
classes' shares, emissions are the add-``ALPHA`` counts. So the known words and the unknown
event sum to one after every history. A text starts after an end.

Units: every word has one. The ``core`` most frequent words are units of their own, other
words (unknown ones too) share one per hash of their last three bytes, so the exchange's state
is bounded, whatever the vocabulary. Exchange clustering moves units between classes to raise
the class-bigram likelihood; it starts as Brown's does, the most frequent units in a class
each. Each pass counts, over the whole training corpus, how often a unit follows and precedes
each class; the sweep over the units (a table of units x classes) runs on the driver, half of
the units per pass, as a class's context is exact only at the pass's start.

Counts: the vocabulary is counted over all training texts and stays a table. The ``hot`` most
frequent words' counts are broadcast (a fixed number of rows); any other token meets its count
in one equi-join on the word's 64-bit hash, which no frequent word enters.

Defined cases: a null or empty text is one token, its end; repeated rows are scored and counted
each; a null id counts as held out (remainder 0); without training rows every token is unknown; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import LOWER, remainder, saved, text_of

ALPHA, END = 0.1, 0
END_HASH = xxhash.xxh3_64_intdigest(b"\n")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def _signed(h):
    return np.asarray(h, np.uint64).view(np.int64)


def tail_of(words, buckets: int) -> np.ndarray:
    """Which shared unit a word of the vocabulary's rest has: by its last three bytes."""
    h = np.array([xxhash.xxh3_64_intdigest(w[-3:]) for w in words], np.uint64)
    return (h % np.uint64(buckets)).astype(np.int64)


def vocabulary(docs: DataFrame, buckets: int, flush: int = 300_000) -> DataFrame:
    """(h, tail, c): hash, tail bucket and count of every token of ``docs``; tasks combine
    before the shuffle."""

    def run(batches):
        def told(counts):
            h = _signed([xxhash.xxh3_64_intdigest(w) for w in counts])
            return pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(tail_of(counts, buckets)), pa.array(list(counts.values()), pa.int64())],
                names=["h", "tail", "c"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(words_of(text.as_py()))
                counts[b"\n"] += 1
                if len(counts) >= flush:
                    yield told(counts)
                    counts.clear()
        yield told(counts)

    return (docs.select("text").mapInArrow(run, "h bigint, tail bigint, c bigint")
            .groupBy("h", "tail").agg(F.sum("c").alias("c")))


class Lexicon:
    """Words to local numbers, with each one's hash, unit and place among the hot words."""

    def __init__(self, hot: np.ndarray, units: int, core: int, limit: int = 300_000):
        self.order = np.argsort(hot)
        self.hot, self.units, self.core, self.limit = hot[self.order], units, core, limit
        self.clear()

    def clear(self):
        self.number: dict[bytes, int] = {}
        self.hashes = np.zeros(0, np.int64)
        self.place = self.unit = np.zeros(0, np.int64)

    def look(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > self.limit:
            self.clear()
        number, known = self.number, len(self.number)
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        if len(number) > known:
            fresh = list(islice(reversed(number), len(number) - known))[::-1]
            h = _signed([xxhash.xxh3_64_intdigest(w) for w in fresh])
            at = np.minimum(np.searchsorted(self.hot, h), max(len(self.hot) - 1, 0))
            hit = self.hot[at] == h if len(self.hot) else np.zeros(len(h), bool)
            place = np.where(hit, self.order[at] if len(self.hot) else -1, -1)
            rest = 1 + self.core + tail_of(fresh, self.units - 1 - self.core)
            unit = np.where((place >= 0) & (place < self.core), 1 + place, rest)
            self.hashes, self.place, self.unit = (np.concatenate(x) for x in (
                (self.hashes, h), (self.place, place), (self.unit, unit)))
        return ids


def sequences(docs: DataFrame, hot: np.ndarray, hot_counts: np.ndarray, units: int, core: int) -> DataFrame:
    """Per document: its units (uint16, the end last), of the hot tokens the sum of
    log10(count + ALPHA), and hashes and positions of the others."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((hot, np.log10(hot_counts + ALPHA)))

    def run(batches):
        hashes, logs = shared.value
        lex = Lexicon(hashes, units, core)
        end = next(iter(np.flatnonzero(hashes == _signed([END_HASH])[0]).tolist()), -1)
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            out = {k: [] for k in ("units", "hot_log10", "rare", "at")}
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            all_ids = lex.look([w for ws in words for w in ws])
            for ids in np.split(all_ids, list(accumulate(map(len, words)))[:-1]):
                place = lex.place[ids]
                cold = np.flatnonzero(place < 0)
                out["units"].append(np.append(lex.unit[ids], END).astype(np.uint16).tobytes())
                out["hot_log10"].append(float(logs[place[place >= 0]].sum() + (logs[end] if end >= 0 else 0)))
                rare, at = lex.hashes[ids[cold]], cold
                if end < 0:
                    rare, at = np.append(rare, _signed([END_HASH])), np.append(at, len(ids))
                out["rare"].append(rare.astype(np.int64).tobytes())
                out["at"].append(at.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(out["units"], pa.binary()),
                 pa.array(out["hot_log10"], pa.float64()), pa.array(out["rare"], pa.binary()), pa.array(out["at"], pa.binary())],
                names=["row", "doc_id", "held_out", "units", "hot_log10", "rare", "at"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", "text")
    return rows.mapInArrow(run, "row bigint, doc_id bigint, held_out boolean, units binary, hot_log10 double, rare binary, at binary")


def contexts(train: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """counts[0, u, c]: how often class c follows unit u; counts[1, u, c]: precedes it. Tasks
    combine over all they read; the result has 2 x units x classes cells."""
    spark = train.sparkSession
    shared, n_units = spark.sparkContext.broadcast(classes), len(classes)

    def run(batches):
        of, cells = shared.value, n_units * n_classes
        total = np.zeros(2 * cells, np.int64)
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            raw = [np.frombuffer(u.as_py(), np.uint16) for u in batch.column("units")]
            seq = np.concatenate([np.zeros(1, np.uint16), *raw]).astype(np.int64)  # an end parts texts
            cls = of[seq]
            total[:cells] += np.bincount(seq[:-1] * n_classes + cls[1:], minlength=cells)
            total[cells:] += np.bincount(seq[1:] * n_classes + cls[:-1], minlength=cells)
        cell = np.flatnonzero(total)
        for i in range(0, len(cell), 100_000):
            part = cell[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part])], names=["cell", "n"])

    got = train.select("units").mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * n_units * n_classes)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(2, n_units, n_classes)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def sweep(counts: np.ndarray, classes: np.ndarray, n_classes: int, part: int, parts: int) -> np.ndarray:
    """Move every unit of this ``part`` to the class that raises the likelihood most."""
    after, before = counts
    m = np.zeros((n_classes, n_classes))
    np.add.at(m, classes, after)
    out, weight = classes.copy(), after.sum(1)
    for u in np.argsort(-weight, kind="stable").tolist():
        if u == END or u % parts != part or weight[u] == 0:
            continue
        a, right, left = out[u], after[u], before[u]
        m[a] = np.maximum(m[a] - right, 0)
        m[:, a] = np.maximum(m[:, a] - left, 0)
        rows, cols = m.sum(1), m.sum(0)
        gain = ((_phi(m + right) - _phi(m)).sum(1) + (_phi(m.T + left) - _phi(m.T)).sum(1)
                - _phi(rows + right.sum()) + _phi(rows) - _phi(cols + left.sum()) + _phi(cols))
        gain[classes[END]] = -np.inf  # the end keeps a class to itself
        b = int(np.argmax(gain))
        m[b] += right
        m[:, b] += left
        out[u] = b
    return out


def exchange(train: DataFrame, weight: np.ndarray, n_classes: int, passes: int) -> np.ndarray:
    """Class of each unit. The end has class 0; the next most frequent units a class each."""
    order = np.concatenate([[END], [u for u in np.argsort(-weight, kind="stable") if u != END]])
    classes = np.full(len(weight), n_classes - 1)
    classes[order[:n_classes]] = np.arange(n_classes)
    for i in range(passes):
        classes = sweep(contexts(train, classes, n_classes), classes, n_classes, i % 2, 2 if i else 1)
    return classes


def score(docs: DataFrame, held_mod: int = 10, held: int = 0, hot: int = 262_144, core: int = 4096,
          units: int = 8192, n_classes: int = 64, passes: int = 5, pull: float = 10.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row of
    ``docs`` (doc_id, text); learns from rows whose crc32 remainder is not ``held``."""
    docs = docs.select("doc_id", text_of().alias("text"), (remainder("doc_id", held_mod) == held).alias("held_out"))
    vocab = saved(vocabulary(docs.where(~F.col("held_out")), units - 1 - core), "vocabulary")
    n, v = (x or 0 for x in vocab.agg(F.sum("c"), F.count("*")).first())
    hot_hash, hot_tail, hot_count = frequent(vocab, hot)
    texts = saved(sequences(docs, hot_hash, hot_count, units, core), "sequences")
    train = texts.where(~F.col("held_out"))

    weight = contexts(train, np.zeros(units, np.int64), 1)[1, :, 0]
    classes = exchange(train, weight, n_classes, passes)
    pairs = np.zeros((n_classes, n_classes))
    np.add.at(pairs, classes, contexts(train, classes, n_classes)[0])

    types = np.zeros(units)  # distinct words of each unit
    for r in vocab.groupBy("tail").count().collect():
        types[1 + core + r["tail"]] = r["count"]
    for i, (h, tail) in enumerate(zip(hot_hash[:core].tolist(), hot_tail[:core].tolist(), strict=True)):
        types[1 + core + tail] -= 1
        types[END if h == _signed([END_HASH])[0] else 1 + i] += 1
    mass = np.bincount(classes, weight + ALPHA * types, n_classes)
    return _score(texts, vocab, classes, pairs, mass, n, v, pull)


def frequent(vocab: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, tail and count of the most frequent words, at most ``most`` of them, by count. A
    histogram of the counts' logarithms (some hundred rows) gives the least level that still
    fits, so no task sorts what all the others send it."""
    level = F.floor(F.log2("c") * 16)
    sizes = sorted(((r["level"], r["count"]) for r in vocab.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, room = None, most
    for lv, n in sizes:
        room -= n
        if room < 0:
            break
        least = lv
    top = vocab.where(level >= least if least is not None else F.lit(False)).select("h", "tail", "c").toArrow()
    h, tail, c = (top.column(x).to_numpy() for x in ("h", "tail", "c"))
    order = np.lexsort((h, -c))
    return h[order], tail[order], c[order]


def transitions(pairs: np.ndarray, mass: np.ndarray, total: float, pull: float) -> np.ndarray:
    """log10 of (1 - u) P(class | class before) / mass of the class, by class before and class."""
    share = mass / max(mass.sum(), 1e-300)
    p = (pairs + pull * share) / (pairs.sum(1, keepdims=True) + pull)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.log10(p * (1 - ALPHA / total) / mass), nan=0.0, neginf=0.0)


def _score(texts: DataFrame, vocab: DataFrame, classes, pairs, mass, n: int, v: int, pull: float) -> DataFrame:
    total = n + ALPHA * (v + 1)
    shared = texts.sparkSession.sparkContext.broadcast((classes, transitions(pairs, mass, total, pull)))

    def run(batches):
        of, table = shared.value
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            out = {k: [] for k in ("n", "n_hot", "told", "rare", "t")}
            for units, rare, at in zip(*(batch.column(c) for c in ("units", "rare", "at")), strict=True):
                cls = of[np.frombuffer(units.as_py(), np.uint16)]
                step = table[np.append(of[END], cls[:-1]), cls]
                cold = np.frombuffer(at.as_py(), np.int32)
                out["n"].append(len(cls))
                out["n_hot"].append(len(cls) - len(cold))
                out["told"].append(float(step.sum() - step[cold].sum()))
                out["rare"].append(np.frombuffer(rare.as_py(), np.int64))
                out["t"].append(step[cold])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", "doc_id", "held_out", "hot_log10")]
                + [pa.array(out["n"], pa.int64()), pa.array(out["n_hot"], pa.int64()), pa.array(out["told"], pa.float64()),
                   pa.array(out["rare"], pa.list_(pa.int64())), pa.array(out["t"], pa.list_(pa.float64()))],
                names=["row", "doc_id", "held_out", "hot_log10", "n", "n_hot", "told", "rare", "t"])

    rows = texts.mapInArrow(run, "row bigint, doc_id bigint, held_out boolean, hot_log10 double, n bigint, "
                                 "n_hot bigint, told double, rare array<bigint>, t array<double>")
    one = rows.select("row", F.explode(F.arrays_zip("rare", "t")).alias("x")).select("row", F.col("x.rare").alias("h"), "x.t")
    c = F.coalesce("c", F.lit(0))
    rare = (one.join(vocab.select("h", "c"), "h", "left").groupBy("row").agg(
        F.sum(F.log10(c + ALPHA)).alias("base_rare"),
        F.sum(F.when(c > 0, F.col("t") + F.log10(c + ALPHA)).otherwise(float(np.log10(ALPHA / total)))).alias("score_rare"),
        F.sum((c > 0).cast("bigint")).alias("n_rare")))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    return rows.drop("rare", "t").join(rare, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"),
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("hot_log10") + zero("base_rare") - F.col("n") * float(np.log10(total))).alias("base_score"),
        (F.col("told") + F.col("hot_log10") + zero("score_rare")).alias("score"))
