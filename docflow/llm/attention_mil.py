"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` words); only documents carry labels.
Every passage is encoded from its byte statistics, h = tanh(x W + b); gated attention
a = softmax(w . (tanh(h V) * sigmoid(h U))) weighs the passages, and the weighted passage
representation gives the document's score.

Training uses a bounded sample of labelled rows (``max_docs`` of them, by hash order of the
id); its passages' statistics are computed by tasks and the parameters (some hundred numbers)
are fitted by Adam on the driver. Scoring covers every passage of every whole text in one
narrow stage.

Defined cases: a null or empty text is one passage of zero counts; without labelled rows, or
with one class only, every score is that class (1 without labels); repeated rows are scored
each; several labels of one id count as their largest; other columns pass through (one called
``score`` is replaced); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docflow.llm.common import remainder

PASSAGE = 48
#: Byte classes: other sign, blank, line end, A-Z, a-z, digit, !, symbol, bar, punctuation, non-ASCII.
CLASSES = 11


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.int64)
    for k, signs in ((1, b" \t\r\x0b\x0c"), (2, b"\n"), (3, bytes(range(65, 91))), (4, bytes(range(97, 123))),
                     (5, b"0123456789"), (6, b"!"), (7, b"#*$%&<>@^~=+\\/_"), (8, b"|"), (9, b".,;:?'\"()-"),
                     (10, bytes(range(128, 256)))):
        table[list(signs)] = k
    return table


TABLE = _class_table()
POWERS = np.random.default_rng(7).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of all passages of all texts (rows), and how many each text has (>= 1)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    cls = TABLE[data]
    blank = (cls == 1) | (cls == 2)
    edge = np.diff(blank.astype(np.int8))
    start, stop = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    size = np.array([len(r) + 1 for r in raw])
    doc = np.searchsorted(np.cumsum(size), start - 1, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    inside = np.arange(len(start)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    opens = inside % PASSAGE == 0
    counts = -(-n_words // PASSAGE)
    rows = np.zeros((int(opens.sum()), CLASSES + 4))
    if len(start):
        passage = np.cumsum(opens) - 1
        at = start[opens]
        of_byte = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(data))))
        # Blanks before a text's first word are no passage's, also not those of the text before it.
        own = np.arange(at[0], len(data)) <= np.cumsum(size)[doc[opens]][of_byte]
        cell = (of_byte * CLASSES + cls[at[0]:])[own]
        rows[:, :CLASSES] = np.bincount(cell, minlength=len(at) * CLASSES).reshape(-1, CLASSES)
        place = (np.arange(len(data) - start[0]) - np.repeat(start - start[0], np.diff(np.append(start, len(data))))) & 63
        mixed = data[start[0]:].astype(np.uint64) * POWERS[place]
        mixed[blank[start[0]:]] = 0
        code = np.add.reduceat(mixed, start - start[0])
        long = stop - start
        for col, lag in ((CLASSES, 1), (CLASSES + 1, 2)):
            same = np.zeros(len(start), bool)
            same[lag:] = (code[lag:] == code[:-lag]) & (doc[lag:] == doc[:-lag])
            rows[:, col] = np.bincount(passage, same, len(at))
        rows[:, CLASSES + 2] = np.bincount(passage, long <= 3, len(at))
        rows[:, CLASSES + 3] = np.bincount(passage, minlength=len(at))
    out = np.zeros((int(np.maximum(counts, 1).sum()), rows.shape[1]))
    out[np.repeat(counts > 0, np.maximum(counts, 1))] = rows
    return out, np.maximum(counts, 1)


def encode(rows: np.ndarray) -> np.ndarray:
    """Rates per byte and per word, and the passage's length."""
    n_bytes = np.maximum(rows[:, :CLASSES].sum(1, keepdims=True), 1)
    words = np.maximum(rows[:, -1:], 1)
    return np.hstack([rows[:, :CLASSES] / n_bytes, rows[:, CLASSES:-1] / words,
                      rows[:, -1:] / PASSAGE, n_bytes / words / 10])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Parameters and passes of the network; ``first`` are the bags' first rows."""

    def __init__(self, width: int, hidden: int = 12, gate: int = 8, seed: int = 11):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = {"W": r.normal(0, width**-0.5, (width, hidden)), "b": np.zeros(hidden),
                  "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)),
                  "w": r.normal(0, gate**-0.5, gate), "c": np.zeros(hidden), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray, n: np.ndarray):
        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(a[:, None] * h, first)
        return h, t, s, a, z, _sigmoid(z @ p["c"] + p["d"])

    def score(self, x, n):
        return self.forward(x, np.cumsum(n) - n, n)[-1]

    def fit(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.03,
            decay: float = 1e-4) -> None:
        if len(y) == 0 or y.min() == y.max():
            self.p["d"][:] = 30.0 if len(y) == 0 or y[0] > 0.5 else -30.0
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        first, p = np.cumsum(n) - n, self.p
        xs = (x - self.mean) / self.scale
        m1 = {k: np.zeros_like(v) for k, v in p.items()}
        m2 = {k: np.zeros_like(v) for k, v in p.items()}
        for step in range(1, steps + 1):
            h, t, s, a, z, out = self.forward(x, first, n)
            err = (out - y) / len(y)
            dz = np.repeat(err[:, None] * p["c"], n, axis=0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
            dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
            dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            grad = {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds,
                    "w": (t * s).T @ de, "c": z.T @ err, "d": err.sum(keepdims=True)}
            for k, g in grad.items():
                g = g + decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, held_mod: int = 4, held: int = 2) -> Model:
    """Fit on at most ``max_docs`` labelled rows whose crc32 remainder is not ``held``."""
    known = (labels.where(F.col("quality").isNotNull() & (remainder("doc_id", held_mod) != held))
             .groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    bags = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")

    def stats(batches):
        for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            rows, n = passages([t or "" for t in b.column("text").to_pylist()])
            parts = np.split(rows.ravel(), np.cumsum(n * rows.shape[1])[:-1])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("y"), pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))],
                names=["doc_id", "y", "x"])

    width = CLASSES + 4
    got = sorted(bags.mapInArrow(stats, "doc_id bigint, y double, x array<double>").collect(),
                 key=lambda r: (r["doc_id"], r["x"]))
    model = Model(width + 1)
    rows = [np.array(r["x"]).reshape(-1, width) for r in got]
    x = encode(np.concatenate([np.zeros((0, width)), *rows]))
    model.fit(x, np.array([len(r) for r in rows], np.int64), np.array([r["y"] for r in got]))
    return model


def score(docs: DataFrame, model: Model, batch_chars: int = 250_000) -> DataFrame:
    """``docs`` plus ``score`` of the whole ``text``, about ``batch_chars`` at a time."""

    def run(batches):
        for batch in batches:
            done, held, size = [], [], 0
            for i, text in enumerate(batch.column("text"), 1):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= batch_chars or i == batch.num_rows:
                    rows, n = passages(held)
                    done.append(model.score(encode(rows), n))
                    held, size = [], 0
            yield batch.set_column(batch.schema.get_field_index("score"), batch.schema.field("score"),
                                   pa.array(np.concatenate([np.zeros(0), *done]), pa.float64()))

    out = docs.drop("score").withColumn("score", F.lit(None).cast("double"))
    return out.mapInArrow(run, out.schema)
