"""M1, M2: multiclass gradient-boosted trees, trained on feature histograms that Spark combines.

Softmax boosting: each round grows one tree per class on the gradients of the class-weighted
log loss. Features are cut into at most ``bins`` bins at the quantiles of a bounded sample
(``sample_rows`` rows by hash order: a documented parameter); all rows are trained on. Rows lie in
blocks of bin numbers, written once and read by every pass.

A pass is one job for all classes' trees at once: every task adds up, per open leaf, feature and
bin, the gradients, curvatures and rows; Spark adds the tasks' histograms and keeps each leaf's best
split. The driver gets one row per open leaf. Trees grow leaf-wise: of the leaves that can be
split, the better half by gain is split before the next pass, until ``leaves`` are reached.

Gradients are added as whole numbers of 2^-24, so sums are exact: however the rows are dealt,
the same rows give the same trees. The running scores are written every ``keep_every`` rounds, which
bounds what a pass computes again; a lost executor's blocks are read again.

Defined cases: one class only gives that class with confidence 1; a null label or vector, or
vectors of several lengths, are an error; NaN falls in the first bin; an empty table is an error.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.session import Shipped, saved

UNIT = float(1 << 24)
LEAST_CURVATURE = 1e-3


class Tree:
    """A binary tree over bin numbers: rows with ``bin <= cut`` go left; a leaf has a value."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, a, a + 1
        for column, blank in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column += [blank, blank]
        return a, a + 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        inner = feature[node] >= 0
        while inner.any():
            at, who = node[inner], rows[inner]
            node[inner] = np.where(x[who, feature[at]] <= cut[at], left[at], right[at])
            inner = feature[node] >= 0
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(x)]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, np.nan_to_num(x[:, j], nan=-np.inf), side="left")
    return out


class Model:
    def __init__(self, classes: list[str], edges: list[np.ndarray], base: np.ndarray):
        self.classes, self.edges, self.base = classes, edges, base
        self.rounds: list[list[Tree]] = []

    def raw(self, bins: np.ndarray, scores: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        """Scores of the rows after all rounds; ``scores`` already hold those before ``first``."""
        out = np.tile(self.base, (len(bins), 1)) if scores is None else scores.copy()
        for trees in self.rounds[first:]:
            for k, t in enumerate(trees):
                out[:, k] += t.score(bins)
        return out

    def to_json(self) -> str:
        tree = lambda t: [t.feature, t.cut, t.left, t.right, t.value]
        return json.dumps({"classes": self.classes, "edges": [e.tolist() for e in self.edges], "base": self.base.tolist(),
                           "rounds": [[tree(t) for t in r] for r in self.rounds]})

    @classmethod
    def from_json(cls, text: str) -> Model:
        d = json.loads(text)
        out = cls(d["classes"], [np.array(e) for e in d["edges"]], np.array(d["base"]))
        for r in d["rounds"]:
            trees = []
            for columns in r:
                t = Tree()
                t.feature, t.cut, t.left, t.right, t.value = columns
                trees.append(t)
            out.rounds.append(trees)
        return out


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _blocks(rows: DataFrame, label: str, vec: str, shared, dim: int, block: int) -> DataFrame:
    def run(batches):
        model, weights = shared.value
        number = {c: i for i, c in enumerate(model.classes)}
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                y = np.array([number[c] for c in part.column(0).to_pylist()], np.int32)
                bins = binned(_matrix(part.column(1), dim), model.edges)
                yield pa.RecordBatch.from_pydict({"bins": [bins.tobytes()], "y": [y.tobytes()], "w": [weights[y].tobytes()],
                                                  "scores": [model.raw(bins).tobytes()]})

    return rows.select(label, vec).mapInArrow(run, "bins binary, y binary, w binary, scores binary")


def _load(row: dict, dim: int, classes: int):
    return (np.frombuffer(row["bins"], np.uint8).reshape(-1, dim), np.frombuffer(row["y"], np.int32), np.frombuffer(row["w"]),
            np.frombuffer(row["scores"]).reshape(-1, classes))


def _each(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            yield one, {c: one.column(c)[0].as_py() for c in one.schema.names}


def _rescored(blocks: DataFrame, shared, dim: int, first: int) -> DataFrame:
    """The blocks with the scores after the rounds from ``first`` on."""

    def run(batches):
        model = shared.value
        for one, row in _each(batches):
            bins, _, _, scores = _load(row, dim, len(model.classes))
            made = pa.array([model.raw(bins, scores, first).tobytes()], pa.binary())
            yield one.set_column(one.schema.get_field_index("scores"), "scores", made)

    return blocks.mapInArrow(run, blocks.schema)


def _best_splits(blocks: DataFrame, shared, dim: int, bins: int, least_rows: int) -> list:
    """Per open leaf its totals and best split. ``shared``: (model, first round that the scores lack, the
    growing trees, open leaves per class)."""

    def run(batches):
        model, first, trees, open_ = shared.value
        total = {(k, n): np.zeros((3, dim * bins), np.int64) for k, nodes in enumerate(open_) for n in nodes}
        offset = np.arange(dim) * bins
        for _, row in _each(batches):
            x, y, w, scores = _load(row, dim, len(model.classes))
            p = softmax(model.raw(x, scores, first))
            for k, nodes in enumerate(open_):
                if not nodes:
                    continue
                leaf = trees[k].leaf_of(x)
                g = np.rint(w * (p[:, k] - (y == k)) * UNIT)
                h = np.rint(w * p[:, k] * (1 - p[:, k]) * UNIT)
                for n in nodes:
                    mine = np.flatnonzero(leaf == n)
                    cell = (x[mine] + offset).ravel()
                    for j, v in enumerate((g, h, None)):
                        weight = None if v is None else np.repeat(v[mine], dim)
                        total[k, n][j] += np.bincount(cell, weight, dim * bins).astype(np.int64)
        rows = [(k, n, t.tobytes()) for (k, n), t in total.items()]
        yield pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in rows], pa.int32()), "node": pa.array([r[1] for r in rows], pa.int32()),
                                          "hist": pa.array([r[2] for r in rows], pa.binary())})

    def best(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((3, dim, bins), np.int64)
        for raw in part["hist"]:
            total += np.frombuffer(raw, np.int64).reshape(total.shape)
        g, h = total[0] / UNIT, total[1] / UNIT
        n = total[2]
        left = np.cumsum(total, 2)
        gl, hl, nl = left[0] / UNIT, left[1] / UNIT, left[2]
        all_g, all_h, all_n = g[0].sum(), h[0].sum(), n[0].sum()
        gr, hr, nr = all_g - gl, all_h - hl, all_n - nl
        fits = (nl >= least_rows) & (nr >= least_rows) & (hl >= LEAST_CURVATURE) & (hr >= LEAST_CURVATURE)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, gl * gl / hl + gr * gr / hr, -np.inf)
        at = int(gain.argmax())
        f, b = divmod(at, bins)
        won = gain[f, b] - all_g * all_g / max(all_h, LEAST_CURVATURE)
        out = {"k": part["k"].iloc[0], "node": part["node"].iloc[0], "g": all_g, "h": all_h, "feature": f, "cut": b,
               "gain": won if np.isfinite(won) else -1.0, "gl": gl[f, b], "hl": hl[f, b]}
        return pd.DataFrame([out])

    hists = blocks.mapInArrow(run, "k int, node int, hist binary")
    return hists.groupBy("k", "node").applyInPandas(
        best, "k int, node int, g double, h double, feature int, cut int, gain double, gl double, hl double").collect()


def _grow(blocks: DataFrame, model: Model, first: int, dim: int, bins: int, leaves: int, least_rows: int, rate: float) -> list[Tree]:
    """One tree per class on the gradients after the model's rounds."""
    spark = blocks.sparkSession
    trees = [Tree() for _ in model.classes]
    open_, count = [[0] for _ in trees], [1] * len(trees)
    ready: list[list] = [[] for _ in trees]
    value = lambda g, h: -rate * g / max(h, LEAST_CURVATURE)
    while any(open_):
        shared = Shipped(spark, (model, first, trees, open_))
        for r in sorted(_best_splits(blocks, shared, dim, bins, least_rows), key=lambda r: (r["k"], r["node"])):
            k, node = r["k"], r["node"]
            trees[k].value[node] = value(r["g"], r["h"])
            if r["gain"] > 1e-9:
                heapq.heappush(ready[k], (-r["gain"], node, r["feature"], r["cut"]))
        open_ = [[] for _ in trees]
        for k, tree in enumerate(trees):
            for _ in range(min(-(-len(ready[k]) // 2), leaves - count[k])):
                _, node, feature, cut = heapq.heappop(ready[k])
                open_[k] += tree.split(node, feature, cut)
                count[k] += 1
    return trees


def fit(train: DataFrame, label: str = "label", vec: str = "features", trees: int = 200, rate: float = 0.05, leaves: int = 31,
        least_rows: int = 5, bins: int = 64, balanced: bool = True, sample_rows: int = 20_000, keep_every: int = 8,
        block: int = 4096) -> Model:
    """Train on ``train`` (<label>, <vec>: array of numbers). ``trees``: rounds, one tree per class each."""
    if not 2 <= bins <= 256 or leaves < 2:
        raise ValueError("bins must be 2 to 256, leaves 2 at least")
    rows = saved(train.select(F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("vec")), "boost-rows")
    spark, size = rows.sparkSession, F.size("vec")
    facts = rows.agg(F.count_if(F.col("label").isNull() | F.col("vec").isNull()).alias("bad"), F.min(size).alias("lo"),
                     F.max(size).alias("hi"), F.count("*").alias("n")).first()
    if not facts["n"] or facts["bad"] or facts["lo"] != facts["hi"]:
        raise ValueError("training rows need a label and vectors of one length")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row a class
    classes, dim = sorted(counts), facts["lo"]
    n = np.array([counts[c] for c in classes], np.float64)
    weights = n.sum() / (len(n) * n) if balanced else np.ones(len(n))
    sample = rows.orderBy(F.xxhash64("vec"), "label").limit(sample_rows).collect()
    sample = np.array([r["vec"] for r in sample])
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(np.nan_to_num(c), cuts, method="higher")) for c in sample.T]
    prior = n * weights / (n * weights).sum()
    model = Model(classes, edges, np.log(prior))
    if len(classes) == 1:
        return model
    blocks, first = saved(_blocks(rows, "label", "vec", Shipped(spark, (model, weights)), dim, block), "boost"), 0
    for r in range(trees):
        if r - first >= keep_every:
            blocks, first = saved(_rescored(blocks, Shipped(spark, model), dim, first), "boost"), r
        model.rounds.append(_grow(blocks, model, first, dim, bins, leaves, least_rows, rate))
    return model


def predict(model: Model, df: DataFrame, vec: str = "features") -> DataFrame:
    """M2: ``df`` (without <vec>) plus intent and confidence, the winning class's probability. Narrow."""
    shared, dim = Shipped(df.sparkSession, model), len(model.edges)
    keep = [c for c in df.columns if c not in (vec, "intent", "confidence")]

    def run(batches):
        m = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("_vec")
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                p = softmax(m.raw(binned(_matrix(part.column(at), dim), m.edges)))
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(j) for j in range(at)), pa.array([m.classes[k] for k in best.tolist()]), pa.array(p.max(1))],
                    names=[*keep, "intent", "confidence"])

    rows = df.select(*keep, F.col(vec).cast("array<double>").alias("_vec"))
    schema = rows.drop("_vec").withColumn("intent", F.lit("")).withColumn("confidence", F.lit(0.0)).schema
    return rows.mapInArrow(run, schema)


def save(model: Model, spark: SparkSession, path: str, dim: int) -> None:
    """The model and the dimension it was trained with."""
    spark.createDataFrame([(dim, model.to_json())], "dim int, model string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[Model, int]:
    row = spark.read.parquet(path).first()
    return Model.from_json(row["model"]), row["dim"]
