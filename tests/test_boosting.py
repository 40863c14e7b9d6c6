import numpy as np
import pytest

from docflow.operators import boosting
from docflow.session import scratch_path


def _frame(spark, x, y, parts=4):
    return spark.createDataFrame([(i, str(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y, strict=True))],
                                 "id int, label string, features array<double>").repartition(parts)


def _rings(n=400, seed=1):
    """Three classes that no linear head parts: by distance from the middle."""
    r = np.random.default_rng(seed)
    x = r.uniform(-1, 1, (n, 3))
    return x, np.digitize(np.abs(x[:, 0]) + np.abs(x[:, 1]), [0.6, 1.1])


def test_nonlinear_classes_are_learnt_and_held_out(spark):
    x, y = _rings()
    model = boosting.fit(_frame(spark, x[:300], y[:300]), trees=6, rate=0.3, leaves=8, keep_every=2)
    assert model.classes == ["0", "1", "2"] and all(len(r) == 3 for r in model.rounds)
    assert all(sum(f < 0 for f in t.feature) <= 8 for r in model.rounds for t in r)
    out = boosting.predict(model, _frame(spark, x[300:], y[300:])).collect()
    assert np.mean([r["intent"] == r["label"] for r in out]) > 0.8
    assert all(1 / 3 <= r["confidence"] <= 1 for r in out)


def test_the_same_trees_however_the_rows_are_dealt_and_after_reload(spark):
    x, y = _rings(150)
    one = boosting.fit(_frame(spark, x, y, 1), trees=3, rate=0.3, leaves=6, block=1000)
    many = boosting.fit(_frame(spark, x, y, 7), trees=3, rate=0.3, leaves=6, block=10, keep_every=1)
    assert one.to_json() == many.to_json()
    path = scratch_path(spark, "boost-test")
    boosting.save(one, spark, path, 3)
    again, dim = boosting.load(spark, path)
    assert dim == 3 and again.to_json() == one.to_json()


def test_first_split_is_the_best_of_all(spark):
    x, y = _rings(80)
    model = boosting.fit(_frame(spark, x, y), trees=1, rate=1.0, leaves=2, balanced=False, least_rows=5)
    bins = boosting.binned(x, model.edges)
    prior = np.bincount(y) / len(y)
    for k, tree in enumerate(model.rounds[0]):
        g, h = prior[k] - (y == k), np.full(len(y), prior[k] * (1 - prior[k]))
        best = max(((lambda m: (g[m].sum() ** 2 / h[m].sum() + g[~m].sum() ** 2 / h[~m].sum()))(bins[:, f] <= b), -f, -b)
                   for f in range(3) for b in range(bins[:, f].max()) if 5 <= (bins[:, f] <= b).sum() <= len(y) - 5)
        left = bins[:, tree.feature[0]] <= tree.cut[0]
        got = g[left].sum() ** 2 / h[left].sum() + g[~left].sum() ** 2 / h[~left].sum()
        assert got == pytest.approx(best[0], rel=1e-5)
        assert tree.value[1] == pytest.approx(-g[left].sum() / h[left].sum(), rel=1e-4)


def test_defined_cases(spark):
    x, y = _rings(20)
    only = boosting.fit(_frame(spark, x, np.zeros(20, int)), trees=3)
    assert {(r["intent"], r["confidence"]) for r in boosting.predict(only, _frame(spark, x, y)).collect()} == {("0", 1.0)}
    x[3, 1] = np.nan
    model = boosting.fit(_frame(spark, x, y), trees=1, leaves=3)
    assert boosting.predict(model, _frame(spark, x, y)).count() == 20
    assert boosting.predict(model, _frame(spark, x, y).limit(0)).count() == 0
    bad = [[], [(1, None, [1.0])], [(1, "a", None)], [(1, "a", [1.0]), (2, "b", [1.0, 2.0])]]
    for rows in bad:
        with pytest.raises(ValueError):
            boosting.fit(spark.createDataFrame(rows, "id int, label string, features array<double>"))
    with pytest.raises(ValueError):
        boosting.fit(_frame(spark, x, y), bins=1)
