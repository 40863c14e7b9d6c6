import hashlib

import duckdb
import numpy as np
import pytest

from docflow.llm import heap_kmeans, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, distance string, ids int"


def _plain(rows, dim, k, rounds, scale=64, seed=1):
    """Lloyd's rounds in whole numbers of any size."""
    good = [(i, [int(np.floor(np.float64(scale) * np.float64(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    good = [(i, [max(-2**27, min(2**27, x)) for x in v]) for i, v in good]
    order = sorted(good, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        own = [min(range(len(cents)), key=lambda j, v=v: (far(v, cents[j]), j)) for _, v in good]
        if r < rounds:
            for j in range(len(cents)):
                mine = [v for (_, v), c in zip(good, own, strict=True) if c == j]
                if mine:
                    cents[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    dist = [far(v, cents[c]) for (_, v), c in zip(good, own, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), c, d, sum(e for e, b in zip(dist, own, strict=True) if b == c), sum(dist), sha[c])
                  for (i, _), c, d in zip(good, own, dist, strict=True))


def _run(spark, rows, dim, k, rounds, **more):
    df = spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in rows], SCHEMA).repartition(3)
    out = heap_kmeans.clusters_of(df, dim=dim, clusters=k, rounds=rounds, **more)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


def test_equals_plain_rounds(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.standard_normal(4) + 3 * (i % 5)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # ties: one vector many times
    rows += [(7, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0, 3.0, 4.0]), (None, [0.0] * 4), (900, None), (901, [1.0] * 3),
             (902, [1.0, None, 2.0, 3.0]), (903, [float("nan")] * 4), (904, [float("inf")] + [0.0] * 3)]
    for k, rounds in ((6, 3), (1, 2), (16, 5)):
        assert _run(spark, rows, 4, k, rounds, block=64) == _plain(rows, 4, k, rounds)


def test_numbers_of_any_size(spark):
    rows = [(i, [float(np.float32(10.0 ** (i % 12))), -3e38 if i == 3 else float(i)]) for i in range(40)]
    got = _run(spark, rows, 2, 4, 3)
    want = _plain(rows, 2, 4, 3)
    most = 2**63 - 1
    assert got == [(i, c, d, min(a, most), min(b, most), s) for i, c, d, a, b, s in want]


def test_few_or_no_vectors(spark):
    assert _run(spark, [(1, [0.5, 0.5]), (2, [9.0, 9.0])], 2, 16, 3) == _plain([(1, [0.5, 0.5]), (2, [9.0, 9.0])], 2, 16, 3)
    assert _run(spark, [(1, None)], 2, 16, 3) == []
    assert _run(spark, [], 2, 16, 3) == []


def test_only_expired_gaps_are_scanned(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.standard_normal(8) * .05 + 20 * (i % 4)).tolist()) for i in range(400)]
    df, counts = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), []
    heap_kmeans.clusters_of(df, dim=8, clusters=4, rounds=4, counts=counts).count()
    assert counts[0] == 400 and counts[-1] < 100  # settled clusters: few gaps expire


def test_heaps_pop_in_order_and_keep_the_rest():
    r = np.random.default_rng(3)
    x = r.integers(-50, 50, (500, 3))
    cents = r.integers(-50, 50, (5, 3))
    block = heap_kmeans.Block(x, 5)
    block.assign(cents, np.zeros(5))
    assert all(h[i][0] <= h[j][0] for h in block.heaps for i in range(len(h)) for j in (2 * i + 1, 2 * i + 2) if j < len(h))
    again = heap_kmeans.Block.load(block.stored(), 3)
    moved = cents + r.integers(-2, 3, cents.shape)
    step = np.sqrt(((moved - cents) ** 2).sum(1))
    drift = step + [np.delete(step, j).max() for j in range(5)]
    again.assign(moved, drift)
    assert 0 < again.rescanned < 500
    assert (again.cluster == heap_kmeans.distances(x, moved).argmin(1)).all()
    assert sorted(m for h in again.heaps for _, m in h) == list(range(500))


@pytest.mark.parametrize("far", [3, 1 << 20, 1 << 27])
def test_distances_are_exact(far):
    r = np.random.default_rng(far)
    x, c = r.integers(-far, far + 1, (40, 64)), r.integers(-far, far + 1, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v, strict=True)) for v in c] for u in x]
    assert heap_kmeans.distances(x, c).tolist() == want


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(queries.SQL["op11_heap_kmeans"]).fetchall())
    assert sorted(map(tuple, queries.op11_heap_kmeans(spark, sf).collect())) == want
