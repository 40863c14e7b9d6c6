import random

import numpy as np

from docflow.llm import circulant_minhash as cm
from tests.llm import brute


def plain(rows, n, percent=80):
    """{id: smallest id linked}, comparing all pairs."""
    rows = [(i, t) for i, t in rows if i is not None]
    up = {i: i for i, _ in rows}
    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    sets = [(i, brute.shingle_set(t, n)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: root(i) for i in up}


def check(spark, rows, n):
    got = cm.near_duplicates(brute.docs(spark, rows), shingle=n).collect()
    want = plain(rows, n)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    sizes = sorted(len(brute.shingle_set(t, n)) for _, t in rows)
    assert sorted(r["n_shingles"] for r in got) == sizes


def test_coordinates_are_one_permutation_shifted():
    perms, r = cm.Circulant(n=32), np.random.default_rng(1)
    hashes = r.integers(0, 2**63, 300).astype(np.uint64)
    second = np.concatenate([perms.shifted[:, 0]])
    place = perms.first[(hashes >> np.uint64(13)).astype(np.int64) & (cm.UNIVERSE - 1)]
    want = [min(second[(p + k) % cm.UNIVERSE] for p in place) for k in range(32)]
    assert perms.signature(hashes).tolist() == want


def test_awkward_rows(spark):
    check(spark, brute.ROWS, 4)
    assert cm.near_duplicates(brute.docs(spark).limit(0)).count() == 0
    check(spark, [(1, None), (2, "")], 5)


def test_chains_hubs_and_copies(spark):
    r = random.Random(2)
    rows, i = [], 0
    for _ in range(6):
        base = [f"v{r.randint(0, 5000)}" for _ in range(r.randint(8, 150))]
        drift = list(base)
        for k in range(14):  # copies of the base, and a chain that drifts away from it
            near = list(base)
            near[r.randrange(len(near))] = f"n{k}"
            drift[r.randrange(len(drift))] = f"d{k}"
            for words in (near, list(drift), base):
                rows.append((i, " ".join(words)))
                i += 1
    r.shuffle(rows)
    check(spark, rows, 4)


def test_a_shared_passage_is_no_link(spark):
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(40)])) for i in range(60)]
    check(spark, rows, 5)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    got = {r["id"]: r["comp"] for r in cm.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500
