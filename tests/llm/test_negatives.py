"""Hard negatives against all pairs on small rows, and the cover tree's own bounds."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmetrics.llm import hard_negatives as hn


def brute(rows):
    rows = [(at, i, label, [math.floor(256 * v) for v in x]) for at, (i, x, label) in enumerate(rows) if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    by_score = lambda r: (-r[0], r[2] is None, r[2] or 0)
    out = Counter()
    for at, i, label, x in rows:
        if i is None or i % 50:
            continue
        others = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), t, j, same) for t, j, same, y in rows if t != at]
        for ps, _, j, _ in sorted((o for o in others if o[3] == label), key=by_score)[:5]:
            inside = sorted((o for o in others if o[3] != label and 50 * ps <= 100 * o[0] <= 95 * ps), key=by_score)
            for rank, (ns, _, n, _) in enumerate(inside[:3], 1):
                out[i, j, rank, n, ps, ns] += 1
    return out


def some(seed=5, n=400, width=6):
    rng = random.Random(seed)
    hubs = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    rows = [(k, [h + rng.gauss(0, 0.2) for h in rng.choice(hubs)], rng.randrange(4)) for k in range(n)]
    rows += [(1000 + k, [0.5] * width, k % 2) for k in range(60)]  # ties, and copies under two labels
    rows += [(2000, [0.0] * width, 1), (2050, [1.0, 2.0], 1), (2100, [], 2), (2150, [1e30] * width, 3), (2151, [1e30] * width, 1), (2152, [9e29] * width, 3)]
    rows += [(2200, None, 1), (2250, [1.0] * width, None), (2300, [float("nan")] * width, 1), (2350, [None] + [1.0] * (width - 1), 1), (2400, [float("inf")] * width, 1), (None, [0.6] * width, 1)]
    return rows + [rows[0], rows[50], rows[50]]


@pytest.fixture(scope="module")
def table(ready):
    schema = "vec_id long, embedding array<double>, label int, at string, qid long, centre string, score long, n string, vec binary, x int, own string"

    def make(rows, parts=3):
        return ready.createDataFrame([(*r, "a", 1, "c", 2, "n", b"v", 3, "o") for r in rows], schema).repartition(parts)

    return make


def mined(df, **more):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in hn.mine(df, anchor=F.col("vec_id") % 50 == 0, **more).select(columns).collect())


@pytest.mark.parametrize("cell", [hn.CELL, 25])
def test_mining_is_all_pairs(table, cell):
    rows = some()
    assert mined(table(rows), cell=cell) == brute(rows)


def test_mining_without_rows_or_anchors(table):
    assert not mined(table(some()).limit(0))
    assert not mined(table([(1, [1.0], 0), (2, [1.0], 1)]))


def test_many_queries_are_sliced(table, monkeypatch):
    monkeypatch.setattr(hn, "QUERIES_AT_ONCE", 3)
    rows = some(seed=8, n=200)
    assert mined(table(rows), cell=40) == brute(rows)


def test_tree_covers_and_prunes():
    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(12, 16)) * 400
    points = np.floor(np.concatenate([h + rng.normal(size=(100, 16)) * 8 for h in hubs]))
    most = float(np.sqrt((points**2).sum(1)).max())
    tree = hn.CoverTree(points, most)
    apart = hn._angles(points, points, most)
    below = [{int(p)} for p in tree.point]
    for node in reversed(range(len(tree.point))):  # a child has a larger number than its parent
        for child in tree.child[tree.first[node] : tree.first[node + 1]].tolist():
            assert child > node
            below[node] |= below[child]
        assert apart[tree.point[node], list(below[node])].max() <= tree.radius[node] + 1e-9
    assert below[0] == set(range(len(points))) and tree.fresh.sum() == len(points)
    looked = []
    scores = tree._scores
    tree._scores = lambda rows, query, exact: looked.append(len(rows)) or scores(rows, query, exact)
    for query in points[::90]:
        want = np.sort(points @ query)[-6:]
        ((_, got),) = tree.search(query, [(-np.inf, np.inf, 6)])
        assert np.array_equal(np.sort(got)[-6:], want)
    assert sum(looked) < 0.5 * len(points) * len(points[::90])  # most nodes are skipped


def test_copies_are_one_point(table, ready):
    rows = [(k, [1.0, 0.0], 1) for k in range(0, 3000)] + [(5000 + k, [0.9, 0.01 * k], 2) for k in range(5)]
    got = mined(table(rows))
    assert sum(got.values()) == 60 * 5 * 3
