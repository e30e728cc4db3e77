"""Chosen-path near copies against all pairs on small rows."""

import random
from collections import defaultdict

import numpy as np
import pytest

from shopmetrics.llm import chosen_path as cp
from tests.llm.conftest import SPECIAL
from tests.llm.test_exact import ROWS


def shingles(text, width=5):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def copies(rng, n, words=80, most=3):
    """A text and copies of it with a few words changed: most link with the first, few with each other."""
    pool = [f"w{k}" for k in range(4000)]
    base = [rng.choice(pool) for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        text = list(base)
        for _ in range(rng.randint(1, most)):
            text[rng.randrange(words)] = rng.choice(pool)
        out.append(" ".join(text))
    return out


def got(df, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in cp.near_copies(df, **more).collect()), key=str)


def test_near_copies_are_all_pairs(docs):
    rng = random.Random(7)
    line = "this very line is in all of these texts and in many more of them too"
    rows = ROWS + [(2000 + k, t) for k, t in enumerate(copies(rng, 120))] + [(3000 + k, line + " " + t) for k, t in enumerate(copies(rng, 30, 40, 30))]
    assert got(docs(rows)) == brute(rows)


@pytest.mark.parametrize("sizes", [dict(leaf_rows=12), dict(leaf_rows=5, block_rows=40, block_grams=900)])
def test_large_nodes_branch_or_go_in_blocks(docs, sizes):
    rng = random.Random(9)
    line = " ".join(f"common{k}" for k in range(60))
    rows = [(k, t) for k, t in enumerate(copies(rng, 150, 60, 4))]
    rows += [(500 + k, line + " " + t) for k, t in enumerate(copies(rng, 40, 45, 2))] + [(700 + k, line + " " + " ".join(f"own{k}x{j}" for j in range(35 + k % 9))) for k in range(60)]
    rows += [(900 + k, rows[3][1]) for k in range(30)]
    assert got(docs(rows), **sizes) == brute(rows)


def test_nulls_empty_and_one_text(docs):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, None), (5, ""), (6, "a"), (7, "A"), (8, "x " * 40000)]
    assert got(docs(rows)) == brute(rows)
    assert got(docs([(1, "a")]).limit(0)) == []


def test_special_texts(docs):
    rows = [(k, t) for k, t in enumerate(SPECIAL)]
    assert got(docs(rows)) == brute(rows)


def test_rows_left_apart_were_compared():
    rng = np.random.default_rng(1)
    for seed in range(30):
        base = rng.integers(0, 2**63, 40).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(40) < 0.06, rng.integers(0, 2**63, 40).astype(np.uint64), base)) for _ in range(25)]
        links = cp.connect(sets, np.arange(25), 85)
        label = list(range(25))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        for a in range(25):
            for b in range(a):
                same = len(np.intersect1d(sets[a], sets[b]))
                if 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                    assert label[a] == label[b], seed


def test_few_steps_for_large_nodes(docs, monkeypatch):
    """The steps written do not grow with levels but by two counts and a branching; labelled nodes look for no hubs."""
    from shopmetrics.llm import components

    rng = random.Random(9)
    line = " ".join(f"common{k}" for k in range(60))
    rows = [(k, t) for k, t in enumerate(copies(rng, 150, 60, 4))]
    rows += [(500 + k, line + " " + t) for k, t in enumerate(copies(rng, 40, 45, 2))] + [(700 + k, line + " " + " ".join(f"own{k}x{j}" for j in range(35 + k % 9))) for k in range(60)]
    written = []

    def counted(df, name, write=cp.materialize):
        written.append(name)
        return write(df, name)

    monkeypatch.setattr(cp, "materialize", counted)
    monkeypatch.setattr(components, "materialize", counted)
    assert got(docs(rows), leaf_rows=5, block_rows=40, block_grams=900) == brute(rows)
    levels = written.count("children")
    assert levels > 1 and written.count("groups-once") == 2
    growing = written[written.index("set-classes") + 1 : written.index("standing")]
    assert len(growing) <= 2 + 3 * levels
    again = written[len(written) - written[::-1].index("groups-once") :]
    assert "alike-labels" not in again and "hubs" not in again


def test_nodes_over_several_batches():
    import pyarrow as pa

    path = [1, 2, 2, 2, 3, 4, 4, 5]
    table = pa.table({"path": pa.array(path, pa.int64()), "key": pa.array(range(8), pa.int64())})
    for rows in range(1, 9):
        found = [b.column("key").to_pylist() for b in cp._nodes(iter(table.to_batches(rows)))]
        assert found == [[1, 2, 3], [5, 6]], rows
    assert list(cp._nodes(iter([]))) == []
