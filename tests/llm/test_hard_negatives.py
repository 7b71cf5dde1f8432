"""Hard negatives against brute force, and the tree's bounds."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, vec array<int>, leaf string, block int"


def brute(rows, positives=5, negatives=10, window=(30, 90, 100), every=10):
    """Rows of the result, in plain Python over (vec_id, vector, label)."""
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    anchors: dict = {}
    for r in ok:
        if r[0] % every == 0 and (r[0] not in anchors or (r[2], r[1]) < (anchors[r[0]][2], anchors[r[0]][1])):
            anchors[r[0]] = r
    out = []
    for a in anchors.values():
        near = sorted((-dot(a[1], r[1]), r[0], r[2]) for r in ok if r[0] != a[0])
        for s, p, _ in [x for x in near if x[2] == a[2]][:positives]:
            fits = [x for x in near if x[2] != a[2] and window[0] * -s <= window[2] * -x[0] <= window[1] * -s]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits[:negatives])]
    return Counter(out)


def vectors(kind: str, n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        centres = rng.integers(-200, 200, (6, 8))
        v = centres[rng.integers(0, 6, n)] + rng.integers(-12, 12, (n, 8))
    elif kind == "copies":
        v = rng.integers(-3, 4, (7, 4))[rng.integers(0, 7, n)]
        v[: n // 3] = v[0]
    else:
        v = np.floor(256 * rng.normal(0, 0.125, (n, 16)))
    return [(i, [float(x) for x in v[i]], int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("kind", ["clusters", "copies", "random"])
def test_mine(spark, kind):
    """Many small leaves, nulls, short and empty vectors, repeated rows and ids, clashing columns."""
    from scriptorium.llm import hard_negatives as H
    rows = vectors(kind, 400, 3)
    rows += [(400, None, 1), (410, [1.0, None], 1), (420, [float("nan")] * 4, 2), (430, [float("inf")], 0), (None, [1.0], 1), (440, [5.0], None),
             (450, [], 1), (460, [9.0, -2.0], 1), (470, [0.0] * 8, 3), rows[20], rows[20], (20, rows[21][1], 3), rows[33]]
    docs = spark.createDataFrame([(*r, [1], "x", 0) for r in rows], SCHEMA).repartition(3)
    got = H.mine(docs, F.col("id") % 10 == 0, sample_rows=300, branch=4, leaf_rows=12)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)
    assert H.mine(docs.limit(0), F.col("id") % 10 == 0).count() == 0
    assert H.mine(docs, F.col("id") < 0).count() == 0


def test_small_blocks(spark, monkeypatch):
    """Leaves of several blocks, several blocks of anchors."""
    from scriptorium.llm import hard_negatives as H
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", 4)
    monkeypatch.setattr(H, "HELD_ROWS", 50)
    rows = vectors("copies", 300, 5) + [(1000 + i, v, lab) for i, v, lab in vectors("clusters", 200, 6)]
    docs = spark.createDataFrame([(*r, [1], "x", 0) for r in rows], SCHEMA)
    got = H.mine(docs, F.col("id") % 10 == 0, positives=3, negatives=4, window=(1, 2, 2), sample_rows=100, branch=5, leaf_rows=40)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 3, 4, (1, 2, 2))


@pytest.mark.parametrize("kind", ["clusters", "copies", "random"])
def test_tree_bounds(kind):
    """No score leaves the reach of its leaf, and clustered leaves are told apart."""
    from scriptorium.llm import hard_negatives as H
    x = np.array([v for _, v, _ in vectors(kind, 2000, 9)])
    norm = float(np.sqrt((x * x).sum(1).max()))
    tree = H.grow(x[:500], len(x), norm, 6, 40)
    tree.ranges = [(np.full((len(c), len(c)), np.inf), np.full((len(c), len(c)), -np.inf)) for _, c in tree.nodes]

    def seen(node, d, near):
        for j in range(d.shape[1]):
            if (near == j).any():
                tree.ranges[node][0][:, j], tree.ranges[node][1][:, j] = d[near == j].min(0), d[near == j].max(0)
    leaf = tree.leaf_of(x, seen)
    bottom, top = tree.reach(x[:100])
    score = x[:100] @ x.T
    assert (score <= top[:, leaf]).all() and (score >= bottom[:, leaf]).all()
    if kind == "clusters":
        best = np.sort(score, 1)[:, -10]
        assert tree.leaves > 10 and (top >= best[:, None]).mean() < 0.5


def test_oracle(spark):
    from scriptorium.llm import queries as q
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF}/embeddings.parquet')")
    rel = con.execute(q.ORACLE["op13_hard_negatives"])
    cols = [d[0] for d in rel.description]
    assert Counter(tuple(r) for r in q.QUERIES["op13_hard_negatives"](spark, SF).select(cols).collect()) == Counter(rel.fetchall())
