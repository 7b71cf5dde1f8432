"""Periodic runs against brute force."""

from __future__ import annotations

import random

import pytest

from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"


def hostile(rng: random.Random) -> list[str]:
    kind, n = rng.random(), rng.randint(0, rng.choice([5, 30, 120, 400]))
    letters = [f"w{i}" for i in range(rng.choice([1, 2, 3, 5, 50]))]
    if kind < 0.25:
        return rng.choices(letters, k=n)
    if kind < 0.5:  # repeated pieces one after another
        out: list[str] = []
        while len(out) < n:
            out += (rng.choices(letters, k=rng.randint(1, 60)) * rng.randint(1, 6))[:rng.randint(1, 200)]
        return out
    if kind < 0.6:  # Fibonacci words: runs within runs
        a, b = ["a"], ["a", "b"]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind < 0.7:  # Thue-Morse words
        x = ["a"]
        while len(x) < n:
            x = x + ["b" if c == "a" else "a" for c in x]
        return x[:n]
    if kind < 0.85:  # long stretches of one word at a regular distance
        a = ["a"] * rng.randint(1, 40)
        return (a + ["x"]) * rng.randint(1, 8) + a
    s = rng.choices(letters, k=rng.randint(1, 8)) * rng.randint(1, 20)
    return (s + ["z"] * rng.randint(0, 2)) * rng.randint(1, 4)


@pytest.mark.parametrize("min_length", [12, 2, 7])
def test_find_runs(min_length):
    from scriptorium.llm import runs
    rng = random.Random(min_length)
    for _ in range(80):
        texts = [hostile(rng) for _ in range(rng.randint(1, 6))]
        got = runs.runs_of([[w.encode() for w in t] for t in texts], min_length)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [H.word_runs(t, min_length) for t in texts]


def test_small_chunks(monkeypatch):
    """Pairs expanded a few at a time give the same runs."""
    from scriptorium.llm import runs
    monkeypatch.setattr(runs, "CHUNK", 3)
    rng = random.Random(3)
    for _ in range(30):
        t = hostile(rng)
        assert [tuple(r) for r in runs.runs_of([[w.encode() for w in t]])[0].tolist()] == H.word_runs(t)


def test_long_stretch_is_linear():
    """A text of one word: the pairs stay in proportion to its length."""
    from scriptorium.llm import runs
    made = 0
    plain = runs.seeds

    def counted(*args):
        nonlocal made
        for i, lag in plain(*args):
            made += len(i)
            yield i, lag
    runs.seeds = counted
    try:
        n = 100_000
        assert runs.runs_of([[b"a"] * n])[0].tolist() == [[0, n, 1]]
    finally:
        runs.seeds = plain
    assert made < 20 * n


def test_periodic_runs_edges(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns; an empty table."""
    from scriptorium.llm import runs
    rows = H.corpus() + [(900, "x " * 30), (901, "a b c " * 4000), (902, "= \t=\n" * 9)]
    docs = H.frame(spark, rows).withColumnRenamed("key", "runs").withColumnRenamed("kept", "id")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed_sha256, H.sha(r.collapsed))
                 for r in runs.periodic_runs(docs).collect())
    want = []
    for d, t in rows:
        words = (t or "").split()
        found = [(0, 12000, 3)] if d == 901 else H.word_runs(words) if len(words) < 3000 else []
        kept = H.sha(" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)))
        want.append((d is None, d or 0, len(words), tuple(found), kept, kept))
    assert got == sorted(want)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark):
    from scriptorium.llm import queries as q
    rows = [tuple(r) for r in q.table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in q.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert got == {d: H.run_row(d, H.planted_words(d, t)) for d, t in rows}
    assert sum(r[0] > 0 for r in got.values()) > 10
