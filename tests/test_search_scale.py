"""Search without a table of matches: rows sent, blocks of documents and of queries, ties over blocks."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.text import embedding_content, terms
from scriptorium.operators import search as se
from tests.test_relational import _bm25_python


def _papers(spark, docs: dict, parts: int = 4):
    rows = [(k, v, None, int(k) % 5) for k, v in docs.items()]
    return spark.createDataFrame(rows, "paperId string, title string, abstract string, citationCount int").repartition(parts)


def _corpus(n: int = 240) -> dict:
    rng = random.Random(5)
    words = ["the", "of", "graph", "neural", "net", "kernel", "w1", "w2"]
    docs = {str(i): " ".join(rng.choices(words, weights=[9, 7, 4, 3, 3, 2, 1, 1], k=rng.randint(1, 9))) for i in range(n)}
    return docs | {str(n + i): "the of the graph net" for i in range(60)}       # copies: equal scores over all blocks


@pytest.mark.parametrize("small", [False, True])
def test_pages_equal_brute_force_over_blocks(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(se, "BLOCK_TERMS", 20)
        monkeypatch.setattr(se, "BLOCK_PAIRS", 3)
        monkeypatch.setattr(se, "HELD_ROWS", 12)
    docs = _corpus()
    idx = se.build_index(_papers(spark, docs))
    asked = ["the", "the of", "graph net the", "kernel w1", "w2 missing", "of graph"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    got = se.pages(idx, queries, 5).collect()
    for i, q in enumerate(asked):
        want = _bm25_python(docs, q)
        best = sorted(want, key=lambda p: (-want[p], p))[:5]
        rows = sorted((r for r in got if r.qid == i), key=lambda r: r.pos)
        assert [r.paperId for r in rows] == best and all(r.total == len(want) for r in rows), q
        assert [r.pos for r in rows] == list(range(1, len(best) + 1))


def test_rows_sent_do_not_grow_with_the_matches(spark):
    """gold_queries, batch_reward_sums, query_reward: a task sends its page and a count, not its matches."""
    docs = {str(i): f"the of w{i % 2}" for i in range(4000)}
    idx = se.build_index(_papers(spark, docs))
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(["the", "of", "the of", "the w1"])], "qid int, query string")
    sent = se._found(idx, queries, "qid", "query", 10)[1].count()
    assert sent <= 4 * (10 + 1) * min(4, spark.sparkContext.defaultParallelism)
    assert se.matches(idx, queries).count() == 3 * 4000 + 2000


@pytest.mark.parametrize("dense", [1, 10_000])
def test_pages_by_rows_and_by_rarest_term(spark, monkeypatch, dense):
    """batch_reward_sums: the same pages and totals, whichever terms of a block have rows of cells."""
    monkeypatch.setattr(se, "DENSE", dense)
    monkeypatch.setattr(se, "BLOCK_TERMS", 150)
    docs = _corpus()
    idx = se.build_index(_papers(spark, docs, 2))
    asked = ["the", "the of", "graph net the", "kernel w1", "w2 missing", "of graph", "the of graph neural net kernel w1"]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, query string")
    got = se.pages(idx, queries, 7).collect()
    counted = {r.qid: r.total for r in se.total_matches(idx, queries).collect()}
    for i, q in enumerate(asked):
        want = _bm25_python(docs, q)
        rows = sorted((r for r in got if r.qid == i), key=lambda r: r.pos)
        assert [r.paperId for r in rows] == sorted(want, key=lambda p: (-want[p], p))[:7], q
        assert all(r.total == len(want) for r in rows) and counted.get(i, 0) == len(want)


def test_frequent_terms_score_few_documents():
    """batch_reward_sums: of a block's matches of frequent terms only those near the page are scored, all are counted."""
    n, limit = 4000, 10
    rng = np.random.default_rng(3)
    key = np.concatenate([t * n + np.arange(n) for t in range(3)])
    weight = rng.uniform(0.1, 2.0, key.size)
    first, tids = np.array([0, 2, 4, 7]), np.array([0, 1, 1, 2, 0, 1, 2])
    block = se._Block(key, weight, n, first, tids, np.full(3, 2.0), rows=True)
    total, least = np.zeros(3, dtype=np.int64), np.full(3, -np.inf)
    hits = [np.concatenate(x) for x in zip(*block.dense_hits(least, limit, total))]
    assert total.tolist() == [n] * 3 and hits[0].size <= 3 * 3 * limit
    for q in range(3):
        every = sum(weight[t * n:(t + 1) * n] for t in tids[first[q]:first[q + 1]])
        best = np.argsort(-every)[:limit]
        mine = hits[0] == q
        assert set(best) <= set(hits[1][mine]) and np.allclose(every[hits[1][mine]], hits[2][mine])


def test_bags_equal_the_terms(spark, monkeypatch):
    """batch_reward_sums: the index's tokens are those of ``terms``, at the ends of texts and of slices too."""
    monkeypatch.setattr(se, "BAG_BYTES", 16)
    texts = ["The of THE", "the", "", None, "a-b_c  9", "caf\u00e9 \u212a \u0130x na\u00efve", "---", "x\ny z", "end", "end2", "\U0001f600 q"]
    rows = [(i, t, "more Words" if i % 3 == 0 else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "paperId int, title string, abstract string").coalesce(1)
    want = {r.paperId: sorted(r.t) if r.t else [] for r in df.select("paperId", terms(embedding_content(F.col("title"), F.col("abstract"))).alias("t")).collect()}
    got = {r.paperId: r for r in se._entries(df).collect()}
    assert set(got) == set(want)
    for i, t in want.items():
        row = got[i]
        if not t:
            assert (row.dl, row.terms, row.tfs) == (None, None, None)
            continue
        assert row.dl == len(t) and row.terms.split(" ") == sorted(set(t))
        assert np.frombuffer(row.tfs, dtype=np.int32).tolist() == [t.count(x) for x in sorted(set(t))]
    bags = [pa.array([got[i][k] for i in want if want[i]]) for k in ("terms", "tfs")]
    words, counts, held = se._unpacked(*(b.slice(1) for b in bags))
    assert len(words) == counts.size == held.sum() and counts.sum() == sum(len(t) for t in want.values()) - len(want[0])
