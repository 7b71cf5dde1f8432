"""Rewards over the search: whole totals, and narrow rows into the batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import scoring as sc
from scriptorium.operators import search as se
from scriptorium.plans import q_scoring
from tests.conftest import SF_SMALL
from tests.test_search_scale import _papers


def test_batches_number_narrow_rows(spark, monkeypatch):
    """batch_reward_sums: the rows that are kept for the numbering have no prompt or excerpt."""
    seen, real = [], q_scoring.minibatches
    monkeypatch.setattr(q_scoring, "minibatches", lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k))
    assert q_scoring.batch_reward_sums(spark, SF_SMALL).count() > 0
    assert seen == [["seq", "pos", "reward", "draw"]]


def test_responses_are_kept_narrow_and_parsed_once(spark, monkeypatch):
    """batch_reward_sums: neither prompts nor excerpts are kept with the responses, and no plan over them parses again."""
    seen, real = [], q_scoring.jobs.score_query_responses

    def scored(df, *a, **k):
        out = real(df, *a, **k)
        seen.append((df.columns, out._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(q_scoring.jobs, "score_query_responses", scored)
    assert q_scoring.batch_reward_sums(spark, SF_SMALL).count() > 0
    (columns, plan), = seen
    assert columns == ["key", "paperId", "seq", "pos", "response"] and "parse" not in plan.lower()


def test_rewards_use_whole_totals(spark):
    docs = {str(i): "the of" for i in range(300)}
    idx = se.build_index(_papers(spark, docs))
    rows = [(1, "0", "the", None), (2, "299", "the", "search_citation_count"), (3, "99", "of the", None)]
    parsed = (spark.createDataFrame(rows, "key int, paperId string, query string, sort string")
              .withColumn("pre_reward", F.lit(None).cast("double")))
    got = {r.key: (r.total, r["rank"]) for r in sc.query_rewards(idx, parsed, key="key").collect()}
    order = sorted(docs)[:100]           # equal scores: the page is by id
    assert got == {1: (300, 1), 2: (300, None if "299" not in order else sorted(order, key=lambda p: (-(int(p) % 5), order.index(p))).index("299") + 1),
                   3: (300, None if "99" not in order else order.index("99") + 1)}


def test_selections_keep_narrow_rows(spark, monkeypatch):
    """selection_reward: the rows that are kept for the scoring have no result lists and prompts."""
    seen, real = [], q_scoring.jobs.score_selections
    monkeypatch.setattr(q_scoring.jobs, "score_selections", lambda df, **k: seen.append(df.columns) or real(df, **k))
    q_scoring.selection_reward(spark, SF_SMALL).count()
    assert seen == [["item_id", "paperId", "title", "excerpt", "response", "ref_response"]]


def test_supervised_selection_ranks_once(spark, monkeypatch):
    """supervised_selection: the text and the gold selections come from one ranking of the gold rows."""
    calls, real = [], q_scoring.ranked_gold
    monkeypatch.setattr(q_scoring, "ranked_gold", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert q_scoring.supervised_selection(spark, SF_SMALL).count() >= 0
    assert len(calls) == 1
