"""Texts are read past small tables, not shuffled: gold queries and the metadata of ranked pages."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import search as se
from scriptorium.plans import q_search
from scriptorium.sources import tables as tb
from tests.conftest import SF_MID, SF_SMALL


@pytest.fixture(autouse=True)
def _only_named_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _shuffles(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning", line)]


def test_passages_stream_the_documents(spark):
    """search_resort_page: no document text and no token of a document is dealt out."""
    bench, docs = tb.table(spark, SF_MID, "benchmark"), tb.documents(spark, SF_MID)
    found = tb.passage_sources(bench, docs)
    assert not [x for x in _shuffles(found) if "_did" in x]
    want = {(b.item_id, d.doc_id) for b in bench.collect() for d in docs.select("doc_id", "text").collect() if b.text in d.text}
    assert want and {tuple(r) for r in found.collect()} == want


def test_large_passage_tables_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alphabet agamma"), (3, "be"), (4, None)], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "alpha beta gamma"), (4, "zz"), (5, "a"), (6, "")], "item_id long, text string")
    want = {(1, 1), (2, 1), (3, 1), (5, 1), (5, 2)}
    for most in (tb.PASSAGE_BYTES, 0):
        monkeypatch.setattr(tb, "PASSAGE_BYTES", most)
        assert {tuple(r) for r in tb.passage_sources(passages, docs).collect()} == want


def test_metadata_is_read_past_a_small_page(spark):
    """choose_action: titles and abstracts are not shuffled to the page."""
    idx, g = q_search.search_gold(spark, SF_SMALL)
    few = se.with_meta(se.pages(idx, g, 5), idx)
    assert not _shuffles(few) and few.select("abstract").count() == se.pages(idx, g, 5).count()
    assert few.where(F.col("title").isNull()).count() == 0
