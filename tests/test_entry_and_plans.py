"""Driver contract, oracle agreement on the smallest tables, and plan-shape checks."""

import duckdb
import pytest

import __spark_entry__ as entry
from scriptorium.plans import registry
from scriptorium.sources.tables import GIVEN_TABLES
from tools.oracle_check import digest

from .conftest import SF_SMALL

FAST = ["knn_l2_topk", "retrieve_title_list", "paper_scan_filtered", "index_records", "excerpt_explode",
        "attributable_filter", "training_pairs_capped", "rank_queries", "chat_roles", "citation_string",
        "selection_reward", "query_reward"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "message"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    """Of the library's own queries; the optional ones are registered beside them."""
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in GIVEN_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["knn_l2_topk", "corpus_search_topk", "rank_queries", "training_pairs_capped",
                                  "citation_excerpt_rows", "index_upsert_latest"])
def test_no_pairwise_joins(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_per_group_top_k_uses_window_group_limit(spark):
    df = entry.queries()["corpus_search_topk"](spark, SF_SMALL)
    assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def _plan_nodes(node):
    """All physical plan nodes, looking inside adaptive plans and query stages."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _plan_nodes(node.executedPlan())
        return
    yield node
    if name.endswith("QueryStageExec"):
        yield from _plan_nodes(node.plan())
    children = node.children()
    for i in range(children.size()):
        yield from _plan_nodes(children.apply(i))


def _global_windows(df):
    return [n for n in _plan_nodes(df._jdf.queryExecution().executedPlan())
            if n.getClass().getSimpleName() == "WindowExec" and n.partitionSpec().isEmpty()]


def test_no_registered_query_plans_pairwise_joins_or_global_windows(spark):
    """SURVEY §5 scale checks over every registered query's physical plan."""
    from pyspark.sql import Window, functions as F
    probe = spark.range(10).withColumn("rn", F.row_number().over(Window.orderBy("id")))
    assert _global_windows(probe)                       # the detector fires on a global window
    bad = {}
    for name, fn in sorted(registry.queries().items()):
        df = fn(spark, SF_SMALL)
        plan = _plan(df)
        problems = [p for p in ("CartesianProduct", "BroadcastNestedLoopJoin") if p in plan]
        if _global_windows(df):
            problems.append("unpartitioned window")
        if problems:
            bad[name] = problems
    assert not bad, bad
