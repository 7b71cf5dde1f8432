"""Golden tables for the ranking and reward ladders."""

import json
import math

from pyspark.sql import Row
from pyspark.sql import functions as F

from scriptorium.operators import ranking as rk
from scriptorium.operators import scoring as sc
from scriptorium.operators import search as se
from scriptorium.operators.sampling import draw_candidates

RES = "array<struct<paperId:string,citationCount:int,title:string,abstract:string>>"


def _res(*items):
    return [Row(paperId=p, citationCount=c, title="t" + p, abstract=None) for p, c in items]


def test_rank_query_cases(spark):
    rows = [
        ("found", "b", _res(("a", 5), ("b", 9), ("c", 9))),          # stable tie: b before c
        ("absent", "z", _res(("a", 5), ("b", 9))),
        ("null_count", "a", _res(("a", None), ("b", 3))),            # sort fails -> sentinel
        ("single_null", "a", _res(("a", None))),                     # no comparison -> no failure
        ("empty", "a", []),
    ]
    df = spark.createDataFrame(rows, f"case string, paperId string, results {RES}")
    out = {r.case: r for r in rk.ranked(df).collect()}
    assert (out["found"].relevance_rank, out["found"].citation_rank, out["found"].citations) == (1, 0, 9)
    assert (out["absent"].relevance_rank, out["absent"].citation_rank, out["absent"].citations) == (-1, -1, -1)
    assert (out["null_count"].relevance_rank, out["null_count"].citation_rank,
            out["null_count"].citations, out["null_count"].results) == (100, 100, -1, [])
    assert out["single_null"].relevance_rank == 0
    assert (out["empty"].relevance_rank, out["empty"].citations) == (-1, -1)


def test_selectable_and_choose_action(spark):
    df = spark.createDataFrame([
        ("a", -1, -1, _res(("x", 1))),        # -1 passes F7, F8 removes it
        ("a", 100, 100, _res(("a", 1))),      # error row removed by F7
        ("a", 3, 50, _res(("a", 1))),
        ("a", 20, 2, _res(("a", 1))),
    ], f"paperId string, relevance_rank int, citation_rank int, results {RES}")
    kept = rk.selectable(df).select("relevance_rank").collect()
    assert sorted(r[0] for r in kept) == [3, 20]
    acts = df.select(rk.choose_action(F.col("relevance_rank"), F.col("citation_rank"))).collect()
    assert [a[0] for a in acts] == ["search_citation_count", "search_citation_count",
                                    "search_relevance", "search_citation_count"]


def test_draw_candidates_contains_target_once(spark):
    items = _res(*[(str(i), i) for i in range(12)])
    df = spark.createDataFrame([(str(t), items, k) for t in range(12) for k in (2, 3, 4, 5)],
                               f"paperId string, results {RES}, k int")
    out = df.select("paperId", "k", draw_candidates(F.col("results"), F.col("paperId"), F.col("k"), "7",
                                                    F.col("paperId")).alias("c")).collect()
    for r in out:
        ids = [c.paperId for c in r.c]
        assert ids.count(r.paperId) == 1 and len(ids) == r.k and len(set(ids)) == len(ids)


def _tiny_index(spark):
    papers = spark.createDataFrame([
        ("p1", "graph neural networks", "message passing", 10),
        ("p2", "graph kernels", None, 50),
        ("p3", "neural machine translation", "attention", 7),
    ], "paperId string, title string, abstract string, citationCount int")
    return se.build_index(papers)


def test_query_reward_ladder(spark):
    idx = _tiny_index(spark)

    def resp(q, name="search_relevance", reason="r"):
        return json.dumps({"reason": reason, "action": {"name": name, "query": q}})

    rows = [
        ("invalid", "p1", "{bad json"),
        ("noreason", "p1", json.dumps({"action": {"name": "x", "query": "graph"}})),
        ("blank", "p1", resp("   ")),
        ("multiline", "p1", resp("graph\nneural")),
        ("digits", "p1", resp("1 2")),
        ("nonstr", "p1", json.dumps({"reason": "r", "action": {"name": "x", "query": 5}})),
        ("nomatch", "p1", resp("zebra")),
        ("found_rel", "p1", resp("graph")),
        ("found_cit", "p1", resp("graph", "search_citation_count")),
        ("absent", "p3", resp("graph", reason=None)),
    ]
    df = spark.createDataFrame(rows, "key string, paperId string, response string")
    out = {r.key: r.reward for r in sc.query_rewards(idx, sc.parse_queries(df), key="key").collect()}
    assert out["invalid"] == -1.0 and out["noreason"] == -1.0 and out["nonstr"] == -1.0
    assert out["blank"] == -0.3 and out["multiline"] == -0.3 and out["digits"] == -0.3
    assert out["nomatch"] == 0.1
    # "graph" matches p1 and p2 (total 2); relevance order puts p2 (shorter doc) first
    assert math.isclose(out["found_rel"], round(10 / math.sqrt(2) + 1 / 2, 6))
    assert math.isclose(out["found_cit"], round(10 / math.sqrt(2) + 1 / 2, 6))   # p2 has more citations
    assert math.isclose(out["absent"], round(1 / math.log(3) + 0.3, 6))


def test_selection_reward_ladder(spark):
    ok = {"reason": "r", "action": {"name": "select_paper", "paper_id": "12"}}
    rows = [
        ("right_ref_right", json.dumps(ok), json.dumps({"action": {"paper_id": "12"}}), 2, "correct"),
        ("right_ref_wrong", json.dumps(ok), json.dumps({"action": {"paper_id": "13"}}), 2, "incorrect"),
        ("right_ref_invalid", json.dumps(ok), "nope", 2, "invalid"),
        ("wrong", json.dumps({"reason": "r", "action": {"name": "select_paper", "paper_id": "1"}}), "", -1, None),
        ("numeric", json.dumps({"reason": "r", "action": {"name": "select_paper", "paper_id": 12}}), "", -1, None),
        ("bad_name", json.dumps({"reason": "r", "action": {"name": "search", "paper_id": "12"}}), "", -2, None),
        ("no_reason", json.dumps({"action": {"name": "select_paper", "paper_id": "12"}}), "", -2, None),
        ("trailing", json.dumps(ok) + "x", "", -2, None),
        ("null_reason", json.dumps({"reason": None, "action": {"name": "select_paper", "paper_id": "12"}}),
         "nope", 2, "invalid"),
    ]
    df = spark.createDataFrame([(c, "12", a, b) for c, a, b, _, _ in rows],
                               "case string, paperId string, response string, ref_response string")
    out = {r.case: (r.reward, r.ref_status) for r in sc.selection_rewards(df).collect()}
    for c, _, _, reward, status in rows:
        assert out[c] == (reward, status), c
