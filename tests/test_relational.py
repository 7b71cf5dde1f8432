"""Batching, upsert, scans, search and sources: properties against plain Python."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scriptorium.functions.draws import draw_key
from scriptorium.operators import corpus as co
from scriptorium.operators import search as se
from scriptorium.operators.batching import global_row_number, minibatches
from scriptorium.sources import csv_logs
from scriptorium.sources import tables as tb
from scriptorium.sources.materialize import materialize, run_sharded

from .conftest import SF_SMALL


def test_global_row_number_matches_sorted_order(spark):
    df = spark.range(0, 5003).withColumn("h", draw_key("s", F.col("id")))
    import scriptorium.operators.batching as b
    old = b.TARGET_ROWS_PER_BUCKET
    b.TARGET_ROWS_PER_BUCKET = 700                     # force many buckets
    try:
        rows = global_row_number(df, "h", ["id"]).collect()
    finally:
        b.TARGET_ROWS_PER_BUCKET = old
    want = {rid: i + 1 for i, (h, rid) in enumerate(sorted((r.h, r.id) for r in rows))}
    assert all(want[r.id] == r.rn for r in rows)


def test_minibatches_full_and_disjoint(spark):
    df = spark.range(0, 103).withColumn("h", draw_key("s", F.col("id")))
    assert minibatches(df, 4, "h", ["id"]).count() == 103        # the short last batch is kept by default
    rows = minibatches(df, 4, "h", ["id"], drop_last=True).collect()
    sizes = Counter(r.batch_id for r in rows)
    assert len(rows) == 100 and set(sizes.values()) == {4} and len(sizes) == 25
    assert len({r.id for r in rows}) == 100


def test_upsert_latest_wins_and_idempotent(spark):
    old = spark.createDataFrame([("ns", "a", [1.0, 2.0], 1), ("ns", "b", [1.0, 1.0], 1)],
                                "namespace string, id string, values array<float>, batch_seq long")
    new = spark.createDataFrame([("ns", "a", [3.0, 4.0], 2)], "namespace string, id string, values array<float>, batch_seq long")
    once = co.upsert(old, new, dim=2)
    twice = co.upsert(once, new, dim=2)
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    assert dict((r[1], r[2]) for r in a)["a"] == [3.0, 4.0]
    bad = spark.createDataFrame([("ns", "c", [1.0], 3)], "namespace string, id string, values array<float>, batch_seq long")
    with pytest.raises(Exception):
        co.upsert(once, bad, dim=2).collect()


def test_year_forms_and_exact_cap(spark):
    p = tb.papers(spark, SF_SMALL)
    rows = co.paper_scan(p, year="2016-").select("year").collect()
    assert rows and all(r.year >= 2016 for r in rows)
    assert {r.year for r in co.paper_scan(p, year=2018).select("year").collect()} == {2018}
    assert co.harvest(p, field="en", min_citation_count=0, limit=7).count() == 7


def test_scan_pushes_filters_to_parquet(spark):
    p = co.paper_scan(tb.papers(spark, SF_SMALL), field="en", year="2016-", min_citation_count=30,
                      fields=["paperId", "title"])
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan


def _bm25_python(docs, query):
    toks = {pid: [t.lower() for t in re.split("[^A-Za-z0-9]+", text) if t] for pid, text in docs.items()}
    n = len(toks)
    avgdl = sum(len(t) for t in toks.values()) / n
    terms = set(t.lower() for t in re.split("[^A-Za-z0-9]+", query) if t)
    out = {}
    for pid, t in toks.items():
        if not terms <= set(t):
            continue
        s = 0.0
        for term in terms:
            df = sum(1 for x in toks.values() if term in x)
            tf = t.count(term)
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
        out[pid] = round(s, 6)
    return out


def test_search_matches_python_bm25(spark):
    docs = {"1": "graph neural networks for graphs", "2": "graph kernels and graph neural nets",
            "3": "neural machine translation", "4": "kernels kernels kernels graph"}
    papers = spark.createDataFrame([(k, v, None, 1) for k, v in docs.items()],
                                   "paperId string, title string, abstract string, citationCount int")
    idx = se.build_index(papers)
    for q in ["graph neural", "kernels graph", "translation", "missing term"]:
        qs = spark.createDataFrame([(1, q)], "qid int, query string")
        got = {r.paperId: r.score for r in se.matches(idx, qs).collect()}
        want = _bm25_python(docs, q)
        assert got.keys() == want.keys(), q
        for k in got:
            assert abs(got[k] - want[k]) < 2e-6


def test_passage_sources_equals_instr(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "xbeta gamma deltax"),
                                  (3, "beta gamma delta")], "doc_id long, text string")
    passages = spark.createDataFrame([(10, "beta gamma delta"), (11, "ta gamma del"), (12, "zeta eta theta")],
                                     "item_id long, text string")
    got = sorted(map(tuple, tb.passage_sources(passages, docs).collect()))
    want = sorted((p, d) for p, pt in [(10, "beta gamma delta"), (11, "ta gamma del"), (12, "zeta eta theta")]
                  for d, dt in [(1, "alpha beta gamma delta epsilon"), (2, "xbeta gamma deltax"),
                                (3, "beta gamma delta")] if pt in dt)
    assert got == want


def test_materialize_reads_through(spark, scratch):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    path = os.path.join(scratch, "cache")
    assert materialize(spark, path, build).count() == 5
    assert materialize(spark, path, build).count() == 5
    assert len(calls) == 1


def test_run_sharded_resumes_missing_shards(spark, scratch):
    """Shards whose output is there are not mapped again."""
    rows = spark.range(0, 200).withColumn("v", F.col("id") * 2)
    base = os.path.join(scratch, "sharded")
    job = lambda add: lambda df: df.withColumn("w", F.col("v") + add)
    out = run_sharded(rows, job(1), base, rows_per_shard=50, key=["id"])
    assert out.columns == ["id", "v", "w"] and sorted(r.w for r in out.collect()) == sorted(2 * i + 1 for i in range(200))
    import shutil
    os.remove(f"{base}/out/_SUCCESS")
    shutil.rmtree(f"{base}/out/shard=2")                              # as after a run that died before shard 2
    again = run_sharded(rows, job(1000), base, rows_per_shard=50, key=["id"])
    two = {r.id for r in spark.read.parquet(f"{base}/in").where("shard = 2").collect()}
    assert two and {(r.id, r.w) for r in again.collect()} == {(i, 2 * i + (1000 if i in two else 1)) for i in range(200)}


def test_csv_logs_bind_by_name(spark, scratch):
    a = spark.createDataFrame([("1", "T", "q", "line one\nline \"two\"", "r")], "paperId string, title string, "
                              "query string, excerpt string, reason string")
    csv_logs.append_log(a, os.path.join(scratch, "gold_queries_a"))
    csv_logs.append_log(a.select("reason", "excerpt", "query", "title", "paperId"),
                        os.path.join(scratch, "gold_queries_b"))
    csv_logs.append_log(a.drop("reason"), os.path.join(scratch, "gold_queries_c"))
    csv_logs.write_empty(spark, os.path.join(scratch, "gold_queries_d.csv"))
    out = csv_logs.read_logs(spark, os.path.join(scratch, "gold_queries*")).collect()
    assert len(out) == 2
    assert all(r.paperId == "1" and r.excerpt == "line one\nline \"two\"" and r.reason == "r" for r in out)


def test_top_n_equals_order_limit(spark):
    """The histogram cut against a sort, with nulls, ties, negative and far apart numbers, strings that differ in a NUL."""
    import datetime as dt
    import random

    from scriptorium.operators import batching as b
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab\0é\uffff") for _ in range(rng.randint(0, 12)))
    day = dt.date(2020, 1, 1)
    rows = [(i, rng.choice([None, -5, 0, 7, 2**62, -2**62, rng.randint(-50, 50)]), rng.choice([None, word(), "shared prefix " + word()]),
             rng.choice([None, day + dt.timedelta(days=rng.randint(-9000, 9000))]), i % 3 == 0,
             dt.datetime(1969, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=rng.randint(0, 10**9))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, num long, txt string, day date, flag boolean, ts timestamp").repartition(5).cache()
    for order in (["num", "id"], ["-num", "-id"], ["txt", "id"], ["-txt", "id"], ["day", "-id"], ["flag", "txt", "-num", "id"], ["-ts", "id"], ["-id"]):
        sort = [F.desc(k[1:]) if k[0] == "-" else F.asc(k) for k in order]
        want = [r.id for r in df.orderBy(*sort).collect()]
        for n in (0, 1, 37, 250, 499, 500, 900):
            got = b.top_n(df, n, order, edge_rows=10)
            assert sorted(r.id for r in got.collect()) == sorted(want[:n]), (order, n)
    with pytest.raises(TypeError):
        b.top_n(df.select(F.col("num").cast("double").alias("x")), 3, ["x"])


def test_top_n_sorts_one_bucket_only(spark):
    """Rows before the cut pass through a filter; the sort sees the bucket of the cut, in whatever order keys repeat."""
    from scriptorium.operators import batching as b
    df = spark.range(200_000).select((F.col("id") % 10).alias("year"), "id").repartition(8)
    got = b.top_n(df, 130_007, ["year", "id"], edge_rows=1000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "Window" not in plan and "Checkpoint" not in plan and "LogicalRDD" not in plan
    assert got.count() == 130_007 and got.where("year = 6").agg(F.count("id"), F.max("id")).head() == (10_007, 10_006 * 10 + 6)
    edge = [c for c in (got._jdf.queryExecution().optimizedPlan().children().apply(1),)]
    assert "Sort" in edge[0].toString()


def test_many_small_logs_in_one_job(spark, scratch):
    """Headers of hundreds of files by one job, odd file names, quoted headers, empty files and empty first lines."""
    from scriptorium.sources import csv_logs
    cols = csv_logs.GOLD_QUERY_COLUMNS
    os.makedirs(f"{scratch}/gold_queries_x")
    for i in range(300):
        names = cols if i % 3 else cols[::-1] if i % 2 else [*cols[:-1], "other"]
        with open(f"{scratch}/gold_queries_x/log {i} 100%41é.csv", "w") as f:
            f.write("" if i == 5 else "\n" if i == 7 else ",".join(f'"{c}"' for c in names) + "\n" + ",".join(f"{c}{i}" for c in names) + "\n")
    spark.sparkContext.setJobGroup("heads", "heads")
    heads = csv_logs.file_headers(spark, csv_logs.list_files(spark, f"{scratch}/gold_queries*"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("heads")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(heads) == 3 and sum(map(len, heads.values())) == 298 and len(jobs) <= 6
    rows = csv_logs.read_logs(spark, f"{scratch}/gold_queries*").collect()
    assert {tuple(r) for r in rows} == {tuple(f"{c}{i}" for c in cols) for i in range(300) if i not in (5, 7) and (i % 3 or i % 2)}


def test_hot_paper_is_dealt_over_tasks(spark):
    """A third of all citations on one paper: no task joins twice the median, without the adaptive join; rows as of the plain join."""
    from scriptorium.operators import excerpts as ex
    papers = spark.range(200).select(F.col("id").cast("string").alias("paperId"), F.concat(F.lit("t"), F.col("id")).alias("title"))
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 200).cast("string")
    cites = spark.range(30_000).select(F.col("id").alias("seq"), key.alias("citedPaperId"), F.col("id").cast("string").alias("citingPaper"), F.array(F.lit("x")).alias("contexts"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = ex.citation_excerpts(papers, cites, hot_rows=100)
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 30_000 and sizes[-1] < 2 * sizes[len(sizes) // 2]
        plain = cites.join(papers, cites.citedPaperId == papers.paperId).select("seq", "title")
        assert got.select("seq", "paper.title").exceptAll(plain).isEmpty()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
