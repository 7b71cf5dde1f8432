"""Limits, caches, stores and model calls at their edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import corpus as co
from scriptorium.operators import excerpts as ex
from scriptorium.operators import knn
from scriptorium.operators import models
from scriptorium.operators import search as se
from scriptorium.plans import jobs
from scriptorium.sources import csv_logs, vector_store
from scriptorium.sources import tables as tb
from scriptorium.sources.materialize import save
from tests.conftest import SF_SMALL


def _vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vec array<double>")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("scale", [1.0, 1e4, 1e6])
def test_knn_hard_vectors_and_both_plans(spark, metric, scale):
    """Near-equal long vectors, zero and NaN vectors: the same rows from both plans and brute force."""
    rng = np.random.default_rng(int(scale))
    base = rng.normal(size=24) * scale
    vecs = [(i, base + rng.normal(size=24) * 1e-3) for i in range(60)] + [(60 + i, rng.normal(size=24) * scale) for i in range(60)]
    vecs += [(200, np.zeros(24)), (201, np.full(24, np.nan))]
    queries = vecs[:5] + vecs[70:74]
    q = _vectors(spark, queries).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    c = _vectors(spark, vecs).repartition(3)
    fine = [v for v in vecs if v[0] != 201 and (metric == "l2" or v[0] != 200)]
    want = knn.knn_brute_force([i for i, _ in queries], [v for _, v in queries], [i for i, _ in fine], [v for _, v in fine], 4, metric)
    for strategy in ("broadcast", "blocked"):
        got = knn.knn_join(q, c, 4, metric=metric, strategy=strategy, block_bytes=2000).collect()
        assert sorted((r.qid, r.id, r["rank"]) for r in got) == sorted((a, b, r) for a, b, _, r in want), strategy


def test_knn_few_valid_rows_are_kept(spark):
    got = knn.knn_join(_vectors(spark, [(1, (1, 0))]).toDF("qid", "qvec"), _vectors(spark, [(1, (1, 0.1)), (2, (0, 0))]), 3, metric="cosine").collect()
    assert [r.id for r in got] == [1]


def test_doubles_are_compared_as_doubles(spark):
    q = _vectors(spark, [(1, (1e6 + 1e-5, 0))]).toDF("qid", "qvec")
    c = _vectors(spark, [(11, (1e6, 0)), (12, (1e6 + 1e-5, 0))])
    for strategy in ("broadcast", "blocked"):
        assert [r.id for r in knn.knn_join(q, c, 2, strategy=strategy).orderBy("rank").collect()] == [12, 11]


def test_short_pairs_are_uncapped(spark):
    rows = spark.range(10_500).select(F.lit("1").alias("paperId"), F.lit("t").alias("title"), F.lit("e").alias("excerpt"), F.col("id").alias("seq"), F.lit(0).alias("pos"))
    assert ex.short_pairs(rows).count() == 10_500
    assert ex.short_pairs(rows, cap=7).count() == 7


def test_titles_and_abstracts_hold_every_character(spark):
    docs = tb.documents(spark, SF_SMALL).select(F.col("doc_id").cast("string").alias("paperId"), "text")
    p = tb.papers(spark, SF_SMALL).join(docs, "paperId")
    whole = F.concat("title", F.coalesce(F.concat(F.lit("\n"), F.col("abstract")), F.lit("")))
    assert p.where(whole != F.col("text")).count() == 0


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alphabet agamma"), (3, "be")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "alpha beta gamma"), (4, "zz"), (5, "a"), (6, "")], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in tb.passage_sources(passages, docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (5, 2)}


def test_models_are_told_apart_by_identity():
    def factory(n):
        return lambda: (lambda batch: [n] * len(batch))
    assert all(models._model(factory(n))([0]) == [n] for n in range(200))


def test_encoder_runs_on_missing_rows_only(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def predict(batch):
            calls.add(len(batch))
            return [[float(len(t))] for t in batch]
        return predict
    papers = spark.createDataFrame([(str(i), "t", None) for i in range(200)], "paperId string, title string, abstract string")
    vectors = spark.createDataFrame([(str(i), [1.0]) for i in range(150)], "paperId string, embedding array<float>")
    rows = co.attach_or_embed(papers, vectors, make).collect()
    assert calls.value == 50 and sum(r.computed for r in rows) == 50 and len(rows) == 200


def test_agent_calls_its_models_once_per_turn(spark):
    chats, embeds = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make_chat():
        def predict(batch):
            chats.add(len(batch))
            return ["Query: x"] * len(batch)
        return predict

    def make_embedder():
        def predict(batch):
            embeds.add(len(batch))
            return [[1.0, 0.0]] * len(batch)
        return predict
    e = spark.createDataFrame([(i, f"excerpt {i}") for i in range(40)], "item_id long, excerpt string")
    index = spark.createDataFrame([(str(i), [float(i), 0.0], f"title {i}") for i in range(5)], "id string, values array<float>, title string")
    out = jobs.retrieve_for_excerpts(e, index, make_chat_model=make_chat, make_query_embedder=make_embedder).collect()
    assert len(out) == 40 and chats.value == 80 and embeds.value == 40


def test_corpus_cache_knows_parameters_and_files(spark, scratch):
    save(tb.papers(spark, SF_SMALL).where("seq < 150"), f"{scratch}/papers")
    read = lambda limit: jobs.build_paper_corpus(spark.read.parquet(f"{scratch}/papers"), field="en", min_citation_count=0, limit=limit, path=f"{scratch}/c").count()
    assert read(5) == 5 and read(20) == 20
    everything = read(None)
    save(tb.papers(spark, SF_SMALL), f"{scratch}/papers")
    assert read(None) > everything


def test_append_of_a_batch_repeats_safely(spark, scratch):
    rows = spark.createDataFrame([("1", "t", "q", "e", "r")], csv_logs.GOLD_QUERY_COLUMNS)
    for _ in range(2):
        csv_logs.append_log(rows, f"{scratch}/gold_queries_x", "b1")
    csv_logs.append_log(rows, f"{scratch}/gold_queries_x", "b2")
    assert csv_logs.read_logs(spark, f"{scratch}/gold_queries*").count() == 2


def test_selection_log_feeds_the_supervised_text(spark, scratch):
    """K4 -> C11: the last row of a paper in the log gives the reason."""
    rows = [("1", "t", "e", f"reason {i}", f'{{"reason": "reason {i}", "action": {{"name": "select_paper", "paper_id": "1"}}}}', "x", i) for i in (3, 9, 5)]
    df = spark.createDataFrame(rows, "paperId string, title string, excerpt string, why string, response string, ref_response string, n long")
    jobs.score_selections(df, gold_log_path=f"{scratch}/sel", seq="n", batch="b").count()
    log = jobs.gold_selection_log(spark, f"{scratch}/sel*")
    last = co.last_wins(log).collect()
    assert [r.reason for r in last] == ["reason 9"]


def test_vector_store_versions(spark, scratch):
    rec = lambda ids, seq: spark.createDataFrame([(f"p{i}", [float(seq)], "{}", "ns", seq) for i in ids], "id string, values array<float>, metadata string, namespace string, batch_seq long")
    path = f"{scratch}/index"
    assert vector_store.upsert_records(spark, path, rec(range(100), 1), dim=1, buckets=8) == 1
    assert vector_store.upsert_records(spark, path, rec([3], 2), dim=1, buckets=8) == 2
    read = lambda: {r.id: r.batch_seq for r in vector_store.read_records(spark, path).collect()}
    assert read() == {f"p{i}": 2 if i == 3 else 1 for i in range(100)}
    folders = list(vector_store._manifest(spark, path)[1]["cells"].values())
    assert sorted(folders.count(f) for f in set(folders)) == [1, 7]      # the second batch wrote its own cell only
    bad = rec([4], 3).withColumn("values", F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")))
    with pytest.raises(Exception, match="vector width"):
        vector_store.upsert_records(spark, path, bad, dim=1, buckets=8)
    assert read()["p4"] == 1 and vector_store.upsert_records(spark, path, rec([4], 3), dim=1, buckets=8) == 3 and read()["p4"] == 3


def test_year_range_reads_only_its_folders(spark):
    p = jobs.build_paper_corpus(tb.papers_by_year(spark, SF_SMALL), field="en", min_citation_count=0)
    plan = p._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "year" in filters and "2018" in filters


def test_search_holds_no_match_list_in_a_window(spark):
    """Totals and page: a partial limit and an aggregate, no window over all matches."""
    papers = spark.createDataFrame([(str(i), i, f"w{i % 3} common", "text", i) for i in range(60)], "paperId string, seq long, title string, abstract string, citationCount int")
    idx = se.build_index(papers, doc_key="seq")
    queries = spark.createDataFrame([(1, "common"), (2, "common w1"), (3, "common")], "qid long, query string")
    page = se.search_page(idx, queries, 5)
    assert {(r.qid, r.total) for r in page.collect()} == {(1, 60), (2, 20), (3, 60)} and page.count() == 15
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert {(r.qid, r.total) for r in se.total_matches(idx, queries).collect()} == {(1, 60), (2, 20), (3, 60)}


def test_no_data_job_before_the_action(spark):
    """Planning reads the footers of the two scans and nothing else."""
    from scriptorium.plans import registry
    fn = registry.queries()["attributable_filter"]
    fn(spark, SF_SMALL)
    spark.sparkContext.setJobGroup("lazy", "lazy")
    fn(spark, SF_SMALL)
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(ids) <= 2
