"""Composite jobs end to end on the smallest tables, with stub models."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import scoring as sc
from scriptorium.plans import jobs, stubs
from scriptorium.plans.q_search import paper_index
from scriptorium.sources import tables as tb
from scriptorium.sources.vector_store import read_records
from scriptorium.streaming.scoring import start_gold_log

from .conftest import SF_SMALL


def test_vector_index_build_write_and_reupsert(spark, scratch):
    p, v = tb.papers(spark, SF_SMALL), tb.paper_vectors(spark, SF_SMALL)
    path = os.path.join(scratch, "index")
    first = jobs.build_vector_index(p, v, model="m", batch_seq=1, dim=64, index_path=path)
    n = first.count()
    again = jobs.build_vector_index(p, v, model="m", batch_seq=2, existing=first, dim=64)
    assert again.count() == n and {r[0] for r in again.select("batch_seq").distinct().collect()} == {2}
    assert read_records(spark, path).where(F.col("namespace") == "semanticscholar-metadata").count() == n


def test_retrieve_for_excerpts_with_stub_models(spark):
    p, v = tb.papers(spark, SF_SMALL), tb.paper_vectors(spark, SF_SMALL)
    index = jobs.build_vector_index(p, v, model="m", batch_seq=1)
    ex = tb.eval_set(spark, SF_SMALL)
    out = jobs.retrieve_for_excerpts(ex, index, make_chat_model=stubs.make_query_writer,
                                     make_query_embedder=stubs.make_letter_embedder, k=3).collect()
    assert len(out) == ex.count()
    for r in out:
        assert r.search_query == " ".join(r.excerpt.split(" ")[:3])
        assert r.message.endswith("Now just reply with your guessed cited paper title")
        assert r.answer == r.message.split("\n")[0] and r.answer.startswith("1. ")


def test_attributable_excerpts_sharded(spark, scratch):
    t = jobs.build_citation_excerpts(tb.papers(spark, SF_SMALL), tb.citations(spark, SF_SMALL), field="en")
    out = jobs.attributable_excerpts(t, make_verdict_model=stubs.make_verdict_model,
                                     base_path=os.path.join(scratch, "verdicts"), rows_per_shard=100)
    rows = out.collect()
    assert rows and all(r.eval.startswith(" YES") for r in rows)


def test_shards_run_at_once_and_only_missing_ones_again(spark, scratch):
    """One job maps all shards; one that fails leaves the finished shards, and the next run maps the others only."""
    from scriptorium.sources.materialize import run_sharded
    rows = spark.range(1000).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    seen = spark.sparkContext.accumulator(0)

    def job(bad):
        def task(batches):
            for b in batches:
                seen.add(b.num_rows)
                ids = b.column(0).to_pylist()
                if bad is not None and bad in ids:
                    import time
                    time.sleep(6)      # the others finish meanwhile
                    raise RuntimeError("lost")
                yield b
        return lambda part: part.mapInArrow(task, part.schema)
    base = os.path.join(scratch, "shards")
    with pytest.raises(Exception, match="lost"):
        run_sharded(rows, job(17), base, rows_per_shard=100, key=["id"]).count()
    done = {int(d.split("=")[1]) for d in os.listdir(f"{base}/out") if d.startswith("shard=")}
    first = seen.value        # a failed task's rows are not counted
    kept = spark.read.parquet(f"{base}/in").where(F.col("shard").isin(sorted(done))).count()
    assert len(done) >= 5 and kept == first < 1000 and not os.path.exists(f"{base}/out/_SUCCESS")
    out = run_sharded(rows, job(None), base, rows_per_shard=100, key=["id"])
    assert sorted(r.id for r in out.collect()) == list(range(1000)) and seen.value == 1000
    again = seen.value
    assert run_sharded(rows, job(None), base, rows_per_shard=100, key=["id"]).count() == 1000 and seen.value == again
    with pytest.raises(ValueError, match="shard"):
        run_sharded(rows, lambda part: part.drop("shard"), base, rows_per_shard=100)
    assert run_sharded(rows.limit(0), job(None), f"{base}0", rows_per_shard=100).count() == 0


def test_rank_gold_logs_and_supervised_text(spark, scratch):
    from scriptorium.sources import csv_logs
    gold = tb.gold(spark, SF_SMALL).select("paperId", "title", "query", "excerpt", "reason")
    csv_logs.append_log(gold, os.path.join(scratch, "gold_queries_1"))
    idx = paper_index(spark, SF_SMALL)
    ranked = jobs.rank_gold_logs(spark, os.path.join(scratch, "gold_queries*"), idx)
    assert ranked.count() == gold.count()
    q = jobs.supervised_query_text(ranked).collect()
    assert all(r.text.startswith("<|user|>\nBelow is an instruction") and "### Output:\n{" in r.text for r in q)
    prompts = jobs.selection_prompts(ranked, seed="1", key="qid").collect()
    for r in prompts:
        assert [c.paperId for c in r.candidates].count(r.paperId) == 1 and 2 <= r.k <= 5


def test_title_context_prompts(spark):
    idx = paper_index(spark, SF_SMALL)
    p = tb.papers(spark, SF_SMALL)
    titles = p.where(F.col("seq") < 3).select(F.col("seq").alias("item_id"), F.lit(1).alias("rank"), "title")
    queries = titles.select("item_id", F.lit("q").alias("query"))
    out = jobs.title_context_prompts(titles, queries, idx, tb.arxiv_entries(spark, SF_SMALL)).collect()
    for r in out:
        assert r.prompt.startswith("What is the paper q citations, based on the next papers and citations: Title: ")
        assert "citations: " in r.prompt           # a paper's own title finds at least itself


def test_jobs_without_a_cap_cut_nothing(spark):
    """A job's cap is required or, where it may be left out, the whole result set is used."""
    import inspect

    from scriptorium.operators import search as se
    for job, cap in ((jobs.sample_training_pairs, "cap_per_paper"), (jobs.rank_queries, "limit")):
        assert inspect.signature(job).parameters[cap].default is inspect.Parameter.empty
    for job, cap in ((jobs.rank_gold_logs, "limit"), (jobs.title_context_prompts, "per_title")):
        assert inspect.signature(job).parameters[cap].default is None
    idx = paper_index(spark, SF_SMALL)
    word = tb.papers(spark, SF_SMALL).select(F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").head()["w"]
    gold = spark.createDataFrame([("0", word)], "qid string, query string")
    whole, page = (jobs.rank_queries(gold.withColumn("paperId", F.lit("x")), idx, limit=n).head()["results"] for n in (None, 2))
    assert len(page) <= 2 and whole[:len(page)] == page and len(whole) == se.search_page(idx, gold, 1).head()["total"]


def test_streaming_gold_selection_log(spark, scratch):
    ok = json.dumps({"reason": "r", "action": {"name": "select_paper", "paper_id": "7"}})
    bad = json.dumps({"reason": "r", "action": {"name": "select_paper", "paper_id": "8"}})
    src = os.path.join(scratch, "responses")
    spark.createDataFrame([("7", "t", "e", ok, "x"), ("7", "t", "e", bad, "x")],
                          "paperId string, title string, excerpt string, response string, ref_response string") \
        .write.parquet(src)
    stream = spark.readStream.schema("paperId string, title string, excerpt string, response string, "
                                     "ref_response string").parquet(src)
    q = start_gold_log(stream, os.path.join(scratch, "gold"), os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    rows = spark.read.parquet(os.path.join(scratch, "gold")).collect()
    assert len(rows) == 1 and rows[0].ref_status == "invalid"
