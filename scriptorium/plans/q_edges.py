"""Registered queries of the sinks and edge rules: the gold-selection log and the vector table read back, the error row
of a ranking, generated rows, URL quoting, date stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions.text import record_id, run_stamp, url_quote
from scriptorium.operators import ranking as rk
from scriptorium.operators import search as se
from scriptorium.plans import jobs
from scriptorium.plans.q_scoring import _SEL_REWARD, _sel_sql, selection_responses
from scriptorium.plans.q_search import RANKED_CTES, _GOLD_Q, gold_queries, paper_index, search_sql
from scriptorium.plans.registry import register
from scriptorium.plans.sql_views import META_JSON, with_views
from scriptorium.session import checkpoint_dir
from scriptorium.sources import tables as tb
from scriptorium.sources import vector_store
from scriptorium.sources.materialize import cache_key, source_fingerprint

MODEL = "specter2_base"
YEARS = range(2018, 2025)


def _folder(spark, sf_dir, name: str, *tables: str) -> str:
    """A folder of this input's in the cluster's checkpoint folder."""
    fp = source_fingerprint(spark, *[tb.table_path(sf_dir, t) for t in tables])
    return f"{checkpoint_dir(spark)}/{name}/{cache_key(fp=fp)}"


@register("gold_selection_log", _sel_sql(_SEL_REWARD + """
SELECT item_id AS seq, paperId, title, excerpt, sel_reason AS reason,
       CASE rc WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' ELSE 'invalid' END AS ref_status
FROM srw WHERE reward = 2"""))
def gold_selection_log(spark, sf_dir):
    """K4: the right selections appended to the CSV log (a batch written again replaces itself) and read back as C11 does."""
    path = _folder(spark, sf_dir, "gold_selection_logs", "documents", "benchmark")
    jobs.score_selections(selection_responses(spark, sf_dir), gold_log_path=f"{path}/gold_selections", seq="item_id", batch="first")
    return jobs.gold_selection_log(spark, f"{path}/gold_selections*").select("seq", "paperId", "title", "excerpt", "reason", "ref_status")


@register("index_store_read_back", with_views(["papers"], f"""
, recs AS (
  SELECT p.paperId || '#semanticscholar-metadata#{MODEL}' AS id, 1 AS batch_seq, {META_JSON} AS metadata
  FROM papers p JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.paperId
  UNION ALL
  SELECT p.paperId || '#semanticscholar-metadata#{MODEL}', 2,
         {META_JSON.replace("citationCount := citationCount", "citationCount := citationCount + 1000")}
  FROM papers p JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.paperId WHERE p.year >= 2020)
SELECT 'semanticscholar-metadata' AS namespace, id, CAST(max(batch_seq) AS BIGINT) AS batch_seq, max_by(metadata, batch_seq) AS metadata
FROM recs GROUP BY id""").replace(")\n\n, recs AS", "),\nrecs AS"))
def index_store_read_back(spark, sf_dir):
    """Two batches built and upserted into the versioned vector table on disk, then its newest version."""
    path = _folder(spark, sf_dir, "vector_store", "documents", "embeddings")
    papers, vectors = tb.papers(spark, sf_dir), tb.paper_vectors(spark, sf_dir)
    jobs.build_vector_index(papers, vectors, model=MODEL, batch_seq=1, dim=64, index_path=path)
    changed = papers.where(F.col("year") >= 2020).withColumn("citationCount", F.col("citationCount") + 1000)
    out = jobs.build_vector_index(changed, vectors, model=MODEL, batch_seq=2, dim=64, index_path=path)
    vector_store.vacuum(spark, path, older_than_hours=24)
    return out.select("namespace", "id", "batch_seq", "metadata")


@register("rank_queries_sentinel", search_sql(_GOLD_Q, RANKED_CTES + """,
bad AS (SELECT qid, count(*) > 1 AND bool_or(CAST(paperId AS BIGINT) % 10 = 3) AS failed,
               max(CASE WHEN CAST(paperId AS BIGINT) % 10 = 3 THEN 1 ELSE 0 END) AS lone FROM page GROUP BY qid)
SELECT r.item_id, CASE WHEN failed THEN 100 ELSE relevance_rank END AS relevance_rank,
       CASE WHEN failed THEN 100 ELSE citation_rank END AS citation_rank,
       CASE WHEN failed THEN -1 WHEN lone = 1 AND citation_rank = 0 THEN NULL ELSE citations END AS citations,
       CASE WHEN failed THEN 0 ELSE n_results END AS n_results
FROM ranked r LEFT JOIN bad b ON b.qid = r.item_id"""))
def rank_queries_sentinel(spark, sf_dir):
    """Papers without a citation count among several results give the error row 100, 100, -1, []."""
    gold, idx = gold_queries(spark, sf_dir), paper_index(spark, sf_dir)
    page = se.search_ranked(idx, gold.select(F.col("item_id").alias("qid"), "query"), 30)
    page = page.withColumn("citationCount", F.when(F.col("paperId").cast("long") % 10 != 3, F.col("citationCount")))
    r = rk.ranked(gold.join(se.results_array(page).withColumnRenamed("qid", "item_id"), "item_id", "left"))
    return r.select("item_id", "relevance_rank", "citation_rank", "citations", F.size("results").alias("n_results"))


@register("generated_year_rows", with_views(["papers"], f"""
SELECT y.year, 'shard-' || CAST(y.year AS VARCHAR) AS name, count(p.paperId) AS n_papers
FROM (SELECT CAST(unnest([{", ".join(map(str, YEARS))}]) AS INTEGER) AS year) y LEFT JOIN papers p ON p.year = y.year GROUP BY ALL"""))
def generated_year_rows(spark, sf_dir):
    """Rows from a generator become a table (one a harvest shard), joined with the papers of their year."""
    shards = spark.createDataFrame(((y, f"shard-{y}") for y in YEARS), "year int, name string")
    counts = tb.papers(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return shards.join(counts, "year", "left").select("year", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n_papers"))


@register("quoted_titles", with_views(["papers"], """
SELECT paperId, replace(url_encode(title), '%2F', '/') AS quoted FROM papers"""))
def quoted_titles(spark, sf_dir):
    """Whole titles quoted for a URL, slashes kept."""
    return tb.papers(spark, sf_dir).select("paperId", url_quote(F.col("title")).alias("quoted"))


@register("dated_index_names", f"""
SELECT 'http://arxiv.org/abs/' || CAST(doc_id AS VARCHAR) || 'v1' AS entry_id,
       'semanticscholar-index-{MODEL}-' || strftime(make_timestamp(2015 + doc_id % 10, 1, 1 + doc_id % 28, 0, 0, 0), '%m-%d-%Y') AS index_name,
       strftime(make_timestamp(2015 + doc_id % 10, 1, 1 + doc_id % 28, 0, 0, 0), '%Y%m%d_%H%M%S') AS run_name
FROM documents""")
def dated_index_names(spark, sf_dir):
    """The two date stamps, of each entry's publication."""
    e, at = tb.arxiv_entries(spark, sf_dir), F.col("published")
    name = F.concat(F.lit(f"semanticscholar-index-{MODEL}-"), run_stamp("MM-dd-yyyy", at))
    return e.select("entry_id", name.alias("index_name"), run_stamp(at=at).alias("run_name"))
