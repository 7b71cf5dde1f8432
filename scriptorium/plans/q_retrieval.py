"""Registered queries: k-NN retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators.knn import knn_join
from scriptorium.operators.prompts import GUESS_SUFFIX, NO_PAPERS, numbered_titles_message
from scriptorium.plans.registry import register
from scriptorium.plans.sql_views import sql_str, with_views
from scriptorium.sources import tables as tb

_KNN_SQL = """
SELECT query_id, neighbor_id, distance, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
         round({fn}(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 5) AS distance,
         row_number() OVER (PARTITION BY q.vec_id
                            ORDER BY round({fn}(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 5), c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id) t
WHERE rank <= 3"""


def _knn_all(spark, sf_dir, metric):
    e = tb.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    r = knn_join(e, e, 3, query_id="vec_id", query_vec="embedding", corpus_id="vec_id",
                 corpus_vec="embedding", metric=metric, exclude_self=True)
    return r.select(F.col("qid").alias("query_id"), F.col("id").alias("neighbor_id"), "distance", "rank")


@register("knn_l2_topk", _KNN_SQL.format(fn="list_distance"))
def knn_l2_topk(spark, sf_dir):
    """Every stored vector as a query: its 3 nearest other vectors (Euclidean)."""
    return _knn_all(spark, sf_dir, "l2")


@register("knn_cosine_topk", _KNN_SQL.format(fn="list_cosine_distance"))
def knn_cosine_topk(spark, sf_dir):
    """Same, cosine distance (metric passed explicitly)."""
    return _knn_all(spark, sf_dir, "cosine")


def retrieve_titles(spark, sf_dir, k=3):
    """Benchmark passages -> k nearest indexed papers -> numbered title message.

    The passage's stored vector (``vec_id = item_id``) stands for its
    embedding; the index is every paper that has a vector.
    """
    bench = tb.table(spark, sf_dir, "benchmark").select("item_id")
    vec = tb.paper_vectors(spark, sf_dir)
    q = bench.join(vec.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    index = tb.vector_index(spark, sf_dir)
    hits = knn_join(q, index, k, query_id="item_id", query_vec="embedding",
                    corpus_id="vec_id", corpus_vec="embedding")
    titled = (hits.join(index.select(F.col("vec_id").alias("id"), "title"), "id")
              .select(F.col("qid").alias("item_id"), "rank", "title"))
    return numbered_titles_message(bench, titled, key="item_id")


_RETRIEVE_SQL = with_views(["papers"], f"""
, q AS (SELECT b.item_id, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
idx AS (SELECT e.vec_id, p.title, e.embedding FROM embeddings e JOIN papers p ON p.paperId = CAST(e.vec_id AS VARCHAR)),
d AS (SELECT q.item_id, idx.vec_id, idx.title,
             round(list_distance(q.embedding::DOUBLE[], idx.embedding::DOUBLE[]), 5) AS dist FROM q, idx),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dist, vec_id) AS rk FROM d),
l AS (SELECT item_id, string_agg(CAST(rk AS VARCHAR) || '. ' || title, chr(10) ORDER BY rk) AS lst
      FROM r WHERE rk <= 3 GROUP BY item_id)
SELECT b.item_id, coalesce(l.lst, {sql_str(NO_PAPERS)}) ||
       {sql_str(GUESS_SUFFIX)} AS message
FROM benchmark b LEFT JOIN l ON l.item_id = b.item_id""").replace("\n\n, q AS", ", q AS")


@register("retrieve_title_list", _RETRIEVE_SQL)
def retrieve_title_list(spark, sf_dir):
    return retrieve_titles(spark, sf_dir)
