"""Registered queries: paper scans, vector records, keyed upsert, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import corpus as co
from scriptorium.plans import jobs
from scriptorium.plans.registry import register
from scriptorium.plans.sql_views import META_JSON, with_views
from scriptorium.sources import tables as tb

FIELD = "en"      # the fixture's field of study standing in for 'Computer Science'
MODEL = "specter2"


@register("paper_scan_filtered", with_views(["papers"], """
SELECT paperId, citationCount, title, abstract FROM papers
WHERE fieldOfStudy = 'en' AND year >= 2016 AND citationCount >= 30"""))
def paper_scan_filtered(spark, sf_dir):
    """Field, open year range '2016-', minimum 30 citations."""
    p = tb.papers(spark, sf_dir)
    return co.paper_scan(p, field=FIELD, year="2016-", min_citation_count=30,
                         fields=["paperId", "citationCount", "title", "abstract"])


@register("paper_scan_year_shards", with_views(["papers"], """
SELECT paperId, year, citationCount, title FROM papers
WHERE fieldOfStudy = 'en' AND year BETWEEN 2018 AND 2024 AND citationCount >= 20
"""))
def paper_scan_year_shards(spark, sf_dir):
    """Years 2018..2024, min 20 citations, uncapped."""
    p = tb.papers_by_year(spark, sf_dir)
    return jobs.build_paper_corpus(p, field=FIELD, min_citation_count=20).select("paperId", "year", "citationCount", "title")


@register("eval_split_year_filter", with_views(["eval_set"], """
SELECT item_id, excerpt, split, year FROM eval_set WHERE split = 'test' AND year IN (2018, 2019)"""))
def eval_split_year_filter(spark, sf_dir):
    """split and year in (2018, 2019)."""
    e = tb.eval_set(spark, sf_dir)
    return e.where((F.col("split") == "test") & F.col("year").isin(2018, 2019))


@register("eval_first_rows", with_views(["eval_set"], """
SELECT item_id, excerpt, split, year FROM eval_set WHERE split = 'train' ORDER BY item_id LIMIT 6"""))
def eval_first_rows(spark, sf_dir):
    """The evaluation loop's first six rows of a split."""
    e = tb.eval_set(spark, sf_dir)
    return e.where(F.col("split") == "train").orderBy("item_id").limit(6)


@register("embedding_content", with_views(["papers"], """
SELECT paperId, title || CASE WHEN coalesce(length(abstract), 0) > 0 THEN ' ' || abstract ELSE '' END AS content
FROM papers"""))
def embedding_content(spark, sf_dir):
    """Title plus ' ' + abstract when present and non-empty."""
    return co.with_content(tb.papers(spark, sf_dir)).select("paperId", "content")


@register("embedding_left_join_missing", with_views(["papers"], """
SELECT p.paperId, e.embedding IS NOT NULL AS has_vector, CAST(len(e.embedding) AS INTEGER) AS dim
FROM papers p LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.paperId"""))
def embedding_left_join_missing(spark, sf_dir):
    """Every paper, its vector or null."""
    j = co.attach_vectors(tb.papers(spark, sf_dir), tb.paper_vectors(spark, sf_dir))
    return j.select("paperId", F.col("embeddings").isNotNull().alias("has_vector"),
                    F.when(F.col("embeddings").isNotNull(), F.size("embeddings")).alias("dim"))


@register("index_records", with_views(["papers"], f"""
SELECT p.paperId || '#semanticscholar-metadata#{MODEL}' AS id, CAST(len(e.embedding) AS INTEGER) AS dim,
       {META_JSON} AS metadata, 'semanticscholar-metadata' AS namespace
FROM papers p JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.paperId"""))
def index_records(spark, sf_dir):
    """Vector records, papers without a vector dropped."""
    j = co.attach_vectors(tb.papers(spark, sf_dir), tb.paper_vectors(spark, sf_dir))
    r = co.semantic_record(j, MODEL)
    return r.select("id", F.size("values").alias("dim"), "metadata", "namespace")


@register("index_records_arxiv", """
SELECT 'http://arxiv.org/abs/' || CAST(d.doc_id AS VARCHAR) || 'v1#arxiv-metadata#scibert' AS id,
       split_part(d.text, chr(10), 1) ||
         CASE WHEN instr(d.text, chr(10)) > 0 AND length(substring(d.text, instr(d.text, chr(10)) + 1)) > 0
              THEN ' ' || substring(d.text, instr(d.text, chr(10)) + 1) ELSE '' END AS content,
       CAST(len(e.embedding) AS INTEGER) AS dim,
       CAST(to_json(struct_pack(id := 'http://arxiv.org/abs/' || CAST(d.doc_id AS VARCHAR) || 'v1',
                                categories := [d.lang],
                                title := split_part(d.text, chr(10), 1))) AS VARCHAR) AS metadata
FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""")
def index_records_arxiv(spark, sf_dir):
    """arXiv-style records; the key travels with the vector
    (a join, never a positional zip)."""
    ent = tb.arxiv_entries(spark, sf_dir)
    meta = co.arxiv_metadata(ent, "seq")
    vec = tb.paper_vectors(spark, sf_dir).select(F.col("vec_id").alias("seq"), F.col("embedding").alias("embeddings"))
    j = co.with_content(meta.join(vec, "seq"))
    r = co.arxiv_record(j, extra=["content"])
    return r.select("id", "content", F.size("values").alias("dim"), "metadata")


@register("topic_scan_by_date", """
SELECT 'http://arxiv.org/abs/' || CAST(doc_id AS VARCHAR) || 'v1' AS id, lang AS category,
       split_part(text, chr(10), 1) AS title,
       CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, instr(text, chr(10)) + 1) END AS abstract
FROM documents WHERE lang = 'en'
ORDER BY make_timestamp(2015 + doc_id % 10, 1, 1 + doc_id % 28, 0, 0, 0) DESC,
         'http://arxiv.org/abs/' || CAST(doc_id AS VARCHAR) || 'v1'
LIMIT 500""")
def topic_scan_by_date(spark, sf_dir):
    """Newest 500 entries of a topic."""
    ent = tb.arxiv_entries(spark, sf_dir)
    t = co.topic_scan(ent, FIELD, 500)
    return t.select(F.col("entry_id").alias("id"), "category", "title", "abstract")


@register("row_counts", with_views(["papers", "citations"], """
SELECT 'papers' AS table_name, count(*) AS n_rows FROM papers
UNION ALL SELECT 'citations', count(*) FROM citations
UNION ALL SELECT 'excerpts', CAST(sum(len(contexts)) AS BIGINT) FROM citations
UNION ALL SELECT 'vectors', count(*) FROM embeddings
UNION ALL SELECT 'index_batches', CAST(ceil(count(*) / 500.0) AS BIGINT)
          FROM papers p JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.paperId"""))
def row_counts(spark, sf_dir):
    """Dataset sizes and the 500-row upsert batch count, as aggregates."""
    p = tb.papers(spark, sf_dir)
    c = tb.citations(spark, sf_dir)
    v = tb.paper_vectors(spark, sf_dir)
    idx = p.join(v, "paperId")
    parts = [
        p.agg(F.count(F.lit(1)).alias("n")).select(F.lit("papers").alias("table_name"), F.col("n").alias("n_rows")),
        c.agg(F.count(F.lit(1)).alias("n")).select(F.lit("citations"), "n"),
        c.agg(F.sum(F.size("contexts")).cast("long").alias("n")).select(F.lit("excerpts"), "n"),
        v.agg(F.count(F.lit(1)).alias("n")).select(F.lit("vectors"), "n"),
        idx.agg(F.ceil(F.count(F.lit(1)) / 500).cast("long").alias("n")).select(F.lit("index_batches"), "n"),
    ]
    out = parts[0]
    for q in parts[1:]:
        out = out.union(q)
    return out


@register("index_upsert_latest", with_views(["papers"], f"""
, recs AS (
  SELECT p.paperId || '#semanticscholar-metadata#{MODEL}' AS id, 'semanticscholar-metadata' AS namespace,
         1 AS batch_seq, {META_JSON} AS metadata
  FROM papers p JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.paperId
  UNION ALL
  SELECT p.paperId || '#semanticscholar-metadata#{MODEL}', 'semanticscholar-metadata', 2,
         {META_JSON.replace("citationCount := citationCount", "citationCount := citationCount + 1000")}
  FROM papers p JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.paperId WHERE p.year >= 2020)
SELECT namespace, id, CAST(batch_seq AS BIGINT) AS batch_seq, metadata FROM (
  SELECT *, row_number() OVER (PARTITION BY namespace, id ORDER BY batch_seq DESC) AS rn FROM recs) t
WHERE rn = 1""").replace(")\n\n, recs AS", "),\nrecs AS"))
def index_upsert_latest(spark, sf_dir):
    """K2 A4: re-upserting papers from 2020 on with new counts; latest batch wins."""
    p = tb.papers(spark, sf_dir)
    j = co.attach_vectors(p, tb.paper_vectors(spark, sf_dir))
    existing = co.semantic_record(j, MODEL).withColumn("batch_seq", F.lit(1).cast("long"))
    changed = j.where(F.col("year") >= 2020).withColumn("citationCount", F.col("citationCount") + 1000)
    incoming = co.semantic_record(changed, MODEL).withColumn("batch_seq", F.lit(2).cast("long"))
    merged = co.upsert(existing, incoming, dim=64)
    return merged.select("namespace", "id", "batch_seq", "metadata")
