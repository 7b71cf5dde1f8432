"""Registered queries: citation excerpts, verdicts, training pairs, minibatches."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions.draws import draw_key
from scriptorium.operators import excerpts as ex
from scriptorium.operators.batching import minibatches
from scriptorium.operators.prompts import (
    ATTRIBUTION_ANSWER_PREFIX, ATTRIBUTION_EXCERPTS, ATTRIBUTION_INSTRUCTION, ATTRIBUTION_TITLE, attribution_prompt,
)
from scriptorium.plans import jobs, stubs
from scriptorium.plans.registry import register
from scriptorium.plans.sql_views import sql_str, with_views
from scriptorium.session import checkpoint_dir
from scriptorium.sources import tables as tb
from scriptorium.sources.materialize import cache_key, source_fingerprint

FIELD = "en"
SEED = "42"
ROWS_PER_SHARD = 1000


def excerpt_table(spark, sf_dir):
    """Papers (field, 2016-, >= 30 citations) JOIN citations; the papers without their abstracts, which no query reads."""
    return jobs.build_citation_excerpts(tb.papers(spark, sf_dir).drop("abstract"), tb.citations(spark, sf_dir), field=FIELD)


def excerpt_rows(spark, sf_dir):
    """G1: one row per (cited paper, citing paper, excerpt)."""
    e = ex.explode_excerpts(excerpt_table(spark, sf_dir))
    return e.select(F.col("paper.paperId").alias("paperId"), F.col("paper.title").alias("title"),
                    F.col("citingPaper.paperId").alias("citingPaperId"), "seq", "pos", "excerpt")


def verdicts(spark, sf_dir, make_fn=stubs.make_verdict_model):
    """C6 core: attribution prompt per excerpt, then the injected verdict model (M4)."""
    return jobs.excerpt_verdicts(tb.spread(excerpt_rows(spark, sf_dir)), make_fn)


_EX_CTES = """
cp AS (SELECT * FROM papers WHERE fieldOfStudy = 'en' AND year >= 2016 AND citationCount >= 30),
ex AS (SELECT c.seq, c.citedPaperId AS paperId, c.citingPaperId, c.citingTitle,
              unnest(c.contexts) AS excerpt, unnest(generate_series(1, len(c.contexts))) AS pos
       FROM citations c WHERE c.citedPaperId IN (SELECT paperId FROM cp)),
exs AS (SELECT ex.*, cp.title FROM ex JOIN cp ON cp.paperId = ex.paperId)"""

_USER_FIXED = len(ATTRIBUTION_INSTRUCTION) + len(ATTRIBUTION_TITLE) + len(ATTRIBUTION_EXCERPTS) + 1
_VERDICT_SQL = (f"CASE WHEN ({_USER_FIXED} + length(title) + length(excerpt)) % 3 <> 0 "
                "THEN ' YES, attributable' ELSE ' NO, not attributable' END")


def _ex_sql(body: str) -> str:
    return with_views(["papers", "citations"], "", []).rstrip("\n") + "," + _EX_CTES + "\n" + body


@register("citation_excerpt_rows", with_views(["papers", "citations"], """
SELECT p.paperId, p.title, c.citingPaperId, c.citingTitle, c.seq, CAST(len(c.contexts) AS INTEGER) AS n_excerpts
FROM citations c JOIN papers p ON p.paperId = c.citedPaperId
WHERE p.fieldOfStudy = 'en' AND p.year >= 2016 AND p.citationCount >= 30"""))
def citation_excerpt_rows(spark, sf_dir):
    """{paper, citingPaper, excerpts} per citation edge."""
    t = excerpt_table(spark, sf_dir)
    return t.select(F.col("paper.paperId").alias("paperId"), F.col("paper.title").alias("title"),
                    F.col("citingPaper.paperId").alias("citingPaperId"),
                    F.col("citingPaper.title").alias("citingTitle"), "seq",
                    F.size("excerpts").alias("n_excerpts"))


@register("excerpt_explode", _ex_sql("SELECT paperId, citingPaperId, seq, pos, excerpt FROM exs"))
def excerpt_explode(spark, sf_dir):
    """G1: N citations -> M excerpt rows."""
    return excerpt_rows(spark, sf_dir).select("paperId", "citingPaperId", "seq", "pos", "excerpt")


@register("attribution_prompt", _ex_sql(f"""
SELECT paperId, seq, pos,
       {sql_str(ATTRIBUTION_INSTRUCTION)} || {sql_str(ATTRIBUTION_TITLE)} || title || {sql_str(ATTRIBUTION_EXCERPTS)}
         || excerpt || chr(10) AS user_content,
       {sql_str(ATTRIBUTION_ANSWER_PREFIX)} AS assistant_content,
       excerpt
FROM exs"""))
def attribution_prompt_q(spark, sf_dir):
    """The verdict prompt; the full excerpt stays in the row."""
    r = excerpt_rows(spark, sf_dir).withColumn("prompt", attribution_prompt(F.col("title"), F.col("excerpt")))
    return r.select("paperId", "seq", "pos", F.col("prompt")[0]["content"].alias("user_content"),
                    F.col("prompt")[1]["content"].alias("assistant_content"), "excerpt")


@register("attributable_filter", _ex_sql(f"""
SELECT paperId, title, seq, pos, excerpt, {_VERDICT_SQL} AS eval FROM exs
WHERE starts_with({_VERDICT_SQL}, ' YES')"""))
def attributable_filter(spark, sf_dir):
    """M4 (stub model) F5 R7: keep excerpts whose verdict starts with ' YES'."""
    v = verdicts(spark, sf_dir)
    return ex.attributable(v).select("paperId", "title", "seq", "pos", "excerpt", "eval")


def _verdict_base(spark, sf_dir) -> str:
    fp = source_fingerprint(spark, tb.table_path(sf_dir, "documents"))
    return f"{checkpoint_dir(spark)}/verdict_shards/{cache_key(fp=fp, model='verdict-stub-v1', rows=ROWS_PER_SHARD)}"


@register("sharded_verdict_union", _ex_sql(f"SELECT paperId, seq, pos, {_VERDICT_SQL} AS eval FROM exs"))
def sharded_verdict_union(spark, sf_dir):
    """Verdicts computed per hash shard in one job, each shard's output a checkpoint of its own (only missing
    shards run on a re-run), then read back as one table."""
    v = jobs.sharded_verdicts(excerpt_table(spark, sf_dir), make_verdict_model=stubs.make_verdict_model,
                              base_path=_verdict_base(spark, sf_dir), rows_per_shard=ROWS_PER_SHARD)
    return v.select("paperId", "seq", "pos", "eval")


@register("attributable_excerpts", _ex_sql(f"""
SELECT paperId, title, seq, pos, excerpt, {_VERDICT_SQL} AS eval FROM exs
WHERE starts_with({_VERDICT_SQL}, ' YES')"""))
def attributable_excerpts(spark, sf_dir):
    """C6 as a whole: excerpts, sharded verdicts, the ' YES' filter."""
    v = jobs.attributable_excerpts(excerpt_table(spark, sf_dir), make_verdict_model=stubs.make_verdict_model,
                                   base_path=_verdict_base(spark, sf_dir), rows_per_shard=ROWS_PER_SHARD)
    return v.select("paperId", "title", "seq", "pos", "excerpt", "eval")


def training_pairs(spark, sf_dir, num_excerpts):
    return jobs.sample_training_pairs(tb.papers(spark, sf_dir), tb.citations(spark, sf_dir), field=FIELD, seed=SEED,
                                      num_excerpts=num_excerpts, cap_per_paper=5)


@register("training_pairs_capped", with_views(["papers", "citations"], f"""
, cp AS (SELECT paperId, title, md5('{SEED}|' || paperId) AS draw FROM papers
         WHERE fieldOfStudy = 'en' AND year >= 2016 AND citationCount >= 20),
c5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY citedPaperId ORDER BY seq) AS rn FROM citations) t
       WHERE rn <= 5),
x AS (SELECT cp.paperId, cp.title, cp.draw, c5.seq, unnest(c5.contexts) AS excerpt,
             unnest(generate_series(0, len(c5.contexts) - 1)) AS pos
      FROM c5 JOIN cp ON cp.paperId = c5.citedPaperId)
SELECT paperId AS cited_paperId, title AS cited_title, excerpt, seq, pos FROM x
ORDER BY draw, seq, pos LIMIT 160""").replace(")\n\n, cp AS", "),\ncp AS"))
def training_pairs_capped(spark, sf_dir):
    """Shuffled papers, first 5 citations each, 160 excerpts."""
    t = training_pairs(spark, sf_dir, num_excerpts=160)
    return t.select(F.col("cited.paperId").alias("cited_paperId"), F.col("cited.title").alias("cited_title"),
                    "excerpt", "seq", "pos")


def short_training_rows(spark, sf_dir):
    return jobs.training_rows_from_attributable(ex.attributable(verdicts(spark, sf_dir)))


_SHORT_SQL = f"""
SELECT paperId AS cited_paperId, title AS cited_title, excerpt, seq, pos FROM exs
WHERE starts_with({_VERDICT_SQL}, ' YES') AND length(excerpt || title) < 350"""


@register("training_pairs_short", _ex_sql(_SHORT_SQL))
def training_pairs_short(spark, sf_dir):
    """Attributable excerpts shorter than 350 with the title, all of them."""
    s = short_training_rows(spark, sf_dir)
    return s.select(F.col("cited.paperId").alias("cited_paperId"), F.col("cited.title").alias("cited_title"),
                    "excerpt", "seq", "pos")


@register("minibatches_drop_last", _ex_sql(f"""
, s AS ({_SHORT_SQL}),
n AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || CAST(seq AS VARCHAR) || '|' || CAST(pos AS VARCHAR)),
                                             seq, pos) AS rn FROM s)
SELECT seq, pos, CAST((rn - 1) // 4 AS BIGINT) AS batch_id FROM n
WHERE rn <= (SELECT (count(*) // 4) * 4 FROM s)""").replace("\n\n, s AS", ",\ns AS"))
def minibatches_drop_last(spark, sf_dir):
    """Seeded shuffle, batches of 4, the short last batch dropped."""
    s = short_training_rows(spark, sf_dir).withColumn("draw", draw_key(SEED, F.col("seq"), F.col("pos")))
    b = minibatches(s, 4, "draw", ["seq", "pos"], drop_last=True)
    return b.select("seq", "pos", "batch_id")
