"""Registered queries: chat text, citation strings, title context, the
retrieval agent with stub models, embeddings, and the gold CSV source."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import chat
from scriptorium.functions.text import citation_string as cite, latex_to_text, py_strip, remove_prefix
from scriptorium.operators import corpus as co
from scriptorium.operators import prompts as pr
from scriptorium.operators.knn import knn_join
from scriptorium.operators.models import embed, generate
from scriptorium.plans import jobs, stubs
from scriptorium.plans.q_search import SEARCH_CTES, paper_index
from scriptorium.plans.registry import register
from scriptorium.plans.sql_views import sql_str, with_views
from scriptorium.session import checkpoint_dir
from scriptorium.sources import csv_logs
from scriptorium.sources import tables as tb
from scriptorium.sources.materialize import cache_key, is_complete, source_fingerprint

_RENDER_ONE = "'<|' || {role} || '|>' || chr(10) || {content} || '<|end|>' || chr(10)"


@register("chat_roles", f"""
SELECT conv_id, CAST(count(*) + 1 AS INTEGER) AS n_messages,
       {_RENDER_ONE.format(role="'system'", content=sql_str(chat.SYSTEM_MESSAGE))} ||
       string_agg({_RENDER_ONE.format(role="CASE WHEN rn % 2 = 1 THEN 'user' ELSE 'assistant' END", content="text")},
                  '' ORDER BY turn) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) t
GROUP BY conv_id""")
def chat_roles(spark, sf_dir):
    """System message first, then user / assistant by position, rendered.

    One row per conversation: the turns of a conversation are one chat, so
    they are gathered per conversation (bounded by the chat length)."""
    c = tb.table(spark, sf_dir, "conversations")
    turns = (c.groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")))
    msgs = chat.alternate_roles(F.transform("t", lambda x: x["text"]))
    return turns.select("conv_id", F.size(msgs).alias("n_messages"), chat.render(msgs).alias("text"))


def _latex_sql(c: str) -> str:
    s = f"regexp_replace({c}, '\\\\[a-zA-Z]+\\*?\\s*\\{{([^{{}}]*)\\}}', '\\1', 'g')"
    s = f"regexp_replace({s}, '\\\\([%&$#_{{}}])', '\\1', 'g')"
    s = f"regexp_replace({s}, '\\\\[a-zA-Z]+\\*?', '', 'g')"
    s = f"regexp_replace({s}, '[{{}}$]', '', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


_ENTRY_SQL = """
SELECT doc_id AS seq, CAST(doc_id AS VARCHAR) AS paperId,
       split_part(text, chr(10), 1) AS title,
       source || ', ' || upper(lang) AS author_names,
       2015 + doc_id % 10 AS year,
       CAST(doc_id AS VARCHAR) || 'v1' AS short_id,
       'http://arxiv.org/abs/' || CAST(doc_id AS VARCHAR) || 'v1' AS entry_id
FROM documents"""

_CITE_SQL = ("author_names || '. (' || CAST(year AS VARCHAR) || '). ' || plain || '. arXiv:' || short_id || "
             "'. Retrieved from ' || entry_id")


@register("citation_string", f"""
WITH ent AS ({_ENTRY_SQL}), pl AS (SELECT *, {_latex_sql('title')} AS plain FROM ent)
SELECT short_id, plain AS title, {_CITE_SQL} AS citation FROM pl""")
def citation_string(spark, sf_dir):
    """Plain-text title and the formatted citation per entry."""
    e = tb.arxiv_entries(spark, sf_dir).withColumn("plain", latex_to_text(F.col("title")))
    return e.select("short_id", F.col("plain").alias("title"),
                    cite(F.col("plain"), F.col("authors"), F.col("published"), F.col("short_id"),
                         F.col("entry_id")).alias("citation"))


# --------------------------------------------------------------------------- title context

_KNN_TITLES = with_views(["papers"], "").rstrip("\n") + """,
q AS (SELECT b.item_id, b.text, e.embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
idx AS (SELECT e.vec_id, p.title, e.embedding FROM embeddings e JOIN papers p ON p.paperId = CAST(e.vec_id AS VARCHAR)),
d AS (SELECT q.item_id, idx.vec_id, idx.title,
             round(list_distance(q.embedding::DOUBLE[], idx.embedding::DOUBLE[]), 5) AS dist FROM q, idx),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dist, vec_id) AS rk FROM d) t
      WHERE rk <= 3),"""


@register("title_context", _KNN_TITLES + f"""
qsrc AS (SELECT item_id * 10 + rk AS qid, title AS query FROM r),""" + SEARCH_CTES + f""",
ent AS ({_ENTRY_SQL}),
cites AS (SELECT rel.qid, rel.pos, pl.plain, {_CITE_SQL} AS citation
          FROM rel JOIN (SELECT *, {_latex_sql('title')} AS plain FROM ent) pl ON pl.paperId = rel.paperId
          WHERE rel.pos <= 10),
blocks AS (SELECT r.item_id, r.rk, {sql_str(pr.CONTEXT_TITLE)} || r.title || chr(10) ||
                  coalesce((SELECT string_agg({sql_str(pr.CONTEXT_CITATION)} || c.plain || ', ' || c.citation || chr(10) || chr(10),
                                              '' ORDER BY c.pos) FROM cites c WHERE c.qid = r.item_id * 10 + r.rk), '')
                  AS block FROM r),
ctx AS (SELECT item_id, string_agg(block, '' ORDER BY rk) AS context FROM blocks GROUP BY item_id)
SELECT b.item_id, {sql_str(pr.CONTEXT_QUESTION.split('{query}')[0])} ||
       array_to_string(string_split(b.text, ' ')[1:3], ' ') ||
       {sql_str(pr.CONTEXT_QUESTION.split('{query}')[1].split('{context}')[0])} || coalesce(c.context, '') ||
       {sql_str(pr.CONTEXT_QUESTION.split('{context}')[1])} AS prompt
FROM benchmark b LEFT JOIN ctx c ON c.item_id = b.item_id""")
def title_context(spark, sf_dir):
    """Retrieved titles -> title search (10 per title) -> citation
    strings -> ``Title:``/``citations:`` blocks in order -> context prompt."""
    bench = tb.table(spark, sf_dir, "benchmark").select("item_id", "text")
    vec = tb.paper_vectors(spark, sf_dir)
    q = bench.join(vec.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id")
    index = tb.vector_index(spark, sf_dir)
    hits = knn_join(q, index, 3, query_id="item_id", query_vec="embedding", corpus_id="vec_id",
                    corpus_vec="embedding")
    titled = (hits.join(index.select(F.col("vec_id").alias("id"), "title"), "id")
              .select(F.col("qid").alias("item_id"), "rank", "title"))
    asked = bench.select("item_id", tb.first_words(F.col("text")).alias("query"))
    return jobs.title_context_prompts(titled, asked, paper_index(spark, sf_dir), tb.arxiv_entries(spark, sf_dir), per_title=10) \
        .select("item_id", "prompt")


@register("excerpt_query_prompt", f"""
SELECT item_id, {sql_str(pr.SEARCH_PROMPT_HEAD)} || text || {sql_str(pr.SEARCH_PROMPT_TAIL)} AS prompt
FROM benchmark""")
def excerpt_query_prompt(spark, sf_dir):
    """Q2: excerpt -> search-query prompt."""
    e = tb.eval_set(spark, sf_dir)
    return e.select("item_id", pr.search_prompt(F.col("excerpt")).alias("prompt"))


# --------------------------------------------------------------------------- retrieval agent (C4)

def agent_turns(spark, sf_dir, k=3, writer=stubs.make_query_writer, embedder=stubs.make_letter_embedder):
    """C4 for every evaluation row: prompt -> model turn 1 -> ``Query: `` removed
    -> query embedding -> k-NN over the index -> numbered titles -> turn 2."""
    index = tb.vector_index(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"), "title")
    return jobs.retrieve_for_excerpts(tb.eval_set(spark, sf_dir), index, make_chat_model=writer, make_query_embedder=embedder, k=k)


_AGENT_SQL = with_views(["papers"], "").rstrip("\n") + f""",
t1 AS (SELECT item_id, 'Query: ' || array_to_string(string_split(text, ' ')[1:3], ' ') AS answer1 FROM benchmark),
sq AS (SELECT item_id, answer1,
              CASE WHEN starts_with(answer1, 'Query: ') THEN substring(answer1, 8) ELSE answer1 END AS search_query
       FROM t1),
qv AS (SELECT *, list_transform(range(64), lambda j: CAST(length(search_query)
              - length(replace(search_query, chr(CAST(97 + j % 26 AS INTEGER)), '')) AS DOUBLE)) AS qvec FROM sq),
idx AS (SELECT e.vec_id, p.title, e.embedding FROM embeddings e JOIN papers p ON p.paperId = CAST(e.vec_id AS VARCHAR)),
d AS (SELECT qv.item_id, idx.vec_id, idx.title,
             round(list_distance(qv.qvec, idx.embedding::DOUBLE[]), 5) AS dist FROM qv, idx),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dist, vec_id) AS rk FROM d),
l AS (SELECT item_id, string_agg(CAST(rk AS VARCHAR) || '. ' || title, chr(10) ORDER BY rk) AS lst
      FROM r WHERE rk <= 3 GROUP BY item_id),
m AS (SELECT sq.item_id, sq.answer1, sq.search_query,
             coalesce(l.lst, {sql_str(pr.NO_PAPERS)}) || {sql_str(pr.GUESS_SUFFIX)}
               AS message
      FROM sq LEFT JOIN l ON l.item_id = sq.item_id)"""


@register("retrieve_agent_stub", _AGENT_SQL + """
SELECT item_id, search_query, message, split_part(message, chr(10), 1) AS answer FROM m""")
def retrieve_agent_stub(spark, sf_dir):
    """C4 with stub models: Q2 M5 X1 M1 J7 T8 Q3 M5."""
    a = agent_turns(spark, sf_dir)
    return a.select("item_id", "search_query", "message", "answer")


@register("clean_query", _AGENT_SQL + """
SELECT item_id, answer1 AS raw, regexp_replace(search_query, '^\\s+|\\s+$', '', 'g') AS cleaned FROM m""")
def clean_query(spark, sf_dir):
    """The model's ``Query: ...`` turn, prefix removed once, stripped."""
    e = tb.eval_set(spark, sf_dir)
    first = chat.alternate_roles(F.array(pr.search_prompt(F.col("excerpt"))))
    e = e.withColumn("raw", generate(first, stubs.make_query_writer))
    return e.select("item_id", "raw", py_strip(remove_prefix(F.col("raw"), pr.QUERY_PREFIX)).alias("cleaned"))


# --------------------------------------------------------------------------- embeddings (M1 M2 M3 K5)

_VSUM_SQL = ("list_sum(list_transform(range(64), lambda j: length({c}) - "
             "length(replace({c}, chr(CAST(97 + j % 26 AS INTEGER)), ''))))")


@register("embed_table_stub", f"""
SELECT id, CAST(64 AS INTEGER) AS dim, CAST({_VSUM_SQL.format(c='content')} AS DOUBLE) AS vsum FROM (
  SELECT 'http://arxiv.org/abs/' || CAST(doc_id AS VARCHAR) || 'v1' AS id,
         split_part(text, chr(10), 1) ||
           CASE WHEN instr(text, chr(10)) > 0 AND length(substring(text, instr(text, chr(10)) + 1)) > 0
                THEN ' ' || substring(text, instr(text, chr(10)) + 1) ELSE '' END AS content
  FROM documents WHERE lang = 'en'
  ORDER BY make_timestamp(2015 + doc_id % 10, 1, 1 + doc_id % 28, 0, 0, 0) DESC,
           'http://arxiv.org/abs/' || CAST(doc_id AS VARCHAR) || 'v1') t""")
def embed_table_stub(spark, sf_dir):
    """C3 (M2: S5 -> P4 -> M1 -> K5): the entries of a topic embedded, saved as one table (read-through cache) and
    turned into records."""
    table = jobs.build_arxiv_index(tb.arxiv_entries(spark, sf_dir), topic="en", make_embedder=stubs.make_letter_embedder,
                                   cache_path=f"{checkpoint_dir(spark)}/arxiv_embeddings", model_name="letters")
    return table.select(F.split_part("id", F.lit("#"), F.lit(1)).alias("id"), F.size("values").alias("dim"),
                        F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("vsum"))


@register("attach_vectors_fallback", with_views(["papers"], f"""
SELECT p.paperId, e.embedding IS NULL AS computed,
       CAST(CASE WHEN e.embedding IS NULL
                 THEN {_VSUM_SQL.format(c="(title || CASE WHEN coalesce(length(abstract), 0) > 0 THEN ' ' || abstract ELSE '' END)")}
                 ELSE round(list_sum(e.embedding::DOUBLE[]), 3) END AS DOUBLE) AS vsum
FROM papers p LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.paperId"""))
def attach_vectors_fallback(spark, sf_dir):
    """M3: vectors looked up by id; the injected encoder (M1) fills only the
    papers without one."""
    p = tb.papers(spark, sf_dir)
    j = co.attach_or_embed(p, tb.paper_vectors(spark, sf_dir), stubs.make_letter_embedder)
    s = F.aggregate("embeddings", F.lit(0.0), lambda a, x: a + x)
    return j.select("paperId", "computed", F.when(F.col("computed"), s).otherwise(F.round(s, 3)).alias("vsum"))


# --------------------------------------------------------------------------- gold CSV source

@register("gold_csv_union", with_views(["papers", "gold"], """
SELECT paperId, title, query, excerpt, reason FROM gold
UNION ALL SELECT paperId, title, query, excerpt, reason FROM gold"""))
def gold_csv_union(spark, sf_dir):
    """Gold rows appended to CSV logs with two different column
    orders, a log missing ``reason`` (skipped) and an empty file (skipped),
    then read back grouped by header and unioned by name."""
    g = tb.gold(spark, sf_dir).select(*csv_logs.GOLD_QUERY_COLUMNS)
    fp = source_fingerprint(spark, tb.table_path(sf_dir, "documents"), tb.table_path(sf_dir, "benchmark"))
    base = f"{checkpoint_dir(spark)}/gold_logs/{cache_key(fp=fp, v=3)}"
    if not is_complete(spark, f"{base}/_SUCCESS_ALL"):
        csv_logs.append_log(g, f"{base}/gold_queries_a", "first")
        csv_logs.append_log(g.select("reason", "excerpt", "query", "title", "paperId", F.lit("x").alias("extra")),
                            f"{base}/gold_queries_b", "first")
        csv_logs.append_log(g.drop("reason"), f"{base}/gold_queries_c", "first")
        csv_logs.write_empty(spark, f"{base}/gold_queries_d.csv")
        csv_logs.write_empty(spark, f"{base}/_SUCCESS_ALL/_SUCCESS")
    return csv_logs.read_logs(spark, f"{base}/gold_queries*")
