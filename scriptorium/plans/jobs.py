"""Composite jobs (C1-C13): the public entry points.

Each takes DataFrames (or paths) and injected model factories and returns a
DataFrame; writes go to caller-given paths on the shared file system.  They
compose the operators only - no job collects data to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import chat
from scriptorium.functions.actions import format_action, format_select
from scriptorium.functions.draws import uniform_int
from scriptorium.functions.text import citation_string, latex_to_text, remove_prefix
from scriptorium.operators import corpus as co
from scriptorium.operators import excerpts as ex
from scriptorium.operators import prompts as pr
from scriptorium.operators import ranking as rk
from scriptorium.operators import scoring as sc
from scriptorium.operators import search as se
from scriptorium.operators.knn import knn_join
from scriptorium.operators.models import embed, generate
from scriptorium.operators.sampling import draw_candidates
from scriptorium.sources import csv_logs, vector_store
from scriptorium.session import checkpoint_dir
from scriptorium.sources.materialize import cache_key, frame_fingerprint, materialize, run_sharded

ModelFactory = Callable[[], Callable[[list], list]]
TITLE_SCHEMA = T.StructType([T.StructField("title", T.StringType())])


def build_paper_corpus(papers: DataFrame, *, field: str, years=range(2018, 2025), min_citation_count: int = 20,
                       limit: int | None = None, path: str | None = None) -> DataFrame:
    """Year-sharded, filtered, exactly capped paper harvest (read-through when ``path`` is given)."""
    def build():
        return co.harvest(papers, field=field, years=years, min_citation_count=min_citation_count, limit=limit)
    if not path:
        return build()
    key = cache_key(fp=frame_fingerprint(papers), field=field, years=list(years), least=min_citation_count, limit=limit)
    return materialize(papers.sparkSession, f"{path.rstrip('/')}/{key}", build)


def build_vector_index(papers: DataFrame, vectors: DataFrame, *, model: str, batch_seq: int,
                       existing: DataFrame | None = None, dim: int | None = None,
                       index_path: str | None = None) -> DataFrame:
    """Papers ⟕ vectors -> records (missing vectors dropped) -> keyed upsert.

    With ``index_path`` the records go into the versioned table there and its new state is returned."""
    recs = co.semantic_record(co.attach_vectors(papers, vectors), model).withColumn(
        "batch_seq", F.lit(batch_seq).cast("long"))
    if index_path:
        incoming = recs if existing is None else co.upsert(existing, recs, dim=dim)
        vector_store.upsert_records(papers.sparkSession, index_path, incoming, dim=dim)
        return vector_store.read_records(papers.sparkSession, index_path)
    return co.upsert(existing, recs, dim=dim) if existing is not None else recs


def build_arxiv_index(entries: DataFrame, *, topic: str, make_embedder: ModelFactory, max_results: int | None = None,
                      cache_path: str | None = None, model_name: str = "") -> DataFrame:
    """C3 (M2): newest entries of a topic -> content -> embedding -> arXiv records.

    The cache under ``cache_path`` is keyed by the entries' files, the parameters and ``model_name``."""
    meta = co.with_content(co.arxiv_metadata(co.topic_scan(entries, topic, max_results)))

    def build():
        return meta.withColumn("embeddings", embed(F.col("content"), make_embedder))
    if not cache_path:
        return co.arxiv_record(build())
    key = cache_key(fp=frame_fingerprint(entries), topic=topic, n=max_results, model=model_name)
    return co.arxiv_record(materialize(entries.sparkSession, f"{cache_path.rstrip('/')}/{key}", build))


def retrieve_for_excerpts(excerpts: DataFrame, index: DataFrame, *, make_chat_model: ModelFactory,
                          make_query_embedder: ModelFactory, k: int = 3, key: str = "item_id",
                          excerpt: str = "excerpt", namespace: str | None = None) -> DataFrame:
    """C4: for every excerpt, model turn 1 writes a query, the query is embedded,
    its k nearest index records are listed, and model turn 2 guesses the paper.
    ``index`` holds vector records (id, values, and a title or metadata JSON with one).
    Turn 1 and its embedding are checkpointed: the models run once per excerpt."""
    idx = index.where(F.col("namespace") == namespace) if namespace else index
    first = chat.alternate_roles(F.array(pr.search_prompt(F.col(excerpt))))
    e = excerpts.withColumn("answer1", generate(first, make_chat_model))
    e = e.withColumn("search_query", remove_prefix(F.col("answer1"), pr.QUERY_PREFIX))
    checkpoint_dir(excerpts.sparkSession)
    e = e.withColumn("qvec", embed(F.col("search_query"), make_query_embedder)).checkpoint(eager=True)
    hits = knn_join(e.select(key, "qvec"), idx.select("id", "values"), k, query_id=key, query_vec="qvec",
                    corpus_id="id", corpus_vec="values")
    title = F.col("title") if "title" in idx.columns else F.from_json("metadata", TITLE_SCHEMA)["title"]
    titled = hits.join(idx.select("id", title.alias("title")), "id") \
        .select(F.col("qid").alias(key), "rank", "title")
    msg = pr.numbered_titles_message(e.select(key), titled, key=key)
    e = e.join(msg, key, "left")
    second = chat.alternate_roles(F.array(pr.search_prompt(F.col(excerpt)), F.col("answer1"), F.col("message")))
    return e.withColumn("answer", generate(second, make_chat_model)).drop("qvec")


def build_citation_excerpts(papers: DataFrame, citations: DataFrame, *, field: str, year: str = "2016-",
                            min_citation_count: int = 30) -> DataFrame:
    """Filtered papers ⋈ their citation edges -> {paper, citingPaper, excerpts}."""
    p = co.paper_scan(papers, field=field, year=year, min_citation_count=min_citation_count)
    return ex.citation_excerpts(p, citations)


def excerpt_verdicts(rows: DataFrame, make_verdict_model: ModelFactory, batch_size: int = 32) -> DataFrame:
    """One row per excerpt (title, excerpt, ...) with its attribution prompt and the model's verdict (Q1 M4)."""
    rows = rows.withColumn("prompt", pr.attribution_prompt(F.col("title"), F.col("excerpt")))
    return rows.withColumn("eval", generate(F.col("prompt"), make_verdict_model, batch_size))


def sharded_verdicts(excerpt_table: DataFrame, *, make_verdict_model: ModelFactory, base_path: str,
                     rows_per_shard: int, batch_size: int = 32) -> DataFrame:
    """C6 up to the filter: one row per excerpt, the verdict model run with a checkpoint per shard."""
    rows = ex.explode_excerpts(excerpt_table).select(
        F.col("paper.paperId").alias("paperId"), F.col("paper.title").alias("title"), "seq", "pos", "excerpt")
    return run_sharded(rows, lambda part: excerpt_verdicts(part, make_verdict_model, batch_size), base_path,
                       rows_per_shard=rows_per_shard, key=["seq", "pos"])


def attributable_excerpts(excerpt_table: DataFrame, *, make_verdict_model: ModelFactory, base_path: str,
                          rows_per_shard: int, batch_size: int = 32) -> DataFrame:
    """The excerpts whose verdict, of a run with a checkpoint per shard, is ' YES'."""
    return ex.attributable(sharded_verdicts(excerpt_table, make_verdict_model=make_verdict_model, base_path=base_path,
                                            rows_per_shard=rows_per_shard, batch_size=batch_size))


def sample_training_pairs(papers: DataFrame, citations: DataFrame, *, field: str, seed: str,
                          num_excerpts: int, cap_per_paper: int, min_citation_count: int = 20) -> DataFrame:
    """C7 (service path): shuffled papers, their first citations, excerpts capped."""
    p = co.paper_scan(papers, field=field, year="2016-", min_citation_count=min_citation_count)
    return ex.sample_training_pairs(p, citations, num_excerpts, seed, cap_per_paper)


def training_rows_from_attributable(attributable: DataFrame, cap: int | None = None) -> DataFrame:
    """C7 (saved path): short attributable excerpts -> {cited, excerpt}, all or the first ``cap``."""
    return ex.short_pairs(attributable, cap=cap)


def score_query_responses(responses: DataFrame, index: se.SearchIndex, *, key: str,
                          gold_log_path: str | None = None, batch: str | None = None) -> DataFrame:
    """Parse and validate each response, search its query, reward it; the
    rows that found their target are appended to the gold query log."""
    scored = sc.query_rewards(index, sc.parse_queries(responses), key=key)
    if gold_log_path:
        csv_logs.append_log(sc.gold_query_rows(scored), gold_log_path, batch)
    return scored


def rank_queries(gold: DataFrame, index: se.SearchIndex, *, key: str = "qid", limit: int | None) -> DataFrame:
    """C9 core (R5): each gold row with relevance_rank, citation_rank, citations, results (the top ``limit``, all if None)."""
    page = se.search_ranked(index, gold.select(F.col(key).alias("qid"), "query"), limit)
    res = se.results_array(page).withColumnRenamed("qid", key)
    return rk.ranked(gold.join(res, key, "left"))


def rank_gold_logs(spark, pattern: str, index: se.SearchIndex, *, limit: int | None = None) -> DataFrame:
    """Every valid gold CSV log (header-checked, bound by name), ranked over all results or the top ``limit``."""
    checkpoint_dir(spark)
    gold = csv_logs.read_logs(spark, pattern).withColumn("qid", F.monotonically_increasing_id())
    gold = gold.checkpoint(eager=True)          # the key must not change between the two uses
    return rank_queries(gold, index, key="qid", limit=limit)


def selection_prompts(ranked: DataFrame, *, seed: str, key: str = "item_id", k: int | None = None) -> DataFrame:
    """C10 prompts (F7 F8 W8 Q6 Q7): k drawn in 2..5 unless fixed."""
    r = rk.selectable(ranked)
    kk = F.lit(k) if k is not None else uniform_int(seed, F.col(key).cast("string"), 2, 5)
    r = r.withColumn("k", kk.cast("int")).withColumn(
        "candidates", draw_candidates(F.col("results"), F.col("paperId"), F.col("k"), seed,
                                      F.col(key).cast("string")))
    return r.withColumn("prompt", pr.selection_prompt(pr.paper_listing(F.col("candidates")), F.col("excerpt")))


def score_selections(responses: DataFrame, *, gold_log_path: str | None = None, seq=None, batch: str | None = None) -> DataFrame:
    """C10 scoring (R3 R4 K4): responses and baseline responses -> rewards, gold log.

    The responses are checkpointed, so the models behind them run once.  ``seq``
    names the column that orders the log."""
    scored = sc.selection_rewards(responses)
    if gold_log_path:
        csv_logs.append_log(sc.gold_selection_rows(scored, seq=seq), gold_log_path, batch)
    return scored


def gold_selection_log(spark, pattern: str) -> DataFrame:
    """The gold selection log (K4) as C11 reads it, ``seq`` a number again."""
    rows = csv_logs.read_logs(spark, pattern, csv_logs.GOLD_SELECTION_COLUMNS)
    return rows.withColumn("seq", F.col("seq").cast("long"))


def supervised_selection_text(ranked: DataFrame, gold_selections: DataFrame, *, seed: str, key: str = "item_id",
                              template: str = chat.PHI_TEMPLATE) -> DataFrame:
    """C11 (F9 F8 J5 W8 Q8 Q10): selection training text, k = 5, the reason of the
    last gold row per paper."""
    g = co.last_wins(gold_selections).select("paperId", F.col("reason").alias("gold_reason"))
    r = ranked.where(rk.contains_target(F.col("results"), F.col("paperId"))).join(g, "paperId")
    r = r.withColumn("candidates", draw_candidates(F.col("results"), F.col("paperId"), F.lit(5), seed,
                                                   F.col(key).cast("string")))
    user = pr.alpaca(pr.SFT_INSTRUCTIONS, F.concat(F.lit(pr.SFT_SELECT_INPUT_HEAD),
                                                   pr.paper_listing(F.col("candidates")),
                                                   F.lit(pr.SFT_SELECT_INPUT_TAIL)))
    asst = F.concat(F.lit(pr.OUTPUT_PREFIX), format_select(F.col("paperId"), F.col("gold_reason")))
    return r.withColumn("text", chat.render(F.array(chat.message("user", user), chat.message("assistant", asst)),
                                            template))


def supervised_query_text(ranked: DataFrame, *, template: str = chat.PHI_TEMPLATE) -> DataFrame:
    """C12 (X11 X8 Q9 Q10): query training text; the template drops ``reason``."""
    action = rk.choose_action(F.col("relevance_rank"), F.col("citation_rank"))
    user = pr.alpaca(pr.SFT_INSTRUCTIONS, F.col("excerpt"))
    asst = F.concat(F.lit(pr.OUTPUT_PREFIX), format_action(F.col("query"), action, F.col("reason")))
    return ranked.withColumn("text", chat.render(F.array(chat.message("user", user),
                                                         chat.message("assistant", asst)), template))


def title_context_prompts(titles: DataFrame, queries: DataFrame, index: se.SearchIndex, entries: DataFrame, *,
                          key: str = "item_id", per_title: int | None = None) -> DataFrame:
    """C13 (S6 X9 J6 A5 Q4): for each (key, rank, title) the title search's
    results, all or the top ``per_title``, become citation strings, blocks are concatenated in rank order and
    put into the context question with the key's query."""
    t = titles.withColumn("qid", F.concat_ws("#", F.col(key).cast("string"), F.col("rank").cast("string")))
    page = se.search_page(index, t.select("qid", F.col("title").alias("query")), per_title, with_total=False)
    ent = entries.withColumn("plain", latex_to_text(F.col("title")))
    cites = page.join(ent.select("paperId", "plain", "authors", "published", "short_id", "entry_id"), "paperId") \
        .select("qid", "pos", F.col("plain").alias("title"),
                citation_string(F.col("plain"), F.col("authors"), F.col("published"), F.col("short_id"),
                                F.col("entry_id")).alias("citation"))
    per = cites.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", "title", "citation"))).alias("c"))
    blocks = t.join(per, "qid", "left").select(
        key, "rank", pr.context_block(F.col("title"), F.coalesce(F.col("c"), F.array())).alias("block"))
    ctx = pr.ordered_titles(blocks, key, order="rank", value="block").select(
        key, F.array_join("titles", "").alias("context"))
    q = queries.join(ctx, key, "left")
    return q.withColumn("prompt", pr.context_question(F.col("query"), F.coalesce(F.col("context"), F.lit(""))))
