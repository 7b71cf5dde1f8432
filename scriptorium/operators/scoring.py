"""Reward ladders for model responses.

Stateless per row: the same functions score a batch DataFrame or a
streaming one.  The search behind R2 is that of
``operators.search``; the response parse (X7) is native but for rare rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.actions import with_action
from scriptorium.functions.text import is_empty_or_multiline, letter_count, py_strip
from scriptorium.operators import search as se
from scriptorium.session import checkpoint_dir

INVALID = -1.0
PENALTY = -0.3
NO_MATCHES = 0.1


def _held(df: DataFrame) -> DataFrame:
    """The responses checkpointed: model output is the expensive part and must not be recomputed."""
    if df.isStreaming:
        return df
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parse_queries(df: DataFrame, response: str = "response") -> DataFrame:
    """X7 + X3 + R1's early ladder: ``pre_reward`` is set when the ladder stops early.  The responses are checkpointed."""
    a = F.col("_a")
    q = py_strip(a["query"])
    pre = (F.when(~a["search_keys"], F.lit(INVALID))
           .when(~a["query_is_str"], F.lit(INVALID))              # reference crashes here; counted malformed
           .when(is_empty_or_multiline(q), F.lit(PENALTY))
           .when(letter_count(q) < 2, F.lit(PENALTY)))
    return (with_action(_held(df), response, "_a")
            .withColumn("pre_reward", pre)
            .withColumn("query", F.when(pre.isNull(), q))
            .withColumn("sort", a["name"])
            .withColumn("reason", a["reason"])
            .drop("_a"))


def query_rewards(idx: se.SearchIndex, parsed: DataFrame, key: str, target: str = "paperId",
                  page: int = 100) -> DataFrame:
    """R2 for the rows that passed the early ladder, R1's value for the rest.

    Each query searches the corpus (page of ``page``, total before the
    limit); ``sort == 'search_citation_count'`` re-sorts the page by
    citations, anything else keeps relevance order (T4).  Adds ``reward``,
    ``found``, ``rank`` (1-based, W4) and ``total``.

    ``parsed`` feeds three branches and is checkpointed: read through a filter
    or a join, the parse of a response is done over for each of its uses.  It
    should have no columns that are not wanted of the result."""
    parsed = _held(parsed)
    todo = parsed.where(F.col("pre_reward").isNull())
    ranks = se.ranks_in_page(idx, todo, page, key, target, F.coalesce(F.col("sort") == "search_citation_count", F.lit(False)))
    scored = parsed.join(ranks, key, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    total = F.col("total").cast("double")
    r2 = (F.when(F.col("total") == 0, F.lit(NO_MATCHES))
          .when(F.col("rank").isNotNull(), F.lit(10.0) / F.sqrt(F.col("rank").cast("double")) + F.lit(1.0) / total)
          .otherwise(F.lit(1.0) / F.ln(total + 1.0) + F.lit(0.3)))
    return (scored.withColumn("reward", F.round(F.coalesce(F.col("pre_reward"), r2), 6))
            .withColumn("found", F.col("pre_reward").isNull() & F.col("rank").isNotNull()))


def gold_query_rows(scored: DataFrame) -> DataFrame:
    """The rows whose query found the target, as the gold CSV columns."""
    return scored.where("found").select("paperId", "title", "query", "excerpt", "reason")


def selection_rewards(df: DataFrame, response: str = "response", ref_response: str = "ref_response",
                      target: str = "paperId") -> DataFrame:
    """R3 + R4: +2 right paper, -1 wrong paper, -2 invalid or not ``select_paper``;
    ``ref_status`` (correct / incorrect / invalid) only for right answers; the
    baseline's action name is ignored.  Ids compare as strings: a numeric
    ``paper_id`` never equals.  The responses are checkpointed (not on a stream)."""
    a, r = F.col("_a"), F.col("_r")
    right = a["paper_id"].isNotNull() & (a["paper_id"] == F.col(target))
    reward = (F.when(~a["select_keys"], F.lit(-2))
              .when(a["name"].isNull() | (a["name"] != "select_paper"), F.lit(-2))
              .when(~right, F.lit(-1))
              .otherwise(F.lit(2)))
    status = (F.when(~r["paper_id_key"], F.lit("invalid"))
              .when(r["paper_id"].isNotNull() & (r["paper_id"] == F.col(target)), F.lit("correct"))
              .otherwise(F.lit("incorrect")))
    return (with_action(with_action(_held(df), response, "_a"), ref_response, "_r")
            .withColumn("reward", reward.cast("int"))
            .withColumn("ref_status", F.when(reward == 2, status))
            .withColumn("reason", a["reason"])
            .drop("_a", "_r"))


def gold_selection_rows(scored: DataFrame, response: str = "response", ref_response: str = "ref_response", seq=None) -> DataFrame:
    """K4: the right answers, as the gold-selection CSV columns, with their order ``seq``
    (a column or expression; else an id that grows with the rows), which C11 needs."""
    order = F.monotonically_increasing_id() if seq is None else (F.col(seq) if isinstance(seq, str) else seq)
    return scored.where(F.col("reward") == 2).select(
        "paperId", "title", "excerpt", "reason", F.col(response).alias("action"),
        F.col(ref_response).alias("ref_action"), "ref_status", order.cast("long").alias("seq"))


def batch_sums(batched: DataFrame, value: str = "reward") -> DataFrame:
    """Sum of rewards per batch (A2)."""
    return batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total_reward"))
