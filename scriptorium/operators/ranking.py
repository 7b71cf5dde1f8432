"""Ranks of a target inside a result list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL_RANK = 100
RESULTS_TYPE = "array<struct<paperId:string,citationCount:int,title:string,abstract:string>>"


def rank_in_results(results: Column, paper_id: Column) -> Column:
    """0-based index of the first match, -1 if absent."""
    return (F.array_position(F.transform(results, lambda r: r["paperId"]), paper_id) - 1).cast("int")


def by_citations(results: Column) -> Column:
    """Stable descending sort by citationCount: ties keep the list order."""
    keyed = F.transform(results, lambda r, i: F.struct((-r["citationCount"]).alias("k"), i.alias("i"), r.alias("r")))
    return F.transform(F.sort_array(keyed), lambda x: x["r"])


def target(results: Column, paper_id: Column) -> Column:
    """First result with the target id, null if absent."""
    return F.element_at(F.filter(results, lambda r: r["paperId"] == paper_id), 1)


def others(results: Column, paper_id: Column) -> Column:
    """Every result except the target."""
    return F.filter(results, lambda r: r["paperId"] != paper_id)


def contains_target(results: Column, paper_id: Column) -> Column:
    """``any(p['paperId'] == x['paperId'] for p in results)`` (F8)."""
    return F.exists(results, lambda r: r["paperId"] == paper_id)


def rank_query(results: Column, paper_id: Column) -> Column:
    """``rank_query`` (R5, W1-W3) with the error row (R6) as a struct.

    A null citationCount among two or more results makes the reference's
    sort fail, which lands in its error row ``100, 100, -1, []``."""
    sorted_r = by_citations(results)
    crank = rank_in_results(sorted_r, paper_id)
    cites = F.when(crank == -1, F.lit(-1)).otherwise(F.element_at(sorted_r, crank + 1)["citationCount"])
    failed = (F.size(results) > 1) & F.exists(results, lambda r: r["citationCount"].isNull())
    empty = F.array().cast(RESULTS_TYPE)
    return F.when(failed, F.struct(
        F.lit(SENTINEL_RANK).alias("relevance_rank"), F.lit(SENTINEL_RANK).alias("citation_rank"),
        F.lit(-1).alias("citations"), empty.alias("results"))).otherwise(F.struct(
            rank_in_results(results, paper_id).alias("relevance_rank"), crank.alias("citation_rank"),
            cites.cast("int").alias("citations"), results.alias("results")))


def ranked(df: DataFrame, results: str = "results", paper_id: str = "paperId") -> DataFrame:
    r = rank_query(F.coalesce(F.col(results), F.array().cast(RESULTS_TYPE)), F.col(paper_id))
    return df.withColumn("_r", r).select(
        *[c for c in df.columns if c != results],
        F.col("_r.relevance_rank").alias("relevance_rank"), F.col("_r.citation_rank").alias("citation_rank"),
        F.col("_r.citations").alias("citations"), F.col("_r.results").alias("results"))


def selectable(df: DataFrame, top: int = 10) -> DataFrame:
    """``relevance_rank <= 10 or citation_rank <= 10`` then target in results.

    A -1 (not found) passes F7; F8 removes it.  Only the error value 100 fails F7."""
    return df.where((F.col("relevance_rank") <= top) | (F.col("citation_rank") <= top)) \
             .where(contains_target(F.col("results"), F.col("paperId")))


def choose_action(relevance_rank: Column, citation_rank: Column) -> Column:
    """Strict ``<`` picks relevance; a tie picks citation count (X11)."""
    return F.when(relevance_rank < citation_rank, "search_relevance").otherwise("search_citation_count")


def shown_results(results: Column, action: Column, top: int = 10) -> Column:
    """Results as the chosen search shows them: re-sorted when by citation
    count, then the first ``top`` (T6)."""
    ordered = F.when(action == "search_citation_count", by_citations(results)).otherwise(results)
    return F.slice(ordered, 1, top)
