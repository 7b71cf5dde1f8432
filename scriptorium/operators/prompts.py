"""Prompt and training-text assembly (Q1-Q9) as string-valued projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import chat
from scriptorium.functions.draws import coin
from scriptorium.functions.text import prefix

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's text for equal prompts).
# ---------------------------------------------------------------------------
ATTRIBUTION_INSTRUCTION = (
    "For the given cited paper and excerpts, respond with YES or NO if the excerpt is attributable "
    "to the cited paper title. Then explain in brief why, come up with a query from the excerpt that "
    "would've returned that paper\n")
ATTRIBUTION_ANSWER_PREFIX = "ANSWER: "

SEARCH_PROMPT_HEAD = (
    "**You are given an excerpt from a paper, where a citation was deleted. I'm trying to find the "
    "citation (ignore the word [CITATION], that's just where the citation was deleted from. You will "
    "be asked to help me find the paper from which the citation was deleted.\n"
    "You can ask me a search query and I will try to find related papers. I can't give you more data "
    "from the paper, or any data about the cited paper. You have to do it exactly once. After that, "
    "you will be asked to provide the citation. If you don't know the citation, you can say "
    "'I don't know'.**\n"
    "EXCERPT START\n")
SEARCH_PROMPT_TAIL = "\nEXCERPT END\n\n**Now just supply the query in this format: Query: text**"
QUERY_PREFIX = "Query: "
NO_PAPERS = "No papers found"
GUESS_SUFFIX = "\nNow just reply with your guessed cited paper title"

CONTEXT_QUESTION = "What is the paper {query} citations, based on the next papers and citations: {context}\n"

QUERY_PROMPT_HEAD = "I'm looking for a paper referenced in this excerpt:\n\n"
QUERY_PROMPT_TAIL = (
    "\n\nI need a short and concise query for the papers search engine. Avoid quotation marks, hyphens "
    "or any punctuation. Don't use extra spaces or period. Searching by author name or publication "
    "date is not allowed.\nUse JSON format as follows:\n")
MENU_HEAD = "You can use any of the following actions up to 5 times:\n"
MENU_RELEVANCE = ('Search by relevance: {"action": {"name": "search_relevance": "query": "search terms"}, '
                  '"reason": "why"}\n')
MENU_CITATION = ('Search by citation count: {"action": {"name": "search_citation_count": "query": '
                 '"search terms"}, "reason": "why"}\n')

SELECT_INSTRUCTION = ('Select cited paper: {"reason": "why", "action": {"name": "select_paper", '
                      '"paper_id": "paper ID"}}\n')
SELECT_PROMPT_HEAD = "From the following academic papers list, you must select single paper.\n\n"
SELECT_PROMPT_MID = "\n\nI'm looking for the paper referenced in the following excerpt:\n\n"
SELECT_PROMPT_FORMAT = "\nThere's exactly one correct paper. Respond with JSON format as follows exactly:\n"
SELECT_PROMPT_TAIL = (". The reason should be single line consice short explanation of why that paper is "
                      "the best match, respond with nothing but a JSON format.")

ALPACA_HEAD = ("Below is an instruction that describes a task, paired with an input that provides further "
               "context. Write a response that appropriately completes the request.\n\n### Instruction:\n")
ALPACA_INPUT = "\n\n### Input:\n"
SFT_INSTRUCTIONS = (
    "You are an expert in machine learning papers. You are given an excerpt from a paper, where a "
    "citation was deleted. I'm trying to find the citation (ignore the word [CITATION], that's just "
    "where the citation was deleted from). Read the following excerpt, and tell me what paper was cited. "
    "Tell me what to search in order to find the paper."
    "\n\nYou can use any of the following actions up to 5 times:\n"
    'Search by relevance: {"action": {"name": "search_relevance": "query": "search terms"}}\n'
    'Search by citation count: {"action": {"name": "search_citation_count": "query": "search terms"}}\n'
    'Select cited paper: {"action": {"name": "select_paper", "paper_id": "paper ID"}}\n')
SFT_SELECT_INPUT_HEAD = "From the following academic papers list, you must select single paper:\n\n"
SFT_SELECT_INPUT_TAIL = ("\n\n The reason should be single line consice short explanation of why that "
                         "paper is the best match, respond with nothing but a JSON format.")
OUTPUT_PREFIX = "### Output:\n"
ATTRIBUTION_TITLE = "Cited paper title: "
ATTRIBUTION_EXCERPTS = "\nExcerpts: "
LISTING_ID = "- Paper ID: "
LISTING_TITLE = "\n\tTitle: "
LISTING_ABSTRACT = "\tAbstract: "
LISTING_COUNT = "\tCitation Count: "
CONTEXT_TITLE = "Title: "
CONTEXT_CITATION = "citations: "
# ---------------------------------------------------------------------------


def attribution_prompt(title: Column, excerpt: Column, max_excerpt: int | None = None) -> Column:
    """User message with title and excerpt (its first ``max_excerpt`` characters if given); assistant prefix (Q1)."""
    user = F.concat(F.lit(ATTRIBUTION_INSTRUCTION), F.lit(ATTRIBUTION_TITLE), title,
                    F.lit(ATTRIBUTION_EXCERPTS), prefix(excerpt, max_excerpt), F.lit("\n"))
    return F.array(chat.message("user", user), chat.message("assistant", F.lit(ATTRIBUTION_ANSWER_PREFIX)))


def search_prompt(excerpt: Column) -> Column:
    """Excerpt -> search-query prompt (Q2)."""
    return F.concat(F.lit(SEARCH_PROMPT_HEAD), excerpt, F.lit(SEARCH_PROMPT_TAIL))


def numbered_list(titles: Column) -> Column:
    """``"1. t1\\n2. t2"``."""
    return F.array_join(F.transform(titles, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def guess_message(titles: Column) -> Column:
    """Numbered titles, or ``No papers found``, plus the guess request."""
    listing = F.when(F.coalesce(F.size(titles), F.lit(0)) <= 0, F.lit(NO_PAPERS)).otherwise(numbered_list(titles))
    return F.concat(listing, F.lit(GUESS_SUFFIX))


def ordered_titles(titled: DataFrame, key: str, order: str = "rank", value: str = "title") -> DataFrame:
    """(key, order, value) -> (key, titles) with titles in ``order``.

    The groups are per query and hold at most k rows (the output of a top-k).
    """
    return (titled.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
                 .alias("_s"))
            .select(key, F.transform("_s", lambda s: s["v"]).alias("titles")))


def numbered_titles_message(keys: DataFrame, titled: DataFrame, key: str) -> DataFrame:
    lists = ordered_titles(titled, key)
    return keys.join(lists, key, "left").select(key, guess_message(F.col("titles")).alias("message"))


def paper_listing(papers: Column, max_abstract: int | None = None) -> Column:
    """``- Paper ID / Title / [Abstract] / Citation Count`` blocks (Q6, A6); abstracts cut to ``max_abstract`` if given."""
    def block(p):
        abstract = F.when(F.coalesce(F.length(p["abstract"]), F.lit(0)) > 0,
                          F.concat(F.lit(LISTING_ABSTRACT), prefix(p["abstract"], max_abstract), F.lit("\n"))).otherwise("")
        return F.concat(F.lit(LISTING_ID), p["paperId"], F.lit(LISTING_TITLE), p["title"], F.lit("\n"),
                        abstract, F.lit(LISTING_COUNT), p["citationCount"].cast("string"), F.lit("\n\n"))
    return F.array_join(F.transform(papers, block), "")


def action_menu(seed, key) -> Column:
    """Randomised action menu (Q5).  The reference's flags are crossed: the
    citation-count flag shows the relevance line and vice versa; when both
    draws are false the citation-count flag is forced on."""
    show_count = coin(seed, key, "count")
    show_rel = coin(seed, key, "relevance")
    show_count = show_count | ~show_rel
    return F.concat(F.lit(MENU_HEAD),
                    F.when(show_count, F.lit(MENU_RELEVANCE)).otherwise(""),
                    F.when(show_rel, F.lit(MENU_CITATION)).otherwise(""))


def query_prompt(excerpt: Column, menu: Column) -> Column:
    return F.concat(F.lit(QUERY_PROMPT_HEAD), excerpt, F.lit(QUERY_PROMPT_TAIL), menu)


def selection_prompt(listing: Column, excerpt: Column) -> Column:
    """Selection prompt (Q7)."""
    return F.concat(F.lit(SELECT_PROMPT_HEAD), listing, F.lit(SELECT_PROMPT_MID), excerpt,
                    F.lit(SELECT_PROMPT_FORMAT), F.lit(SELECT_INSTRUCTION), F.lit(SELECT_PROMPT_TAIL))


def alpaca(instruction: Column | str, inp: Column) -> Column:
    ins = instruction if isinstance(instruction, Column) else F.lit(instruction)
    return F.concat(F.lit(ALPACA_HEAD), ins, F.lit(ALPACA_INPUT), inp)


def context_block(title: Column, cites: Column) -> Column:
    """``Title: t\\n`` then ``citations: t, c\\n\\n`` per citation (Q4)."""
    return F.concat(F.lit(CONTEXT_TITLE), title, F.lit("\n"),
                    F.array_join(F.transform(cites, lambda c: F.concat(
                        F.lit(CONTEXT_CITATION), c["title"], F.lit(", "), c["citation"], F.lit("\n\n"))), ""))


def context_question(query: Column, context: Column) -> Column:
    head, tail = CONTEXT_QUESTION.split("{query}")
    mid, end = tail.split("{context}")
    return F.concat(F.lit(head), query, F.lit(mid), context, F.lit(end))
