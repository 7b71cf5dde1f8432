"""Citation excerpts and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.draws import draw_key
from scriptorium.operators.batching import top_n


#: Citations of one paper that one task may join.
HOT_ROWS = 1_000_000


def citation_excerpts(papers: DataFrame, citations: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """papers JOIN citations on the cited id -> {paper, citingPaper, excerpts}.

    A paper with more than ``hot_rows`` citations is a hot key: its citations are dealt over as many salts as their
    count needs, and its one row is copied to each, so no task joins many more than ``hot_rows`` of them, whatever the
    adaptive skew join does.  The table of hot papers holds at most citations / ``hot_rows`` narrow rows, which is the
    bound of its broadcast."""
    counts = citations.groupBy(F.col("citedPaperId").alias("_hot")).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(counts.where(F.col("_n") > hot_rows).select("_hot", F.ceil(F.col("_n") / hot_rows).alias("_salts")))
    p = papers.select("paperId", F.struct(*papers.columns).alias("paper")).join(hot, F.col("paperId") == F.col("_hot"), "left")
    p = p.select("paperId", "paper", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)).alias("_copy"))
    c = citations.join(hot, F.col("citedPaperId") == F.col("_hot"), "left")
    c = c.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("seq"), F.col("_salts")), F.lit(0)))
    return (c.join(p, (F.col("citedPaperId") == F.col("paperId")) & (F.col("_salt") == F.col("_copy")))
            .select("paper", "citingPaper", F.col("contexts").alias("excerpts"), "seq"))


def explode_excerpts(rows: DataFrame) -> DataFrame:
    """One row per excerpt; an empty list yields no row (G1)."""
    return rows.select("*", F.posexplode("excerpts").alias("pos", "excerpt")).drop("excerpts") \
        .withColumn("pos", (F.col("pos") + 1).cast("long"))


def first_citations(citations: DataFrame, cap: int, key: str = "citedPaperId", order: str = "seq") -> DataFrame:
    """First ``cap`` citations per cited paper (W5).  ``row_number() <= cap``
    plans a partial WindowGroupLimit before the shuffle, so a hot paper
    ships at most ``cap`` rows per partition."""
    w = Window.partitionBy(key).orderBy(order)
    return citations.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def sample_training_pairs(papers: DataFrame, citations: DataFrame, num_excerpts: int, seed: str,
                          cap_per_paper: int) -> DataFrame:
    """Shuffled papers -> first citations -> flattened contexts -> global cap.

    The cap counts excerpts (not papers), taken in (paper draw, citation
    order, context position) order: a global top-N, merged from per-partition
    top-N, never a full sort."""
    c = first_citations(citations, cap_per_paper)
    p = papers.select("paperId", "title", draw_key(seed, F.col("paperId")).alias("draw"))
    pairs = (c.join(p, c.citedPaperId == p.paperId)
             .select("paperId", "title", "draw", "seq", F.posexplode("contexts").alias("pos", "excerpt"))
             .withColumn("pos", F.col("pos").cast("long")))
    return (top_n(pairs, num_excerpts, ["draw", "seq", "pos"])
            .select("excerpt", F.struct("paperId", "title").alias("cited"), "draw", "seq", "pos"))


def attributable(rows: DataFrame, verdict: str = "eval") -> DataFrame:
    """Keep excerpts whose verdict starts with ``' YES'``."""
    return rows.where(F.startswith(F.col(verdict), F.lit(" YES")))


def short_pairs(rows: DataFrame, max_len: int = 350, cap: int | None = None,
                order=("seq", "pos")) -> DataFrame:
    """``len(excerpt + title) < 350`` -> ``{cited, excerpt}`` -> all rows, or the first ``cap``."""
    out = rows.where(F.length(F.concat("excerpt", "title")) < max_len)
    if cap is not None:
        out = top_n(out, cap, list(order))
    return out.select(F.struct("paperId", "title").alias("cited"), "excerpt", *order)
