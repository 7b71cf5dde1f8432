"""Paper scans, vector records and the keyed vector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import embedding_content, record_id

# Fixed values (vector-record ids and namespaces must equal the reference's):
# paper records are "{paperId}#semanticscholar-metadata#{model}" in namespace
# "semanticscholar-metadata"; arXiv records are "{id}#arxiv-metadata#scibert"
# in namespace "arxiv-metadata".
PAPER_NAMESPACE = "semanticscholar-metadata"
ARXIV_NAMESPACE = "arxiv-metadata"
ARXIV_MODEL = "scibert"


def year_predicate(year: int | str | None) -> Column:
    """``'2016-'`` is an open range, ``'2018'``/``2018`` an equality, ``'2016-2019'`` a closed range.

    A null year never matches."""
    if year is None:
        return F.lit(True)
    y = str(year)
    if "-" in y:
        lo, hi = y.split("-", 1)
        cond = F.col("year").isNotNull()
        if lo:
            cond = cond & (F.col("year") >= int(lo))
        if hi:
            cond = cond & (F.col("year") <= int(hi))
        return cond
    return F.col("year") == int(y)


def paper_scan(papers: DataFrame, *, field: str | None = None, year: int | str | None = None,
               min_citation_count: int | None = None, fields: list[str] | None = None) -> DataFrame:
    """Filtered paper scan (S1, F3); predicates on stored columns reach the parquet scan, those on derived ones do not."""
    cond = year_predicate(year)
    if field is not None:
        # a single-valued field column compares directly, so the predicate
        # reaches the parquet scan; the list form needs array_contains
        if "fieldOfStudy" in papers.columns:
            cond = cond & (F.col("fieldOfStudy") == field)
        else:
            cond = cond & F.array_contains("fieldsOfStudy", field)
    if min_citation_count is not None:
        cond = cond & (F.col("citationCount") >= min_citation_count)
    out = papers.where(cond)
    return out.select(*fields) if fields else out


def harvest(papers: DataFrame, *, field: str, years=range(2018, 2025), min_citation_count: int = 20,
            limit: int | None = None, order: tuple[str, ...] = ("year", "seq")) -> DataFrame:
    """Year-sharded harvest (S13, T10) with an exact global cap.

    The year range becomes a partition-pruned range predicate on a table
    ``partitionBy('year')``; the cap is a global top-N in a fixed order
    (the reference's cap is per worker and off by one)."""
    from scriptorium.operators.batching import top_n
    ys = list(years)
    out = paper_scan(papers, field=field, year=f"{min(ys)}-{max(ys)}", min_citation_count=min_citation_count)
    if limit is not None:
        out = top_n(out, limit, list(order))
    return out


def attach_vectors(papers: DataFrame, vectors: DataFrame, key: str = "paperId",
                   vec: str = "embedding") -> DataFrame:
    """ids left-join vectors: null where missing."""
    return papers.join(vectors.select(key, F.col(vec).alias("embeddings")), key, "left")


def attach_or_embed(papers: DataFrame, vectors: DataFrame, make_fn=None, key: str = "paperId",
                    vec: str = "embedding", batch_size: int = 256) -> DataFrame:
    """Vectors looked up by id (M3); with an encoder, missing ones are computed
    from the P3 content (M1 fallback).  Adds ``embeddings`` and ``computed``."""
    from scriptorium.operators.models import embed
    j = attach_vectors(papers, vectors, key, vec)
    missing = F.col("embeddings").isNull()
    if make_fn is None:
        return j.withColumn("computed", F.lit(False))
    # a Python UDF inside ``when`` runs on every row, so the rows are split and only the missing ones encoded
    content = embedding_content(F.col("title"), F.col("abstract"))
    have = j.where(~missing).withColumn("computed", F.lit(False))
    lack = j.where(missing).withColumn("computed", F.lit(True)).withColumn("embeddings", embed(content, make_fn, batch_size))
    return have.unionByName(lack)


def semantic_record(df: DataFrame, model: str, namespace: str = PAPER_NAMESPACE,
                    values: str = "embeddings") -> DataFrame:
    """Vector record ``{id, values, metadata}``.

    ``metadata`` is serialised with ``to_json``, which omits null fields, the
    same as the reference's null-dropping dict; year and count stay numbers.
    Rows without a vector are dropped (F4)."""
    meta = F.struct("paperId", "title", "year", "citationCount", "abstract")
    return (df.where(F.col(values).isNotNull())
            .select(record_id(F.col("paperId"), namespace, model).alias("id"),
                    F.col(values).alias("values"),
                    F.to_json(meta).alias("metadata"),
                    F.lit(namespace).alias("namespace")))


def arxiv_record(df: DataFrame, values: str = "embeddings", namespace: str = ARXIV_NAMESPACE,
                 model: str = ARXIV_MODEL, extra: list[str] | None = None) -> DataFrame:
    """arXiv-style record: id ``{id}#arxiv-metadata#scibert``; metadata keeps
    id, categories and title, nulls included (P5, F14)."""
    meta = F.struct("id", "categories", "title")
    return df.select(record_id(F.col("id"), namespace, model).alias("id"),
                     F.col(values).alias("values"),
                     F.to_json(meta, {"ignoreNullFields": "false"}).alias("metadata"),
                     F.lit(namespace).alias("namespace"), *(extra or []))


def arxiv_metadata(entries: DataFrame, *keep: str) -> DataFrame:
    """arXiv record -> 4 fields (P1), plus any ``keep`` key columns."""
    return entries.select(*keep, F.col("entry_id").alias("id"), F.array("category").alias("categories"),
                          "title", "abstract")


def topic_scan(entries: DataFrame, topic: str, max_results: int | None) -> DataFrame:
    """Topic scan, the newest ``max_results`` (S5, T9), all of them for None."""
    rows = entries.where(F.col("category") == topic)
    if max_results is None:
        return rows
    from scriptorium.operators.batching import top_n
    return top_n(rows, max_results, ["-published", "entry_id"])


def with_content(df: DataFrame) -> DataFrame:
    return df.withColumn("content", embedding_content(F.col("title"), F.col("abstract")))


def upsert(existing: DataFrame, incoming: DataFrame, *, keys=("namespace", "id"),
           seq: str = "batch_seq", dim: int | None = None) -> DataFrame:
    """Keyed upsert: the row with the highest ``seq`` wins per key (K2, A4); of rows
    of one ``seq``, the one with the largest hash of all its columns.

    The window is partitioned by the key, so work spreads over all keys; a
    vector of the wrong width fails the job instead of being dropped."""
    rows = existing.unionByName(incoming)
    if dim is not None:
        rows = rows.withColumn("values", F.when(F.size("values") == dim, F.col("values")).otherwise(
            F.raise_error(F.concat(F.lit("vector width differs from "), F.lit(str(dim)))).cast("array<float>")))
    w = Window.partitionBy(*keys).orderBy(F.col(seq).desc(), F.xxhash64(*rows.columns).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_wins(rows: DataFrame, key: str = "paperId", seq: str = "seq") -> DataFrame:
    """Dict build, last row wins (A4): per key, the row with the highest ``seq``.
    ``max_by`` is a partial aggregate, so a hot key is pre-reduced map-side."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_g")).select(key, "_g.*")
