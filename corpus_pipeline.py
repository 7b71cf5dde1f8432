"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, tokenisation of ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns they were given.  ``run`` writes each stage's rows to the shared folder and reads them for the next.

Any table with doc_id, text, lang and source will do; more columns, whatever their names, are carried along.  Null
texts count as empty: they have the toxicity of no words, are equal to empty texts, have no near duplicates, take up
no budget of the mix (they are copied as their leaf's epochs are) and have no ids.  A null doc_id is the smallest of
its group.  Rows repeated whole are one document after the exact stage.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import queries as q
from scriptorium.llm.common import Scratch, scratch_closed, unused
from scriptorium.llm.exact_dedup import exact_dedup
from scriptorium.llm.mixing import mix
from scriptorium.llm.near_dedup import near_dedup, text_key
from scriptorium.llm.pieces import encode_texts


def whole(docs: DataFrame):
    """The row as one value, which no column's name can clash with."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity under the threshold; the model learns from the labels that are not held out."""
    from scriptorium.llm import toxicity
    labels = q.table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~q.held_out(F.col("doc_id"))))
    out = unused(docs, "toxicity")
    scored = toxicity.score(docs, model, out=out)
    return scored.where(F.col(out) < q.TOXIC_FROM).drop(out)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup(docs, carry=[whole(docs)]).where("kept").select("_doc.*")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    kept = near_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    rows = docs.select(whole(docs), docs["doc_id"].alias("_own"), text_key(docs["text"]).alias("_text"))
    return rows.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_semi").select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, shared out by the weights; a document of a repeated epoch is a row per epoch."""
    rows = mix(docs, q.source_domain(docs["source"]), q.MIX_WEIGHTS, max_epochs=q.MIX_EPOCHS, carry=[whole(docs)])
    return rows.select("_doc.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    rows = encode_texts(docs.select("doc_id", "text"), decoded="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == text).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("sentencepiece", tokenise)]

#: Two stages are a trained model and an encoder, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.session import ship_package
    ship_package(spark)
    scratch = Scratch(spark, "pipeline")
    docs, before = q.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_closed():  # the stage's own tables; what it kept is written
            docs = scratch.cut(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
