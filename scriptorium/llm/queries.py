"""Registered queries of the operators and their DuckDB statements.

Each ``opN_<name>`` runs its operator with production parameters over its whole table and derives the
digest columns of its contract from the operator's output.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import oracle

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from scriptorium.session import ship_package
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


@register("op1_exact_dedup", oracle.OP1)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.exact_dedup import exact_dedup
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    rows = exact_dedup(docs, carry=[docs["doc_id"], sha])
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op3_pii", oracle.OP3)
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import pii
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = pii.pii_spans(docs, out="_pii").select("doc_id", "_pii")

    def line(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("_pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("_pii", lambda s: s["kind"].isin(*pii.BASE))
    scores = F.array_join(F.transform("_pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return spans.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(line(base), 256).alias("base_sha256"),
                        line(F.col("_pii")).alias("spans"), scores.alias("scores"))


#: Weights of the mix: paths domain, (domain, lang) and (domain, lang, source); any other node has weight 1.
MIX_WEIGHTS = {"web": 3, "reference": 2, ("*", "en"): 4, ("*", "de"): 2, ("*", "fr"): 2, ("web", "en", "src1"): 3}
MIX_EPOCHS = 4


def source_domain(source):
    """Domain of a source by the last digit of its name."""
    last = F.substring(source, -1, 1)
    return F.when(last.between("0", "4"), "web").when(last.between("5", "7"), "reference").otherwise("forum")


@register("op6_mixing", oracle.op6(MIX_WEIGHTS, MIX_EPOCHS))
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.mixing import mix
    docs = table(spark, sf_dir, "documents")
    return mix(docs, source_domain(docs["source"]), MIX_WEIGHTS, max_epochs=MIX_EPOCHS)


@register("op9_chat_format", oracle.op9(512, 2, 1024))
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import chat
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    windows = chat.format_chats(rows.unionByName(extra), budget=512, history=2)
    turns = F.filter(chat.read_back(F.col("formatted")), lambda t: ~t["again"])
    back = windows.select("conv_id", "window", F.length("formatted").alias("chars"), turns.alias("turns"),
                          F.array_join(chat.masked_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    back = back.select("conv_id", "chars", F.size("turns").alias("n"), F.struct(
        "window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"), "loss").alias("w"))
    whole = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("ws"))
    loss = F.array_join("ws.loss", "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join("ws.said", ""), 256).alias("turns_sha256"),
                        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]


@register("op8_url_filter")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.url_filter import judge_urls
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


TOXIC_FROM = 0.3


def held_out(doc_id):
    """Rows whose labels no model sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    from scriptorium.llm import toxicity
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.score(docs, model, out="score")


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@register("op2_near_dedup")
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.near_dedup import near_dedup
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


@register("op7_fingerprint")
def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import fingerprint as fp
    rows = fp.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), fp.packed(F.col("_bins")).alias("fingerprint"),
                       fp.packed(F.col("_edited_bins")).alias("edited_fingerprint"), fp.likeness(F.col("_bins"), F.col("_edited_bins")).alias("near_edited"),
                       fp.likeness(F.col("_bins"), F.col("_next_bins")).alias("near_next"))


@register("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.substring_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


@register("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole document, and the text decoded from them."""
    from scriptorium.llm import pieces
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = pieces.encode_texts(docs, decoded="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.replace(text, F.lit("▁"), F.lit(" "))).alias("round_trip"))


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole document, a tenth of which the contract makes repeat a stretch to their end."""
    from scriptorium.llm import runs
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = runs.periodic_runs(docs, prepare=runs.plant, keep_text=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = rows.withColumn("_best", best)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.s")).alias("start"), F.col("_best.length").alias("length"),
                       (-F.col("_best.p")).alias("period"), F.expr("1000 * _best.length div -_best.p").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")


@register("op13_hard_negatives", oracle.OP13)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.hard_negatives import mine
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(rows["vec_id"] % 7 == 0, (rows["label"] + 1) % 10).otherwise(rows["label"])
    whole = F.transform(rows["embedding"].cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * 256).cast("double")))
    found = mine(rows.select("vec_id", whole.alias("embedding"), label.alias("label")), F.col("id") % 100 == 0)
    return found.withColumns({"positive_score": F.col("positive_score").cast("long"), "negative_score": F.col("negative_score").cast("long")})


@register("op11_quality_rules", oracle.op11(30, 40))
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.quality import quality_rules
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs, carry=[docs["doc_id"]])
