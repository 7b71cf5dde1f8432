"""URL filter: rules by host and path, gradient-boosted trees on lexical features for the rest.

The trees are trained on labelled URLs (here: those a rule decides), at most ``sample_rows`` distinct ones, the
smallest by a hash of the URL, each with its number of rows as weight.  Features: lengths, path depth, digit ratio, character entropy, parameter
count, and the block rate and count of the host's suffix over all labelled URLs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_suffix_rate", "f_suffix_n"]


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; rules are (verdict, host, path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(s: Column) -> Column:
    """Shannon entropy in bits of the characters."""
    chars = F.array_sort(F.filter(F.split(s, ""), lambda c: c != ""))
    n = F.length(s)
    runs = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(n > 0, F.aggregate(runs, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def lexical(rows: DataFrame, url: str = "_url", host: str = "_host", path: str = "_path") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    query = F.regexp_extract(u, "\\?([^#]*)", 1)
    return rows.withColumns({
        "f_len": n.cast("double"), "f_host_len": F.length(host).cast("double"), "f_path_len": F.length(path).cast("double"),
        "f_depth": F.regexp_count(F.col(path), F.lit("/[^/]")).cast("double"), "f_labels": F.regexp_count(F.col(host), F.lit("[^.]+")).cast("double"),
        "f_digits": F.coalesce(F.length(F.regexp_replace(u, "[^0-9]", "")) / F.nullif(n, F.lit(0)), F.lit(0.0)).cast("double"),
        "f_entropy": entropy(F.col(host)), "f_params": F.when(F.length(query) > 0, F.regexp_count(query, F.lit("&")) + 1).otherwise(0).cast("double"),
        "_suffix": F.regexp_extract(F.col(host), "[^.]*$", 0)})


def sample_urls(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """(_label, _weight, features) of at most ``sample_rows`` distinct URLs, of both labels where both are seen.

    Rows of one URL are one, weighted by their number.  Where the smallest hashes hold one label only, either label
    gives half of the sample, weighted back to its rows."""
    scratch = Scratch(labelled.sparkSession, "urls")
    urls = labelled.groupBy("_url").agg(F.count(F.lit(1)).cast("double").alias("_weight"), F.first("_label").alias("_label"),
                                        *[F.first(f).alias(f) for f in FEATURES])
    order = [F.xxhash64("_url"), F.col("_url")]
    sample = scratch.cut(urls.orderBy(*order).limit(sample_rows), "sample")
    if sample.select("_label").distinct().count() < 2:
        halves = [urls.where(F.col("_label") == c).orderBy(*order).limit(max(1, sample_rows // 2)) for c in (0, 1)]
        sample = scratch.cut(halves[0].union(halves[1]), "halves")
        rows = {r["_label"]: r["n"] for r in labelled.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
        held = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.sum("_weight").alias("n")).collect()}
        back = F.when(F.col("_label") == 1, rows.get(1.0, 0) / held.get(1.0, 1)).otherwise(rows.get(0.0, 0) / held.get(0.0, 1))
        sample = sample.withColumn("_weight", F.col("_weight") * back)
    return sample.select("_label", "_weight", *FEATURES)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
               sample_rows: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 11) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, block_score.

    A null url, or one without ``://``, has empty host and path and no rule.  A rule's verdict stands; else the
    trees' (block at a probability of 0.5 or more).  Without labelled URLs of both kinds the only kind seen is the
    verdict, allow if none.  Repeated rows are judged each; an empty table gives no rows.
    """
    rows = pages.select(pages[id_col].alias("_id"), pages[url_col].alias("_url"))
    rows = rows.withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    rows = lexical(rows.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules)))
    label = (F.col("_rule.verdict") == "block").cast("double")
    stats = rows.where("_rule is not null").groupBy("_suffix").agg(F.sum(label).alias("_blocks"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(stats, "_suffix", "left")
    n = F.coalesce("_n", F.lit(0))
    seen = {r["v"]: r["n"] for r in rows.where("_rule is not null").groupBy(F.col("_rule.verdict").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
    base = seen.get("block", 0) / max(1, sum(seen.values()))  # suffix rates are smoothed towards it
    rows = rows.withColumns({"f_suffix_rate": (F.coalesce("_blocks", F.lit(0.0)) + 2 * base) / (n + 2), "f_suffix_n": F.log1p(n)})
    if len(seen) == 2:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
        sample = sample_urls(rows.where("_rule is not null").select("_url", label.alias("_label"), *FEATURES), sample_rows)
        sample = assemble.transform(sample.repartition(4)).select("_label", "_weight", "_features")
        model = GBTClassifier(labelCol="_label", featuresCol="_features", weightCol="_weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(sample)
        model.setProbabilityCol("_prob").setRawPredictionCol("_raw").setPredictionCol("_pred")
        rows = model.transform(assemble.transform(rows)).withColumn("block_score", vector_to_array("_prob")[1])
    else:
        rows = rows.withColumn("block_score", F.lit(1.0 if "block" in seen else 0.0))
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return rows.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.rule").alias("rule"),
                       F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "block_score")
