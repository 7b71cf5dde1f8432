"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down the tree domain -> language -> source by weight.  A child that cannot use its
share (its tokens times ``max_epochs``) is filled, and what it leaves goes to its siblings; only what a
whole family cannot use reaches the siblings of its parent.  A leaf takes whole epochs and a token prefix
of one more, in the seeded order of that epoch.

Scale: the tree is a small aggregate.  The prefix of a leaf is cut without sorting the leaf: token sums
per (leaf, bucket of the seeded hash) give the one bucket where the budget ends, and only that bucket
(1 / 4096 of a leaf) is ordered row by row.  Column expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import Scratch

#: Hex digits of the seeded hash that name a bucket.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _weight(weights: dict, cols: list[str]) -> Column:
    """The integer weight of the node named by ``cols``; keys are paths, default 1."""
    out = F.lit(1).cast("long")
    for path, w in weights.items():
        path = (path,) if isinstance(path, str) else tuple(path)
        if len(path) == len(cols):
            test = F.lit(True)
            for c, v in zip(cols, path, strict=True):
                test = test & (F.lit(True) if v == "*" else F.col(c) == v)
            out = F.when(test, F.lit(int(w)).cast("long")).otherwise(out)
    return out


def water_fill(children: DataFrame, family: list[str], name: str) -> DataFrame:
    """``children`` (family columns, ``name``, _w, _cap, _budget of the family) with _alloc.

    Children ordered by capacity per weight are filled while their share reaches their capacity; the
    rest share what is left by weight, rounded down.
    """
    by = Window.partitionBy(*family).orderBy((F.col("_cap") / F.nullif(F.col("_w"), F.lit(0))).asc_nulls_last(), name)
    whole = Window.partitionBy(*family)
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    since = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = children.withColumns({"_r": F.col("_budget") - F.coalesce(F.sum("_cap").over(upto), F.lit(0)), "_ws": F.sum("_w").over(since)})
    out = out.withColumn("_full", (F.col("_w") > 0) & (F.col("_cap") * F.col("_ws") <= F.col("_r") * F.col("_w")))
    out = out.withColumns({"_left": F.col("_budget") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(whole),
                           "_open": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(whole)})
    share = F.expr("_left * _w div nullif(_open, 0)")
    return out.withColumn("_alloc", F.when(F.col("_full"), F.col("_cap")).otherwise(F.coalesce(share, F.lit(0)))) \
              .drop("_r", "_ws", "_full", "_left", "_open")


def mix(docs: DataFrame, domain: Column, weights: dict, budget: int | None = None, max_epochs: int = 4, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
        carry: list | None = None) -> DataFrame:
    """One row per selected copy of a row: id, domain, lang, source, n_tokens, epoch (0-based), then ``carry``.

    ``budget`` tokens (default: the tokens of the whole input) are split by integer ``weights`` (keys: paths of
    one, two or three names, ``*`` for any; default 1).  Null lang, source and domain count as ``''``, null text
    has no tokens.  A leaf's prefix ends with the row that reaches its budget.  Rows with one id share a
    place in the order.  Leaves without tokens and empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    leaf = ["_dom", "_lang", "_src"]
    fill = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("_id"), fill(domain).alias("_dom"), fill(docs[lang_col]).alias("_lang"),
                       fill(docs[source_col]).alias("_src"), word_count(docs[text_col]).alias("_tok"), F.struct(F.lit(0).alias("_"), *(carry or [])).alias("_row"))
    rows = scratch.cut(rows, "rows")
    sums = scratch.cut(rows.groupBy(*leaf).agg(F.sum("_tok").alias("_have")).where("_have > 0"), "leaves")
    # bottom up: what each node can hold
    src = sums.withColumns({"_cap": F.col("_have") * max_epochs, "_w": _weight(weights, leaf)})
    lang = src.groupBy(*leaf[:2]).agg(F.sum("_cap").alias("_cap")).withColumn("_w", _weight(weights, leaf[:2]))
    dom = lang.groupBy(leaf[0]).agg(F.sum("_cap").alias("_cap")).withColumn("_w", _weight(weights, leaf[:1]))
    # top down: what each node gets
    total = F.lit(budget).cast("long") if budget is not None else F.col("_sum")
    root = sums.agg(F.sum("_have").alias("_sum")).select(F.lit(0).alias("_all"), total.alias("_budget"))
    dom = water_fill(dom.withColumn("_all", F.lit(0)).join(root, "_all"), ["_all"], "_dom")
    lang = water_fill(lang.join(dom.select("_dom", F.col("_alloc").alias("_budget")), "_dom"), ["_dom"], "_lang")
    src = water_fill(src.join(lang.select("_dom", "_lang", F.col("_alloc").alias("_budget")), leaf[:2]), leaf[:2], "_src")
    plan = src.select(*leaf, F.expr("_alloc div _have").alias("_full"), F.expr("_alloc % _have").alias("_rest"))
    plan = scratch.cut(plan, "plan")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("_full").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    keyed = rows.join(plan, leaf).withColumn("_key", order).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    # the bucket where the rest of a leaf's budget ends
    buckets = keyed.where("_rest > 0").groupBy(*leaf, "_rest", "_bucket").agg(F.sum("_tok").alias("_sum"))
    before = Window.partitionBy(*leaf).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where("_before < _rest")
    cuts = buckets.groupBy(*leaf).agg(F.max(F.struct("_bucket", "_before")).alias("_cut"))
    plan = scratch.cut(plan.join(cuts, leaf, "left"), "cuts")
    keyed = rows.join(plan, leaf).withColumn("_key", order).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    edge = keyed.where(F.col("_bucket") == F.col("_cut._bucket"))
    upto = Window.partitionBy(*leaf).orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_in", F.col("_cut._before") + F.coalesce(F.sum("_tok").over(upto), F.lit(0)) < F.col("_rest"))
    other = keyed.where(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut._bucket")))
    other = other.withColumn("_in", F.coalesce(F.col("_bucket") < F.col("_cut._bucket"), F.lit(False)))
    copies = edge.union(other).withColumn("_n", F.col("_full") + F.col("_in").cast("long")).where("_n > 0")
    return copies.select(F.col("_id").alias(id_col), F.col("_dom").alias("domain"), F.col("_lang").alias("lang"), F.col("_src").alias("source"),
                         F.col("_tok").alias("n_tokens"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("epoch"),
                         *[F.col("_row")[f].alias(f) for f in rows.schema["_row"].dataType.names[1:]])
