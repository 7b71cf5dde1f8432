"""Exact dedup by distributed MSD radix partitioning.

Texts are split by successive bytes: pass k takes the next ``width`` bytes of every text that
still shares a group with another one, and a group is split by (group, digit, ended).  A group
of one row is a unique text; a group whose texts ended is a group of equal texts.  No digest
decides equality, the bytes themselves do.  The digit widens from pass to pass, so a text of n
bytes takes O(log n) passes and unique texts leave after the first.

Scale: a pass is one count per group (partial aggregation, so a hot group costs one row per
map task) and one join back.  Group tables are written before the join, so both join sides are
plain exchanges and a hot group's rows are split over tasks by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import Scratch


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list | None = None,
                first_width: int = 64, growth: int = 16) -> DataFrame:
    """One row per row of ``docs``: its ``carry`` columns (default: all) with keep_id, group_size, kept.

    Null text counts as empty; empty texts are one group of equal texts.  Of equal texts the row with
    the largest id stays (null is the smallest); of rows that repeat that id too, one stays.  An empty
    table gives no rows.  ``carry`` may hold columns or expressions; their names are left as they are.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    carry = [docs[c] for c in docs.columns] if carry is None else list(carry)
    active = docs.select(F.struct(*carry).alias("_row"), docs[id_col].alias("_id"), F.lit(0).cast("long").alias("_g"),
                         F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8").alias("_b"))
    done, offset, width, step = [], 0, first_width, 0
    while True:
        digit = F.substring("_b", offset + 1, width)
        ended = F.length("_b") <= offset + width
        keyed = active.withColumns({"_d": digit, "_end": ended})
        groups = (keyed.groupBy("_g", "_d", "_end").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep"))
                  .where("_n > 1").withColumn("_to", F.monotonically_increasing_id()))
        groups = scratch.cut(groups, f"groups{step}")
        split = keyed.join(groups.hint("shuffle_hash"), ["_g", "_d", "_end"], "left")
        over = F.col("_n").isNull() | F.col("_end")
        split = scratch.cut(split.select("_row", "_id", F.coalesce("_to", F.lit(0)).alias("_g"), F.when(~over, F.col("_b")).alias("_b"),
                                         "_n", "_keep", over.alias("_over")), f"rows{step}")
        done.append(split.where("_over").select("_row", "_id", F.lit(step).alias("_pass"), "_g", "_n", "_keep"))
        if groups.where("not _end").isEmpty():
            break
        active = split.where("not _over").select("_row", "_id", "_g", "_b")
        offset, width, step = offset + width, width * growth, step + 1
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    # rows that hold the kept id of their group: one, unless whole rows repeat
    holds = F.col("_n").isNotNull() & F.col("_id").eqNullSafe(F.col("_keep"))
    first = F.row_number().over(Window.partitionBy("_pass", "_g").orderBy("_id")) == 1
    kept = rows.where(holds).withColumn("_kept", first).union(rows.where(~holds).withColumn("_kept", F.col("_n").isNull()))
    return kept.select("_row.*", F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
                       F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"), F.col("_kept").alias("kept"))
