"""Chat formatting in budgeted windows with a loss mask, and reading it back.

A turn is written ``### role: text</turn>`` and a line end; a turn repeated from an earlier window is
written ``##+ role: ...``.  Inside roles and texts ``\\``, ``</turn>`` and ``##`` are escaped as ``\\\\``,
``\\e`` and ``\\h`` (a role's ``:`` as ``\\c``), so no text can hold a control string and every text is
read back exactly.

Windows hold whole turns; a turn's tokens are its words plus a constant for the markup.  Prefix sums of the tokens
choose the spans: a window takes its first new turn, the conversation's leading system turn if that fits, as many
of the ``history`` turns before it as fit, the nearest first, and then new turns while they fit.  So all turns of a
window, repeated ones too, stay within the budget; a turn over it is alone in its window.  Repeated turns carry
no loss.

Scale: prefix sums are taken in two levels, over blocks of turn numbers and inside a block, so a very
long conversation is spread over tasks; a window does not cross a block of positions, which are packed
on lists of token counts alone.  Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import SPACE, Scratch

NEW, AGAIN, END = "### ", "##+ ", "</turn>\n"
TOKENS_PER_TURN = 4
#: Turn numbers per block of the two-level prefix sum.
BLOCK = 1024


def escape(s: Column) -> Column:
    for plain, coded in (("\\", "\\\\"), ("</turn>", "\\e"), ("##", "\\h")):
        s = F.replace(s, F.lit(plain), F.lit(coded))
    return s


def unescape(s: Column) -> Column:
    def part(p):
        for plain, coded in ((":", "\\c"), ("##", "\\h"), ("</turn>", "\\e")):
            p = F.replace(p, F.lit(coded), F.lit(plain))
        return p
    return F.array_join(F.transform(F.split(s, r"\\\\", -1), part), "\\")


def turn_tokens(text: Column) -> Column:
    return (F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")) + TOKENS_PER_TURN).cast("long")


def _line(t) -> Column:
    role = F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c"))
    return F.concat(F.when(t["again"], F.lit(AGAIN)).otherwise(F.lit(NEW)), role, F.lit(": "))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", budget: int = 512, history: int = 2) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss_mask array<struct<start, end>> (code points).

    Rows of a conversation are ordered by turn, then role, then text (repeated rows stay, each a turn).
    Null role and text count as empty; a null conversation is a conversation of its own.  A window's number is the
    position of its first new turn.  The mask covers the texts of new assistant turns.  An empty table gives no rows.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    rows = turns.select(turns[conv_col].alias("conv"), turns[turn_col].cast("long").alias("turn"),
                        F.coalesce(turns[role_col], F.lit("")).alias("role"), F.coalesce(turns[text_col], F.lit("")).alias("text"))
    rows = rows.withColumns({"tok": turn_tokens(F.col("text")), "block": F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60)))})
    per = rows.groupBy("conv", "block").agg(F.sum("tok").alias("btok"), F.count(F.lit(1)).alias("bn"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("conv").alias("pc"), F.col("block").alias("pb"), F.coalesce(F.sum("btok").over(before), F.lit(0)).alias("tok0"),
                     F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"pos": F.row_number().over(inside), "cum": F.sum("tok").over(upto) - F.col("tok")})
    rows = rows.join(per, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("block") == F.col("pb")))
    rows = rows.select("conv", (F.col("pos") + F.col("n0")).cast("long").alias("pos"), "tok", (F.col("cum") + F.col("tok0")).alias("cum"), "role", "text")
    rows = scratch.cut(rows, "turns")
    parts = rows.join(_packed(rows, budget, history), F.col("conv").eqNullSafe(F.col("wc")) & (F.col("pos") == F.col("wp")))
    parts = parts.select("conv", "window", F.struct("pos", (F.col("pos") < F.col("window")).alias("again"), "role", "text").alias("t"))
    windows = parts.groupBy("conv", "window").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def add(acc, t):
        start = acc["at"] + F.length(_line(t))
        end = start + F.length(escape(t["text"]))
        target = ~t["again"] & (t["role"] == "assistant")
        mask = F.when(target, F.concat(acc["mask"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["mask"])
        return F.struct((end + len(END)).alias("at"), mask.alias("mask"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return windows.select(
        F.col("conv").alias("conv_id"), "window",
        F.array_join(F.transform("ts", lambda t: F.concat(_line(t), escape(t["text"]), F.lit(END))), "").alias("formatted"),
        F.aggregate("ts", F.struct(F.lit(0).alias("at"), none.alias("mask")), add, lambda acc: acc["mask"]).alias("loss_mask"))


def _packed(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """(wc, window, wp): the positions of every window, named by the position of its first new turn.

    A block of positions is a list of (pos, tok, cum) with the ``history`` turns in front of it; no window holds
    more turns than a block."""
    size = max(BLOCK, budget // TOKENS_PER_TURN)
    block = lambda pos: F.floor(pos / size)
    at = F.explode(F.sequence(block(F.col("pos") - 1), block(F.col("pos") - 1 + history))).alias("blk")
    blocks = rows.select("conv", at, F.struct("pos", "tok", "cum").alias("t")).groupBy("conv", "blk").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    system = rows.where("pos = 1 and role = 'system'").select(F.col("conv").alias("sc"), F.col("tok").alias("sys"))
    blocks = blocks.join(system, F.col("conv").eqNullSafe(F.col("sc")), "left")

    def opened(t, i):
        """What a window holds that starts with this turn."""
        lead = F.coalesce((t["pos"] > 1) & (F.col("sys") + t["tok"] <= budget), F.lit(False))
        used = t["tok"] + F.when(lead, F.col("sys")).otherwise(0)
        near = F.slice("ts", F.greatest(i - history, F.lit(0)) + 1, F.least(i, F.lit(history)))
        near = F.filter(near, lambda h: (t["cum"] - h["cum"] + used <= budget) & ~((h["pos"] == 1) & F.col("sys").isNotNull()))
        return F.struct(t["pos"].alias("pos"), t["tok"].alias("tok"), lead.alias("lead"), F.size(near).cast("long").alias("back"),
                        (used + F.coalesce(t["cum"] - F.get(near, F.lit(0))["cum"], F.lit(0))).alias("used"))

    def add(acc, t):
        fits = (F.size(acc["ws"]) > 0) & (acc["used"] + t["tok"] <= budget)
        new = F.concat(acc["ws"], F.array(F.struct(t["pos"].alias("p"), (t["pos"] - t["back"]).alias("first"), t["lead"].alias("lead"))))
        return F.struct(F.when(fits, acc["used"] + t["tok"]).otherwise(t["used"]).alias("used"), F.when(fits, acc["ws"]).otherwise(new).alias("ws"))

    none = F.array().cast("array<struct<p:bigint,first:bigint,lead:boolean>>")
    blocks = blocks.select("conv", "blk", F.transform("ts", opened).alias("ts")).select(
        "conv", F.element_at("ts", -1)["pos"].alias("last"), F.filter("ts", lambda t: t["pos"] > F.col("blk") * size).alias("own"))
    blocks = blocks.select("conv", "last", F.aggregate("own", F.struct(F.lit(0).cast("long").alias("used"), none.alias("ws")), add, lambda acc: acc["ws"]).alias("ws"))
    spans = blocks.select("conv", F.explode(F.transform("ws", lambda w, i: F.struct(
        w["p"].alias("p"), w["first"].alias("first"), w["lead"].alias("lead"),
        F.coalesce(F.get("ws", i + 1)["p"] - 1, F.col("last")).alias("last")))).alias("w"))
    span = F.sequence("w.first", "w.last")
    return spans.select(F.col("conv").alias("wc"), F.col("w.p").alias("window"),
                        F.explode(F.when(F.col("w.lead"), F.concat(F.array(F.lit(1).cast("long")), span)).otherwise(span)).alias("wp"))


def read_back(formatted: Column) -> Column:
    """array<struct<again, role, text>> of one window, parsed from its formatted text."""
    blocks = F.split(formatted, "</turn>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(b):
        at = F.instr(b, ":")
        return F.struct(b.startswith(AGAIN).alias("again"), unescape(F.substring(b, F.lit(len(NEW) + 1), at - len(NEW) - 1)).alias("role"),
                        unescape(F.substring(b, at + 2, F.length(b))).alias("text"))
    return F.transform(blocks, turn)


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, in order."""
    return F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["end"] - m["start"])))
