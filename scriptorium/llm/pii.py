"""Personal data spans: patterns propose, checksums confirm, context words adjust the score.

Column expressions only.  Positions come from splitting the text at the matches: the pieces between
matches and the matches themselves, folded once from left to right, give every start and end in code
points.  Patterns are possessive and anchored at run starts, so a long run of digits or letters is
scanned once, not once per start; the matches are those of the plain pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import require_new

_LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> (pattern, a literal every match holds or None, score without context, context words)
KINDS = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write to"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.6, "ip|host|server|address|login"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", None, 0.7, "card|visa|master|payment|credit"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax"),
    "iban": (r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])", None, 0.8, "iban|bank|account|transfer"),
    "ssn": (r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", "-", 0.3, "ssn|social security"),
}
BASE = ("email", "ip", "card", "phone")
#: Characters before a match, back to the previous match of its kind, searched for context words.
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.2
MIN_SCORE = 0.5


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the digit string passes the Luhn check."""
    def add(total, i):
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return total + F.when((F.length(d) - i) % 2 == 1, twice).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether the IBAN (spaces allowed) leaves 1 modulo 97 with its head moved to the end."""
    flat = F.replace(s, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))

    def fold(rest, c):
        x = F.ascii(c)
        return F.when(x < 58, (rest * 10 + x - 48) % 97).otherwise((rest * 100 + x - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), fold) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        def small(part):
            value = F.regexp_replace(part, "^0+", "")
            return (F.length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, "\\."), small)
    if kind == "card":
        return luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of one kind, by start."""
    pattern, literal, score, words = KINDS[kind]
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        near = F.lower(F.right(x["gap"], F.lit(CONTEXT_CHARS))).rlike(words)
        value = F.lit(score) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        keep = confirmed(kind, x["hit"]) if kind in BASE else confirmed(kind, x["hit"]) & (value >= MIN_SCORE)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.round(F.least(value, F.lit(1.0)), 2).alias("score"))
        spans = F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(end.alias("at"), spans.alias("spans")))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    holds = text.contains(literal) if literal else text.rlike("[0-9]{2}" if kind == "iban" else "[0-9]")
    return F.when(holds, found).otherwise(none)


def pii_spans(docs: DataFrame, text_col: str = "text", kinds=tuple(KINDS), out: str = "pii") -> DataFrame:
    """``docs`` with column ``out``: array<struct<kind, start, end, score>>, by kind as listed, then start.

    Offsets are code points, end exclusive.  Null and empty text: an empty array.  Kinds in ``BASE`` stay
    whatever their score; the others need ``MIN_SCORE``, which context words in front can give.  A name in use
    for the new column is refused.
    """
    require_new(docs, out)
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.withColumn(out, F.concat(*[kind_spans(text, k) for k in kinds]))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [KIND]; overlapping spans are merged into the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))

    def step(acc, s):
        new = s["s"] >= acc["at"]
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["s"] - acc["at"]), F.lit("["), F.upper(s["k"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["e"]).alias("at"), F.when(new, put).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
