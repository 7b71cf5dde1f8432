"""Quality rules by distribution divergence.

Two histograms of a document, its character classes and its common words, are compared with those of its
language by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1).  The references are
counted over all documents of the language.  Few words make any histogram uneven, so the squared limit is widened
by bins / (4 x words), and a document or a language below a minimum length gets no verdict by this rule.

Column expressions only, two scans of the table.  The first gives a language's word counts (partially aggregated;
the most frequent are a bounded top list, pruned in every partition before the exchange) and class counts.  The
second joins each text with its language's one narrow row; the texts themselves are not shuffled while there are
few languages (checked).  Repeats of three words are found in the row: windows are sorted and neighbours compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import Scratch

BLANK = " \t\n\x0b\f\r"
#: Character classes, taken out of the text one after another; what is left are other symbols.
CLASSES = {"lower": "[a-z]+", "space": "[\\x20\\x09-\\x0D]+", "upper": "[A-Z]+", "punct": "[.,;:!?'\"()-]+", "digit": "[0-9]+", "foreign": "[^\\x00-\\x7F]+"}
MARKS = "[#*$%&|<>]+"
#: Common words per language, as written, and the longest that counts as one; none holds a comma.
COMMON = 30
WORD_CHARS = 40
#: Bits of a window's key that hold its position; longer texts compare all their windows.
PLACE_BITS = 24
#: Languages whose references are broadcast (about 2 KB each).
BROADCAST_LANGUAGES = 4096


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def class_counts(rows: DataFrame, text: str, out: str, marks: str) -> DataFrame:
    """``rows`` with ``out`` (characters by class, in the order of CLASSES, then the rest) and ``marks`` (of MARKS)."""
    counts, rest = [], text
    for k, pattern in enumerate(CLASSES.values()):
        rows = rows.withColumn(f"_t{k}", F.regexp_replace(rest, pattern, ""))
        counts.append(F.length(rest) - F.length(f"_t{k}"))
        rest = f"_t{k}"
    rows = rows.withColumns({out: F.transform(F.array(*counts, F.length(rest)), lambda c: c.cast("long")),
                             marks: (F.length(rest) - F.length(F.regexp_replace(rest, MARKS, ""))).cast("long")})
    return rows.drop(*[f"_t{k}" for k in range(len(CLASSES))])


def repeat_words(rows: DataFrame, words: str, out: str) -> DataFrame:
    """``rows`` with ``out``: words in windows of three that are found twice or more in the text.

    Windows that may repeat are found by sorting numbers, each the high bits of a window's hash with its position;
    few are left, and these are compared word by word."""
    w = lambda i: F.get(F.col(words), i)
    n = F.size(words)
    place = F.lit((1 << PLACE_BITS) - 1).cast("long")
    key = lambda i: F.xxhash64(w(i), w(i + 1), w(i + 2)).bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("long"))
    at = F.sequence(F.lit(0), n - 3)
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("_keys", F.sort_array(F.when((n >= 3) & (n < 1 << PLACE_BITS), F.transform(at, key)).otherwise(none)))
    each = lambda k: F.get(F.col("_keys"), k)
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_keys") - 2, F.lit(0))), lambda k: F.shiftright(each(k), PLACE_BITS) == F.shiftright(each(k + 1), PLACE_BITS))
    rows = rows.withColumn("_pairs", pairs)
    twins = F.array_distinct(F.concat(F.transform("_pairs", each), F.transform("_pairs", lambda k: each(k + 1))))
    places = F.when(n < 1 << PLACE_BITS, F.transform(twins, lambda x: x.bitwiseAND(place).cast("int"))).otherwise(at)
    rows = rows.withColumn("_places", places).drop("_keys", "_pairs")
    rows = rows.withColumn("_grams", F.array_sort(F.transform("_places", lambda i: F.struct(F.concat_ws(" ", w(i), w(i + 1), w(i + 2)).alias("g"), i.alias("i")))))
    g = lambda k: F.get(F.col("_grams"), k)["g"]
    twice = F.filter("_grams", lambda x, k: F.coalesce((k > 0) & (g(k - 1) == x["g"]), F.lit(False)) | F.coalesce(g(k + 1) == x["g"], F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    total = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    return rows.withColumn(out, total).drop("_grams", "_places")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")


def references(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """Per language (``lang``, null counts as ''): ``top``, its COMMON most frequent words, ``listed``, the same joined by commas, ``words``, their counts and
    the count of all others, and ``chars``, its characters by class.  Languages with fewer words have none."""
    words = docs.select("lang", F.explode_outer(words_of(F.col("text"))).alias("w")).where("w is not null")
    counts = words.groupBy("lang", F.when((F.length("w") <= WORD_CHARS) & ~F.contains("w", F.lit(",")), F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    counts = scratch.cut(counts, "words")  # read twice
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    top = counts.where("w is not null").withColumn("k", place).where(F.col("k") <= COMMON)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "w", "n"))).alias("t"))  # COMMON rows a language
    whole = counts.groupBy("lang").agg(F.sum("n").alias("all")).where(F.col("all") >= min_words)
    rest = F.col("all") - F.aggregate("t.n", F.lit(0).cast("long"), lambda a, x: a + x)
    classes = class_counts(docs.select("lang", "text"), "text", "c", "m").select("lang", *[F.get("c", F.lit(k)).alias(f"c{k}") for k in range(len(CLASSES) + 1)])
    classes = classes.groupBy("lang").agg(F.array(*[F.sum(f"c{k}") for k in range(len(CLASSES) + 1)]).alias("chars"))
    return top.join(whole, "lang").join(classes, "lang").select("lang", F.col("t.w").alias("top"), F.array_join("t.w", ",").alias("listed"), F.concat("t.n", F.array(rest)).alias("words"), "chars")


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two arrays of counts; null if either is empty."""
    total = lambda a: F.greatest(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.lit(0.1))

    def part(x: Column, y: Column) -> Column:
        return (F.when(x > 0, x * F.ln(x / ((x + y) / 2))).otherwise(0.0) + F.when(y > 0, y * F.ln(y / ((x + y) / 2))).otherwise(0.0)) / 2

    def add(acc: Column, s: Column) -> Column:
        bits = acc["bits"] + part(s["p"] / acc["np"], s["q"] / acc["nq"])
        return F.struct(acc["np"].alias("np"), acc["nq"].alias("nq"), bits.alias("bits"))
    pairs = F.zip_with(p, q, lambda x, y: F.struct(x.alias("p"), y.alias("q")))
    bits = F.aggregate(pairs, F.struct(total(p).alias("np"), total(q).alias("nq"), F.lit(0.0).alias("bits")), add,
                       lambda acc: F.when((acc["np"] >= 1) & (acc["nq"] >= 1), acc["bits"]))
    return F.greatest(bits / F.ln(F.lit(2.0)), bits * 0)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", carry: list | None = None, max_chars: float = 0.25,
                  max_words: float = 0.22, min_words: int = 50, min_reference: int = 2000, max_repeat: int = 50) -> DataFrame:
    """``carry`` columns (default: all) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    char_distance, word_distance and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat`` percent of the words in repeated windows.
    kept: neither that nor a distance over its limit.  A distance is null, and so no reason to drop, where the document
    or the language (``min_reference``) is too short.  Null text counts as empty: no words, base_failed.
    A null language is a language of its own.  Repeated rows are rows like any other and count in the references; an
    empty table gives no rows; the input's columns may have any name.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    carry = [docs[c] for c in docs.columns] if carry is None else list(carry)
    source = docs.select(F.struct(*carry).alias("_row"), F.coalesce(docs[lang_col], F.lit("")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    refs = scratch.cut(references(source.select("lang", "text"), min_reference, scratch), "references")
    scratch.drop("words")
    if refs.count() <= BROADCAST_LANGUAGES:
        refs = F.broadcast(refs)
    rows = source.join(refs.withColumnsRenamed({"words": "_ref_words", "chars": "_ref_chars", "top": "_top", "listed": "_set"}), "lang", "left")
    rows = class_counts(rows, "text", "_chars", "n_symbols")
    rows = rows.withColumns({"_words": words_of(F.col("text")), "_lines": lines_of(F.col("text"))})
    # one character a word: its place among the common words, counted by what is left without it
    # (no common word holds a comma)
    code = lambda x: F.char(F.find_in_set(x, F.col("_set")) + ord("0"))
    rows = rows.withColumn("_codes", F.when(F.col("_top").isNotNull(), F.array_join(F.transform("_words", code), "")))
    rows = repeat_words(rows, "_words", "n_repeat_words")
    rows = rows.withColumns({"n_words": F.size("_words").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                             "word_chars": (F.length("text") - F.get("_chars", F.lit(1))).cast("long")})
    n = F.length("_codes")
    hits = [(n - F.length(F.replace("_codes", F.lit(chr(ord("0") + k)), F.lit("")))).cast("long") for k in range(1, COMMON + 1)]
    rows = rows.withColumns({"_hits": F.slice(F.array(*hits), 1, F.size("_top")), "_n": n.cast("long")})
    rows = rows.withColumn("_counts", F.concat("_hits", F.array(F.col("_n") - F.aggregate("_hits", F.lit(0).cast("long"), lambda a, x: a + x))))
    rows = rows.withColumns({"_cd": F.when(F.col("n_words") >= min_words, divergence(F.col("_chars"), F.col("_ref_chars"))),
                             "_wd": F.when(F.col("_n") >= min_words, divergence(F.col("_counts"), F.col("_ref_words")))})
    chars_over = F.col("_cd") > max_chars ** 2 + (len(CLASSES) + 1) / (4 * F.col("n_words"))
    words_over = F.col("_wd") > max_words ** 2 + F.size("_counts") / (4 * F.col("_n"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "kept": ~(failed | F.coalesce(chars_over, F.lit(False)) | F.coalesce(words_over, F.lit(False)))})
    return rows.select("_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       F.round(F.sqrt("_cd"), 5).alias("char_distance"), F.round(F.sqrt("_wd"), 5).alias("word_distance"), "kept")
