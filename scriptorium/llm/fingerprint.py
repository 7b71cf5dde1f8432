"""Document fingerprints by one-permutation MinHash.

Every word shingle of a text is hashed once; the top bits of the hash name one of ``BINS`` bins and each bin
keeps its smallest hash.  An empty bin takes the value of the filled bin that comes first in its own fixed
random order of bins (optimal densification: the order depends on the bin alone, so two texts agree on it).
The fingerprint packs the low ``BITS`` bits of every bin; likeness is the share of equal bins, corrected for
chance agreement.  Column expressions only, one pass over the text, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import SPACE, Scratch

BINS, BITS, WIDTH = 128, 8, 5
_SHIFT = 64 - BINS.bit_length() + 1


def shingle_hashes(text: Column) -> Column:
    """Hashes of the 5-word shingles of a text (the whole sequence where there are fewer words)."""
    words = F.transform(F.filter(F.split(F.lower(text), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))

    def run(w):
        n = F.size(w)
        rolled = F.transform(F.sequence(F.lit(1), n - (WIDTH - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(WIDTH)]))
        return F.when(n >= WIDTH, rolled).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.array(words), run)[0]


def fingerprint_bins(text: Column) -> Column:
    """array<tinyint>: the low bits of the ``BINS`` densified bins less 128; empty for a text without words."""
    bin_of = lambda h: F.shiftrightunsigned(h, _SHIFT).cast("int")
    flip = lambda h: h.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  signed order becomes unsigned order

    def densify(h):
        # h: sorted (unsigned) hashes; the first of each bin is its minimum
        firsts = F.filter(h, lambda x, i: (i == 0) | (bin_of(flip(x)) != bin_of(flip(F.element_at(h, F.greatest(i, F.lit(1)))))))
        return F.transform(F.array(firsts), fill)[0]

    def fill(firsts):
        ids = F.transform(firsts, lambda x: bin_of(flip(x)))
        low = F.transform(firsts, lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)))
        return F.transform(F.array(F.struct(ids.alias("ids"), F.arrays_zip(ids.alias("id"), low.alias("low")).alias("full"))), spread)[0]

    def spread(v):
        # an empty bin takes the filled bin that comes first in its own random order of bins
        rank = lambda j, f: F.shiftleft(F.shiftrightunsigned(F.xxhash64(j, f["id"]), BITS + 1), BITS).bitwiseOR(f["low"])
        borrow = lambda j: F.array_min(F.transform(v["full"], lambda f: rank(j, f))).bitwiseAND(F.lit((1 << BITS) - 1))
        place = lambda j: F.array_position(v["ids"], j).cast("int")
        own = lambda j: F.when(place(j) > 0, F.element_at(v["full"], F.greatest(place(j), F.lit(1)))["low"]).otherwise(borrow(j))
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: own(j).cast("int"))

    hashes = F.transform(shingle_hashes(text), lambda x: flip(x))
    out = F.transform(F.array(F.sort_array(hashes)), lambda h: F.when(F.size(h) > 0, densify(h)).otherwise(F.array().cast("array<int>")))
    # one signed byte a bin
    return F.transform(out[0], lambda b: (b - F.lit(1 << (BITS - 1))).cast("tinyint"))


def packed(bins: Column) -> Column:
    """The bins as a hex string, two digits each."""
    return F.array_join(F.transform(bins, lambda b: F.lpad(F.lower(F.hex(b.cast("int") + (1 << (BITS - 1)))), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints' bins, 0 to 1; two empty ones are alike, one empty is not."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / BINS
    chance = 2.0 ** -BITS
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0) \
        .otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def with_next(rows: DataFrame, id_col: str, text_col: str, more: dict[str, Column], scratch: Scratch, parts: int) -> DataFrame:
    """``rows`` and the columns ``more``, with struct ``_next`` of text and ``more`` of the following row by (id, text), the first after the last.

    Rows are dealt to ranges of the id; inside a range a window finds the following row, and the last row of a
    range takes the first of the next one.  No task sees more than a range.  Range heads are found by id first
    and fetched after, one row a range, so the texts are moved once.
    """
    key = F.col(id_col)
    cuts = rows.where(key.isNotNull()).approxQuantile(id_col, [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    at = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(c).cast("bigint") for c in sorted(set(cuts))])
        at = F.coalesce(F.size(F.filter(bounds, lambda c: c < key)), F.lit(0))
    ranged = rows.withColumn("_part", at)
    lows = ranged.groupBy(F.col("_part").alias("_of")).agg(F.min(F.struct(id_col)).alias("_low"))  # at most ``parts`` narrow rows
    heads = ranged.join(F.broadcast(lows), (F.col("_part") == F.col("_of")) & key.eqNullSafe(F.col(f"_low.{id_col}")))
    heads = heads.groupBy("_part").agg(F.min(text_col).alias(text_col)).withColumns(more)
    heads = scratch.cut(heads.select("_part", F.struct(text_col, *more).alias("_head")), "heads")
    order = Window.partitionBy(F.lit(0)).orderBy("_part")  # range numbers only
    follow = heads.select(F.col("_part").alias("_of"), F.coalesce(F.lead("_part").over(order), F.min("_part").over(Window.partitionBy(F.lit(0)))).alias("_part"))
    heads = scratch.cut(heads.join(follow, "_part").select(F.col("_of").alias("_part"), "_head"), "next-heads")
    inside = Window.partitionBy("_part").orderBy(key.asc_nulls_first(), text_col)
    out = ranged.withColumns(more).withColumn("_lead", F.lead(F.struct(text_col, *more)).over(inside)).join(heads, "_part")
    return out.withColumn("_next", F.coalesce("_lead", "_head")).drop("_lead", "_head", "_part")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_text, fingerprint bins of the text, of the edited text and of the
    next text (``_bins``, ``_edited_bins``, ``_next_bins``).

    The edited text drops the last floor(n_chars / 2) code points and takes as many from the start of the next
    text in ascending id order (null ids first, then by text), the first after the last.  Null text counts as
    empty.  A table of one row is its own next row; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint")
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    rows = with_next(rows, "_id", "_text", {"_bins": fingerprint_bins(F.col("_text"))}, scratch, parts)
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring(F.col("_next._text"), F.lit(1), half))
    rows = rows.select(F.col("_id").alias(id_col), n.cast("long").alias("n_chars"), edited.alias("edited_text"), "_bins", F.col("_next._bins").alias("_next_bins"))
    return rows.withColumn("_edited_bins", fingerprint_bins(F.col("edited_text")))
