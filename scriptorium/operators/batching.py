"""Global row numbers and fixed-size minibatches without an unpartitioned window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.session import checkpoint_dir

TARGET_ROWS_PER_BUCKET = 1_000_000


def global_row_number(df: DataFrame, order_key: str, tiebreak: list[str], out: str = "rn") -> DataFrame:
    return _numbered(df, order_key, tiebreak, out)[0]


def _numbered(df: DataFrame, order_key: str, tiebreak: list[str], out: str = "rn") -> tuple[DataFrame, int]:
    """1-based row number in ``(order_key, *tiebreak)`` order.

    ``order_key`` must be a lowercase hex string that is uniform (an md5
    draw).  Two passes: the first 8 hex digits place each row into one of B
    ordered buckets (B sized from the row count); the per-bucket counts are a
    B-row table whose prefix sums are the bucket offsets; ``row_number``
    inside each bucket adds the rest.  No task ever sees more than one
    bucket, and the offset table is the only thing broadcast (B rows, bound
    by the row count / TARGET_ROWS_PER_BUCKET).  The input is checkpointed
    first (reliable checkpoint in the cluster's checkpoint folder), so the
    counting passes do not recompute its lineage."""
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)
    n = df.count()
    buckets = max(1, math.ceil(n / TARGET_ROWS_PER_BUCKET))
    prefix = F.conv(F.substring(order_key, 1, 8), 16, 10).cast("long")
    b = df.withColumn("_bucket", (prefix * F.lit(buckets) / F.lit(1 << 32)).cast("long"))
    counts = b.groupBy("_bucket").count().orderBy("_bucket").collect()
    offsets, acc = [], 0
    for r in counts:
        offsets.append((int(r["_bucket"]), acc))
        acc += int(r["count"])
    spark = df.sparkSession
    off = spark.createDataFrame(offsets, T.StructType([
        T.StructField("_bucket", T.LongType()), T.StructField("_offset", T.LongType())]))
    w = Window.partitionBy("_bucket").orderBy(order_key, *tiebreak)
    return (b.join(F.broadcast(off), "_bucket")
            .withColumn(out, F.col("_offset") + F.row_number().over(w))
            .drop("_bucket", "_offset")), n


def minibatches(df: DataFrame, batch_size: int, order_key: str, tiebreak: list[str],
                drop_last: bool = False) -> DataFrame:
    """Batch id ``(rn - 1) div b``; the one short final batch is kept unless ``drop_last``."""
    numbered, n = _numbered(df, order_key, tiebreak)
    out = numbered.withColumn("batch_id", F.floor((F.col("rn") - 1) / batch_size).cast("long"))
    if drop_last:
        full = (n // batch_size) * batch_size
        out = out.where(F.col("rn") <= full)
    return out


def batch_count(n_rows: int, batch_size: int = 500) -> int:
    """``ceil(count / b)``."""
    return (n_rows + batch_size - 1) // batch_size


#: Rows that one task may merge and sort at the cut, and buckets of a histogram.
EDGE_ROWS, CUT_BUCKETS = 100_000, 1024


def _digits(df: DataFrame, name: str, width: int) -> list[Column]:
    """Whole numbers that, compared one after the other, order the rows as column ``name`` does; null where it is null.

    ``width`` is the longest value in bytes, for strings."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        raw = F.encode(c, "UTF-8")
        parts = [F.conv(F.rpad(F.hex(F.substring(raw, at + 1, 7)), 14, "0"), 16, 10).cast("long") for at in range(0, max(width, 1), 7)]
        return [*parts, F.octet_length(c).cast("long")]
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(c)]
    if isinstance(kind, T.DateType):
        return [F.unix_date(c).cast("long")]
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return [c.cast("long")]
    raise TypeError(f"no exact cut by {name}: {kind.simpleString()}")


def _bounds(bucket: int, width: int) -> tuple[int, int]:
    """Smallest and largest number whose quotient by ``width``, cut off towards 0, is ``bucket``."""
    if bucket > 0:
        return bucket * width, bucket * width + width - 1
    return bucket * width - width + 1, bucket * width if bucket else width - 1


def top_n(df: DataFrame, n: int, order: list[str], edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Exact first ``n`` rows in ``order``, without a sort or a checkpoint of the rows and without a task that merges
    more than ``edge_rows`` of them.

    ``order`` names columns (integers, strings, dates, timestamps; a leading ``-`` for descending) that together tell
    rows apart; nulls come first, last when descending.  Histograms of the first key, partially aggregated to at most
    ``CUT_BUCKETS`` counts, find the bucket in which the n-th row lies, and are refined inside it, then by the next
    key, until it is small.  The rows before it are a plain filter of ``df``, and only that bucket is sorted and cut.
    ``df`` is read once per histogram, its key columns only, and must give the same rows each time."""
    columns = [(k.removeprefix("-"), k.startswith("-")) for k in order]
    sort = [F.desc(f"`{k}`") if down else F.asc(f"`{k}`") for k, down in columns]
    for name, _ in columns:
        _digits(df, name, 0)      # refuses what it cannot order
    scope, head, rest = F.lit(True), F.lit(False), n
    total = None
    for name, down in columns:
        c = F.col(f"`{name}`")
        text = isinstance(df.schema[name].dataType, T.StringType)
        seen = df.where(scope).agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("nulls"),
                                   (F.max(F.octet_length(c)) if text else F.lit(0)).alias("width")).head()
        if total is None:
            total = seen["n"]
            if total <= n:
                return df
        if seen["n"] <= edge_rows:
            break
        if seen["nulls"]:
            first, count = (c.isNotNull(), seen["n"] - seen["nulls"]) if down else (c.isNull(), seen["nulls"])
            if rest <= count:
                scope = scope & first
            else:
                head, rest, scope = head | (scope & first), rest - count, scope & ~first
            if df.where(scope & c.isNotNull()).isEmpty():
                continue          # the n-th row has no value here: the next key decides
        size = None
        for digit in _digits(df, name, seen["width"] or 0):
            digit = -digit if down else digit
            lo, hi = df.where(scope).agg(F.min(digit), F.max(digit)).head()
            while lo < hi and (size is None or size > edge_rows):
                width = -(-(hi - lo + 1) // CUT_BUCKETS)
                bucket = digit if width == 1 else F.call_function("div", digit, F.lit(width).cast("long"))
                counts = df.where(scope).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()   # at most CUT_BUCKETS + 2
                for r in counts:
                    if rest <= r["n"]:
                        break
                    rest -= r["n"]
                head, scope, size = head | (scope & (bucket < r["b"])), scope & (bucket == r["b"]), r["n"]
                lo, hi = (r["b"], r["b"]) if width == 1 else (max(lo, _bounds(r["b"], width)[0]), min(hi, _bounds(r["b"], width)[1]))
            if size is not None and size <= edge_rows:
                break
        if size is not None and size <= edge_rows:
            break
    edge = df.where(scope).orderBy(*sort).limit(rest)
    return df.where(head).unionByName(edge)
