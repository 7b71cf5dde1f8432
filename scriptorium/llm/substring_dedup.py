"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

The suffixes of all texts are sorted only as deep as the threshold (``DEPTH`` bytes), by most significant
digit first: a pass splits every group of suffixes by its next digit, a group of one leaves, and groups
that are equal through the whole depth are exactly the repeated windows.

One row per suffix and pass would move the corpus many times over, so suffixes travel in runs.  The first
digit of a window is its minimizer: the ``GRAM`` bytes of smallest hash in it (the leftmost of equals),
which depends on the window alone, so equal windows have it at the same offset.  Neighbouring windows share
their minimizer and form one run, about one row for seventy suffixes.  The passes:

1. digit = the minimizer.  Runs of a group that are equal from end to end are repeated whole; a group of
   one run is dropped; other runs go on.
2. digit = the bytes shared by all windows of an aligned block of ``BLOCK`` window starts.  As before.
3. digit = the whole window.  Groups of two or more are repeated.

Digits are compared by 64-bit hashes (runs and windows by two independent ones).  Texts are read again in
passes 2 and 3 only where a run goes on, and once per distinct text.

Scale: every pass is an aggregation with partial aggregates and a join against a written table, so a
passage shared by a third of all rows is counted map-side and its rows are split by the adaptive skew join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import kernels as K
from scriptorium.llm.common import Scratch

DEPTH, GRAM, BLOCK = 200, 64, 8
SPAN = DEPTH - GRAM + 1
#: Window starts handled at once; a longer text is handled in overlapping segments.
SEGMENT = 1 << 19
BASE2 = np.uint64(0xD1B54A32D192ED03)
_gen = np.random.default_rng(4)
BYTE1 = _gen.integers(0, 1 << 64, 256, dtype=np.uint64)
BYTE2 = _gen.integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = _powers[int(base)] = K.powers(max(n, 1 << 20), base)
    return have[:n]


class Hashes:
    """Hashes of any substring of a byte buffer."""

    def __init__(self, buf: np.ndarray, base: np.uint64 = K.BASE, byte: np.ndarray = BYTE1):
        self.total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(byte[buf] * _pow(base, len(buf)), out=self.total[1:])
        self.back = _pow(K.inverse(base), len(buf) + 1)

    def of(self, start, end) -> np.ndarray:
        return K.mix((self.total[end] - self.total[start]) * self.back[start])


def window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` neighbours."""
    n = len(v)
    pad = -n % w
    blocks = np.concatenate((v, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def _segments(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) so that every window of the text lies in one segment, in window order."""
    for at in range(0, max(1, len(text) - DEPTH + 1), SEGMENT):
        yield at, text[at:at + SEGMENT + DEPTH - 1]


def _runs(buf: np.ndarray, ends: np.ndarray) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first window start, windows, minimizer position) of every run in texts laid end to end."""
    h = Hashes(buf)
    grams = h.of(np.arange(len(buf) - GRAM + 1), np.arange(GRAM, len(buf) + 1))
    low = np.uint64((1 << int(len(buf)).bit_length()) - 1)
    least = window_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), SPAN) & low  # position by (hash, position)
    start = np.arange(len(least))
    text_end = ends[np.searchsorted(ends, start, "right")]
    valid = start + DEPTH <= text_end
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    return h, first, stop - first, least[first].astype(np.int64)


def _encode(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return at.astype(np.int64) * 256 + n


def _raw(column) -> list[bytes]:
    return [t.as_py() or b"" for t in column]


def _row(g, s, key, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(s.view(np.int64)), pa.array(key, pa.int64()), pa.array(at, pa.int64())], ["g", "s", "key", "at"])


def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of every text, keyed by their minimizer."""
    for b in batches:
        keys = b.column("key").to_numpy()
        parts = [(k, off, seg) for k, t in zip(keys, _raw(b.column("text")), strict=True) if len(t) >= DEPTH for off, seg in _segments(t)]
        for at, group in K.by_bytes([p[2] for p in parts]):
            ends = np.cumsum([len(x) for x in group])
            h, first, n, mini = _runs(np.frombuffer(b"".join(group), np.uint8), ends)
            text = np.searchsorted(ends, first, "right")
            begin = np.concatenate(([0], ends[:-1]))
            offset = np.array([p[1] for p in parts[at:at + len(group)]])
            owner = np.array([p[0] for p in parts[at:at + len(group)]], np.int64)
            s = K.mix(h.of(first, first + n - 1 + DEPTH) + (mini - first).astype(np.uint64) * K.WORD_MUL[0] + n.astype(np.uint64) * K.WORD_MUL[1])
            yield _row(h.of(mini, mini + GRAM), s, owner[text], _encode(first - begin[text] + offset[text], n))


def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the runs that go on (column ``runs``), keyed by the bytes all their windows share."""
    for b in batches:
        for key, raw, runs in zip(b.column("key").to_pylist(), _raw(b.column("text")), b.column("runs"), strict=True):
            want = np.unique(runs.values.to_numpy())
            for off, seg in _segments(raw):
                buf = np.frombuffer(seg, np.uint8)
                h, first, n, mini = _runs(buf, np.array([len(buf)]))
                take = np.isin(_encode(first + off, n), want)
                first, n, mini = first[take], n[take], mini[take]
                if not len(first):
                    continue
                low, high = (mini - (first + n - 1)) // BLOCK, (mini - first) // BLOCK
                per = high - low + 1
                run = np.repeat(np.arange(len(first)), per)
                j = np.arange(len(run)) - np.repeat(np.cumsum(per) - per, per) + low[run]
                q = mini[run]
                x = np.maximum(q - BLOCK * j - BLOCK + 1, first[run])
                z = np.minimum(q - BLOCK * j, first[run] + n[run] - 1)
                core = q - BLOCK * j
                g = K.mix(h.of(core, core - BLOCK + 1 + DEPTH) + j.astype(np.uint64) * K.WORD_MUL[2])
                s = K.mix(h.of(x, z + DEPTH) + (q - x).astype(np.uint64) * K.WORD_MUL[0] + (z - x).astype(np.uint64) * K.WORD_MUL[1])
                yield _row(g, s, np.full(len(x), key), _encode(x + off, z - x + 1))


def third_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows of the blocks that go on, keyed by their bytes."""
    for b in batches:
        for key, raw, runs in zip(b.column("key").to_pylist(), _raw(b.column("text")), b.column("runs"), strict=True):
            want = np.unique(runs.values.to_numpy())
            at, n = want // 256, want % 256
            p = np.unique(np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            for off, seg in _segments(raw):
                mine = p[(p >= off) & (p < off + SEGMENT)] - off
                if len(mine):
                    buf = np.frombuffer(seg, np.uint8)
                    yield _row(Hashes(buf).of(mine, mine + DEPTH), Hashes(buf, BASE2, BYTE2).of(mine, mine + DEPTH), np.full(len(mine), key), _encode(mine + off, 1))


def cut_out(raw: bytes, runs: np.ndarray, copies: int) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal removed runs) of a text, given its runs of repeated windows."""
    if len(raw) < DEPTH or not (copies > 1 or len(runs)):
        return raw, 0, 0
    if copies > 1:
        return b"", len(raw), 1
    edge = np.zeros(len(raw) + 1, np.int32)
    at, n = runs // 256, runs % 256
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n - 1 + DEPTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def last_pass(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"key": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept_text": []}
            for key, raw, copies, runs in zip(b.column("key").to_pylist(), _raw(b.column("text")), b.column("copies").to_pylist(), b.column("runs"), strict=True):
                kept, removed, spans = cut_out(raw, np.array(runs.as_py() or [], np.int64), copies)
                for c, x in zip(out, (key, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    out[c].append(x)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept_text (binary).

    A byte goes if a ``DEPTH``-byte string covering it starts at another place too, in the same text or any other;
    strings are judged on the input.  Texts are UTF-8 bytes, null counts as empty; texts under ``DEPTH`` bytes lose
    nothing.  Rows with equal texts (also repeated rows) are copies of each other.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8")
    src = docs.select(docs[id_col].alias("id"), F.xxhash64(text, F.length(text)).alias("key"), text.alias("text"))
    schema = "g bigint, s bigint, key bigint, at bigint"

    def release() -> None:
        """Let the cleaner remove shuffle files of finished passes."""
        docs.sparkSession._jvm.System.gc()

    def split(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(key, at) of the rows equal to another one from end to end; (key, at) of those that go on."""
        rows = scratch.cut(rows, f"{name}-rows")
        groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("a"), F.max("s").alias("z")).where("n > 1")
        groups = scratch.cut(groups.select("g", (F.col("a") != F.col("z")).alias("mixed")), f"{name}-groups")
        rows = scratch.cut(rows.join(groups, "g"), f"{name}-shared")
        scratch.drop(f"{name}-rows", f"{name}-groups")
        runs = rows.groupBy("g", "s").agg(F.count(F.lit(1)).alias("c"), F.first("key").alias("k1"), F.first("at").alias("a1"), F.first("mixed").alias("mixed"))
        runs = scratch.cut(runs, f"{name}-runs")
        equal = rows.join(runs.where("c > 1").select("g", "s"), ["g", "s"], "left_semi").select("key", "at").distinct()
        equal = scratch.cut(equal, f"{name}-equal")
        scratch.drop(f"{name}-shared")
        release()
        return equal, runs.where("mixed").select(F.col("k1").alias("key"), F.col("a1").alias("at"))

    def texts(runs: DataFrame, how: str) -> DataFrame:
        """Distinct texts with their copies and the array ``runs`` of their key."""
        per = scratch.cut(runs.groupBy("key").agg(F.collect_list("at").alias("runs")), "lists")
        once = src.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        return once.join(per.hint("shuffle_hash"), "key", how)

    equal1, on1 = split(src.select("key", "text").mapInArrow(first_pass, schema), "first")
    equal2, on2 = split(texts(on1, "inner").select("key", "text", "runs").mapInArrow(second_pass, schema), "second")
    windows = scratch.cut(texts(on2, "inner").select("key", "text", "runs").mapInArrow(third_pass, schema), "third")
    twice = scratch.cut(windows.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "s"), "third-equal")
    equal3 = windows.join(twice, ["g", "s"], "left_semi").select("key", "at")
    found = scratch.cut(equal1.union(equal2).union(equal3), "found")
    release()
    done = texts(found, "left").select("key", "text", "copies", "runs")
    done = scratch.cut(done.mapInArrow(last_pass(keep_text), "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text binary"), "done")
    out = src.select(F.col("id").alias(id_col), "key").join(done, "key")
    return out.select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else []))
