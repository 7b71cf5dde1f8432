"""Periodic runs of words by seeds on diagonals.

A run is a maximal stretch of words with smallest period q and length >= max(min_length, 2q).  On the
diagonal of lag q (word i against word i + q) it is a stretch of matches of max(min_length - q, q) words at
least.  Lags are taken by classes [2b, 4b); such a stretch then holds a whole block of b words that starts at
a multiple of b, the guaranteed overlap.  Per class the b-grams of a document are indexed, every aligned block
is paired with the occurrences of its b-gram at the lags of the class, and of the seeds of one lag only the
first beyond the furthest covered word is extended: seeds b apart continue one another, so a chain of them is
one stretch, extended by less than b words at both its ends.

b-grams are named exactly (a pair of names of half the length gets a name), no hash decides.  A document's
words that do not repeat are left out from the first level on, so ordinary text costs two sorts.  Blocks inside
a known run of a period up to b are skipped: there any run of a lag of the class has a smaller period, and a
long run of one word would otherwise pair each of its blocks with all others.  That leaves O(n) pairs a class
and O(n log n) in all, however repetitive the text.

One Arrow pass, no shuffle; a task holds about a megabyte of texts at a time, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.kernels import by_bytes

#: Pairs expanded at once.
CHUNK = 1 << 20


def name_pairs(first: np.ndarray, second: np.ndarray, at: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the pairs (first, second < base) found at positions ``at``: an array of n names, equal where pairs are
    equal and repeated, distinct and negative elsewhere; and the positions of repeated pairs."""
    names = -1 - np.arange(n, dtype=np.int64)
    key = first * np.int64(base) + second
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group, minlength=1)
    often = size[group] > 1
    where = at[order[often]]
    names[where] = group[often]
    return names, np.sort(where)


def longer(names: np.ndarray, step_names: np.ndarray, active: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the grams that join a gram of ``names`` with the one of ``step_names`` ``step`` words on."""
    n = len(names)
    at = active[active + step < n]
    at = at[step_names[at + step] >= 0]
    return name_pairs(names[at], step_names[at + step], at, n, n)


def match_length(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, limit: int, back: bool) -> np.ndarray:
    """Matching words from i and j on (or before them, going back), up to ``limit`` - 1."""
    n = len(levels[0])
    done = np.zeros(len(i), np.int64)
    top = max(limit - 1, 1).bit_length() - 1
    for level in range(min(top, len(levels) - 1), -1, -1):
        width = 1 << level
        x, y = (i - done - width, j - done - width) if back else (i + done, j + done)
        inside = (x >= 0) & (y + width <= n)
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        done += width * (inside & (levels[level][x] == levels[level][y]) & (levels[level][x] >= 0))
    return done


def seeds(names: np.ndarray, active: np.ndarray, width: int, low: int, high: int, inside: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, lag) of the aligned blocks of ``width`` words and the equal grams ``low`` to ``high`` - 1 words on."""
    n = np.int64(len(names) + high + 1)
    index = np.sort(names[active] * n + active)
    block = active[active % width == 0]
    block = block[~inside(block, block + high + width)]
    base = names[block] * n + block
    first, last = np.searchsorted(index, base + low), np.searchsorted(index, base + high)
    ends = np.cumsum(last - first)
    start = 0
    while start < len(block):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        per = (last - first)[start:stop]
        i = np.repeat(block[start:stop], per)
        at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first[start:stop], per)
        lag = index[at] % n - i
        new = ~inside(i, i + lag + width)
        yield i[new], lag[new]
        start = stop


def find(ids: np.ndarray, doc: np.ndarray, min_length: int = 12) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period.  ``ids`` are the words' numbers, ``doc`` the
    documents' numbers, word by word; a run never spans two documents."""
    if min_length < 2:
        raise ValueError("a run has two words at least")
    n = len(ids)
    found = np.zeros((0, 3), np.int64)
    if n < min_length:
        return found
    longest = int(np.bincount(doc).max())
    names, active = name_pairs(doc.astype(np.int64), ids.astype(np.int64), np.arange(n), n, int(ids.max()) + 1)
    levels = [names]
    known: list[np.ndarray] = []  # per class its runs, by start

    def inside(period: int) -> Callable:
        """Whether [i, j) lies in a known run of a period up to ``period``."""
        runs = [r[r[:, 2] <= period] for r in known]
        runs = [r for r in runs if len(r)]

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.zeros(len(i), bool)
            for r in runs:
                # the furthest end of the runs that start at or before i
                far = np.maximum.accumulate(r[:, 1])
                at = np.searchsorted(r[:, 0], i, "right") - 1
                out |= (at >= 0) & (far[np.maximum(at, 0)] >= j)
            return out
        return test

    # the first class has lags 1 to 7; its shortest stretch holds an aligned block of half its length
    low, high = 1, 8
    width = min(3, (min(max(min_length - q, q) for q in range(low, high)) + 1) // 2)
    cur, cur_active = longer(names, names, active, 1)
    levels.append(cur)
    grams, act = [(names, active), (cur, cur_active), longer(cur, names, cur_active, 2)][width - 1]
    while True:
        parts = [(i, q) for i, q in seeds(grams, act, width, low, high, inside(width))]
        if parts:
            i, q = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(i):
                order = np.lexsort((i, q))
                i, q = i[order], q[order]
                # furthest covered word of the lag: a seed that starts there belongs to the stretch before it
                new = np.ones(len(i), bool)
                new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1] + width)
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(i)) - 1
                start, lag = i[head], q[head]
                end = i[tail] + width
                start = start - match_length(levels, start, start + lag, width, True)
                end = end + match_length(levels, end, end + lag, width, False)
                long = end - start + lag >= np.maximum(min_length, 2 * lag)
                found = np.concatenate((found, np.stack((start, end + lag, lag), 1)[long]))
                # of one stretch the smallest period counts
                found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
                first = np.ones(len(found), bool)
                first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
                found = found[first]
                known = [found[(found[:, 2] >= a) & (found[:, 2] < 2 * a)] for a in 1 << np.arange(max(1, int(high).bit_length()))]
        # next class: b = 4, 8, 16, ..., lags from 2b to 4b - 1
        if high == 8:
            width = 4
            cur, cur_active = longer(cur, cur, cur_active, 2)
        else:
            cur, cur_active = longer(cur, cur, cur_active, width)
            width *= 2
        low, high = 2 * width, 4 * width
        if not len(cur_active) or 2 * low > longest:
            break
        levels.append(cur)
        grams, act = cur, cur_active
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(texts: list[list[bytes]], min_length: int = 12) -> list[np.ndarray]:
    """Per text (its words) the rows (start, length, period) of its runs."""
    memo: dict[bytes, int] = {}
    ids = np.array([memo.setdefault(w, len(memo)) for words in texts for w in words], np.int64)
    per = np.array([len(words) for words in texts])
    found = find(ids, np.repeat(np.arange(len(texts)), per), min_length)
    offsets = np.cumsum(per) - per
    cut = np.searchsorted(found[:, 0], np.append(offsets, len(ids)))
    out = []
    for k, offset in enumerate(offsets):
        rows = found[cut[k]:cut[k + 1]]
        out.append(np.stack((rows[:, 0] - offset, rows[:, 1] - rows[:, 0], rows[:, 2]), 1))
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 12,
                  prepare: Callable | None = None, keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_words, runs (array of start, length, period in words, by start,
    then period), runs_sha256, collapsed_sha256 and, with ``keep_text``, collapsed (the text without the repeated
    periods, its words joined by one space).

    Words are runs of anything but ASCII white space.  Null, empty and blank texts have no words and no runs and
    collapse to the empty text; equal rows give equal rows; an empty table gives none.  Only the two columns are
    read, so others cannot clash.  ``prepare(id, words)`` may change a text's words (bytes) first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, runs_sha256 string, collapsed_sha256 string"
    schema += ", collapsed string" if keep_text else ""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1).cast(pa.binary())]
            for first, part in by_bytes(raw):
                ids = batch.column(0).slice(first, len(part))
                words = [t.split() for t in part]  # ASCII white space
                if prepare:
                    words = [prepare(i, w) for i, w in zip(ids.to_pylist(), words, strict=True)]
                found = runs_of(words, min_length)
                said = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r.tolist()).encode()).hexdigest() for r in found]
                flat = [b" ".join(collapse(w, r)) for w, r in zip(words, found, strict=True)]
                all_runs = np.concatenate(found)
                ends = pa.array(np.cumsum([0] + [len(r) for r in found]), pa.int32())
                structs = pa.StructArray.from_arrays([pa.array(all_runs[:, k]) for k in range(3)], fields=list(run))
                cols = [ids, pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(ends, structs),
                        pa.array(said), pa.array([hashlib.sha256(x).hexdigest() for x in flat])]
                names = ["id", "n_words", "runs", "runs_sha256", "collapsed_sha256"]
                if keep_text:
                    cols.append(pa.array(flat, pa.binary()).cast(pa.string()))
                    names.append("collapsed")
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(task, schema).withColumnRenamed("id", id_col)


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The registered query's planted repeats: a tenth of the documents repeat a stretch to their end."""
    import zlib
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]
