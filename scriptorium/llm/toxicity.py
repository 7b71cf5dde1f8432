"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the set of hashed terms of the whole text: words
and their 4- and 5-letter heads, so that inflected forms share a term.  The pairwise part learns
combinations (an insult with a group mention) that no sum of single weights can express.

Training takes a bounded sample of labelled rows (``sample_rows`` per class, the smallest by a hash of the
id), weighted back to the class counts of all labelled rows.  Their terms are counted by class and cut to the
``max_terms`` most telling ones in Spark; the driver gets, per row, the numbers of those it holds, and fits with
numpy, so its memory is bounded by rows and terms whatever the texts' lengths.  Scoring is one scan: Arrow
batches, no shuffle, whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, map_rows, require_new

_WORD = re.compile(r"[^\W\d_]+")
#: Words kept in a worker's memory with their terms; beyond it the memory is emptied.
MEMO = 400_000
#: Characters of a text looked at at once.
PIECE = 1 << 20


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a lower-cased word: itself and its heads, in separate hash spaces."""
    raw = word.encode()
    out = [zlib.crc32(raw, 1)]
    if len(word) > 4:
        out.append(zlib.crc32(word[:4].encode(), 4))
    if len(word) > 5:
        out.append(zlib.crc32(word[:5].encode(), 5))
    return tuple(out)


def words(text: str | None) -> set[str]:
    """Distinct lower-cased words, found in bounded pieces of the text that end where a word does."""
    out: set[str] = set()
    at, size = 0, len(text or "")
    while at < size:
        end = min(at + PIECE, size)
        while end < size and text[end - 1].isalnum():
            end += 1
        out.update(_WORD.findall(text[at:end].lower()))
        at = end
    return out


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    bias: float
    w: np.ndarray
    v: np.ndarray  # terms x rank

    def raw(self, idx: np.ndarray) -> float:
        if not len(idx):
            return self.bias
        v = self.v[idx]
        s = v.sum(0)
        return float(self.bias + self.w[idx].sum() + 0.5 * (s @ s - (v * v).sum()))


def fit(terms: np.ndarray, lists: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rank: int = 4, epochs: int = 12,
        min_steps: int = 2000, rate: float = 0.2, decay: float = 1e-4, seed: int = 7) -> Model:
    """Logistic FM by Adagrad over rows of distinct indices into ``terms``.

    Few rows are passed over more often, for ``min_steps`` batches at least.  Without rows of both classes the model
    is the prior alone."""
    pos, neg = float((weight * (y == 1)).sum()), float((weight * (y == 0)).sum())
    bias = float(np.log((pos + 0.5) / (neg + 0.5)))
    if not pos or not neg:
        return Model(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, rank)))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), rank))
    gw, gv, gb = np.full(len(terms), 1e-6), np.full((len(terms), rank), 1e-6), 1e-6
    scale = weight / weight.mean()
    batches = max(1, len(lists) // 64)
    for _ in range(max(epochs, min_steps // batches)):
        for part in np.array_split(rng.permutation(len(lists)), batches):
            own = np.repeat(np.arange(len(part)), [len(lists[i]) for i in part])
            ix = np.concatenate([lists[i] for i in part]).astype(np.int64) if len(part) else np.zeros(0, np.int64)
            s = np.zeros((len(part), rank))
            np.add.at(s, own, v[ix])
            sq = np.bincount(own, (v[ix] ** 2).sum(1), len(part))
            z = bias + np.bincount(own, w[ix], len(part)) + 0.5 * ((s * s).sum(1) - sq)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * scale[part] / len(part)
            g = np.bincount(ix, err[own], len(terms)) + decay * w
            h = np.zeros_like(v)
            np.add.at(h, ix, err[own, None] * (s[own] - v[ix]))
            h += decay * v
            gw += g * g
            gv += h * h
            gb += err.sum() ** 2
            w -= rate * g / np.sqrt(gw)
            v -= 0.3 * rate * h / np.sqrt(gv)
            bias -= rate * err.sum() / np.sqrt(gb)
    return Model(terms, bias, w, v)


def sample_labelled(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(_id, _y, _terms) of at most ``sample_rows`` labelled rows a class, and the labelled rows of each class.

    An id is one row however often it repeats in ``docs``: the one with the smallest hash of its text."""
    marked = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("_id")
    picked = [marked.where(F.col("_y") == c).orderBy(order, "_id").limit(sample_rows) for c in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # at most 2 x sample_rows narrow rows
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(chosen, "_id")
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t"))).alias("_one")  # partially aggregated
    rows = rows.groupBy("_id", "_y").agg(one).select("_id", "_y", F.col("_one.t").alias("_text"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted({h for x in words(t) for h in word_terms(x)}) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(terms, pa.list_(pa.int64()))], ["_id", "_y", "_terms"])

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, _y int, _terms array<bigint>"
    return rows.mapInArrow(featurize, schema), counts


def telling_terms(rows: DataFrame, per: dict[int, float], n: int, max_terms: int, min_rows: int, min_chi: float) -> np.ndarray:
    """The terms, at most ``max_terms``, with the largest chi-square against the label, weighted by class; terms in fewer
    than ``min_rows`` rows or under ``min_chi`` are left out.  Counted and cut in Spark: only these reach the driver."""
    counts = rows.select("_y", F.explode("_terms").alias("t")).groupBy("t").agg(F.count_if(F.col("_y") == 1).alias("c1"), F.count_if(F.col("_y") == 0).alias("c0"))
    pos, neg = per[1] * n[1], per[0] * n[0]
    n1, n0, all_rows = F.col("c1") * per[1], F.col("c0") * per[0], pos + neg
    shrink = (n[0] + n[1]) / all_rows  # to the rows seen
    miss = F.greatest(all_rows - n1 - n0, F.lit(1.0))
    chi = shrink * all_rows * F.pow(n1 * neg - n0 * pos, 2) / (pos * neg * (n1 + n0) * miss)
    best = counts.where(F.col("c0") + F.col("c1") >= min_rows).select("t", chi.alias("chi")).where(F.col("chi") >= min_chi)
    best = best.orderBy(F.desc("chi"), "t").limit(max_terms).select("t").toArrow()
    return np.sort(best["t"].to_numpy().astype(np.int64))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_terms: int = 4096, min_rows: int = 3, min_chi: float = 15.0, **fit_args) -> Model:
    """A model from the rows of ``labels`` (others' labels must be taken out by the caller).

    Labels other than 0 and 1 and null ids are left out; an id labelled twice counts once, toxic if once so, and an
    id with several rows in ``docs`` gives one of them."""
    rows, counts = sample_labelled(docs, labels, sample_rows, id_col, text_col, label_col)
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.cut(rows, "terms")
    n = {0: 0, 1: 0} | {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = {c: counts.get(c, 0) / max(1, n[c]) for c in n}
    terms = telling_terms(rows, per, n, max_terms, min_rows, min_chi) if n[0] and n[1] else np.zeros(0, np.int64)

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.flatnonzero(np.isin(terms, x.values.to_numpy(), assume_unique=True)).astype(np.int16) for x in b.column("_terms")]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), pa.array(own, pa.list_(pa.int16()))], ["_id", "_y", "_own"])

    # at most 2 x sample_rows lists of at most max_terms numbers, whatever the texts' lengths
    got = rows.mapInArrow(indices, f"_id {rows.schema['_id'].dataType.simpleString()}, _y int, _own array<smallint>").toArrow().sort_by([("_id", "ascending")])
    scratch.close()
    y, own = got.column("_y").to_numpy(), got.column("_own").combine_chunks()
    values, ends = own.values.to_numpy(), own.offsets.to_numpy()
    lists = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return fit(terms, lists, y, np.array([per[int(c)] for c in y], float), **fit_args)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with ``out``: the toxicity of the whole text, 0 to 1; null and empty texts get the score of no terms.
    A name in use for the new column is refused."""
    require_new(docs, out)
    schema = docs.select("*", F.lit(0.0).alias(out)).schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(h): i for i, h in enumerate(model.terms)}
        memo: dict[str, tuple[int, ...]] = {}
        for b in batches:
            raw = np.empty(b.num_rows)
            for r, text in enumerate(b.column(at)):
                idx = set()
                for x in words(text.as_py()):
                    hit = memo.get(x)
                    if hit is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        hit = memo[x] = tuple(place[h] for h in word_terms(x) if h in place)
                    if hit:
                        idx.update(hit)
                raw[r] = model.raw(np.fromiter(sorted(idx), np.int64, len(idx)))
            prob = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prob)], names=[*b.schema.names, f"c{b.num_columns}"])

    return map_rows(docs, run, schema)
