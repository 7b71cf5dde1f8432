"""Exact k-nearest-neighbour join (Euclidean or cosine).

A Euclidean top-k is a non-equi join; written as a join it would be a nested
loop that materialises every (query, vector) pair.  Here the corpus is never
shuffled and no pair is ever emitted that cannot be in the answer:

* **broadcast plan** (query block of checked size): the query matrix is
  broadcast once; ``mapInArrow`` scans each corpus partition in Arrow
  batches, computes distances as one matrix product per batch and keeps a
  running partial top-k per query.  Each partition emits at most Q*k rows,
  so the shuffle into the final ``row_number() <= k`` window is
  O(partitions * Q * k), not proportional to the vectors.
* **blocked plan** (query side too large to broadcast): queries are hashed
  into B blocks and the corpus into C blocks; each query row is sent to the
  C corpus blocks of its query block and each vector to the B query blocks
  of its corpus block, so every (query block, corpus block) cell is one
  bounded cogroup that emits its partial top-k.

Distances are recomputed exactly (direct differences, in double) for the
candidates picked by the fast matrix-product pass, rounded to ``decimals``,
and ties are broken by the corpus id, so the answer is deterministic and
independent of partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_BROADCAST_BYTES = 64 << 20
_PAIR_BUDGET = 4_000_000  # doubles per distance tile
FIRST, TILE = 256, 10_000  # corpus rows of the first tile and of the largest


def _arrow_type(dt: T.DataType) -> pa.DataType:
    mapping = {
        T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(),
        T.ShortType: pa.int16(), T.DoubleType: pa.float64(),
    }
    for k, v in mapping.items():
        if isinstance(dt, k):
            return v
    raise TypeError(f"unsupported id type {dt}")


def _round_half_up(x: np.ndarray, decimals: int) -> np.ndarray:
    m = 10.0 ** decimals
    return np.floor(x * m + 0.5) / m


def topk_block(qids: np.ndarray, Q: np.ndarray, ids: np.ndarray, X: np.ndarray, k: int,
               metric: str = "l2", exclude_self: bool = False, decimals: int = 5):
    """Top-k of every query row of ``Q`` against the vectors ``X``.

    Returns (query_index, corpus_index, distance) arrays with at most k rows
    per query, ordered by (distance rounded to ``decimals``, id).
    """
    nq, n = Q.shape[0], X.shape[0]
    if nq == 0 or n == 0:
        e = np.empty(0, dtype=np.int64)
        return e, e, np.empty(0)
    Qd = Q.astype(np.float64, copy=False)
    Xd = X.astype(np.float64, copy=False)
    qn2 = np.einsum("ij,ij->i", Qd, Qd)
    xn2 = np.einsum("ij,ij->i", Xd, Xd)
    if metric == "cosine":
        qn = np.sqrt(qn2)
        xn = np.sqrt(xn2)
    kk = min(k, n)
    slack = 10.0 ** (-decimals) * 2
    eps = np.finfo(np.float64).eps
    out_q, out_c, out_d = [], [], []
    step = max(1, _PAIR_BUDGET // n)
    for s in range(0, nq, step):
        qs = slice(s, min(nq, s + step))
        dot = Qd[qs] @ Xd.T
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            if metric == "l2":
                # rounding error of q2 + x2 - 2qx, which grows with the norms and the width
                err = 4 * eps * Qd.shape[1] * (qn2[qs, None] + xn2[None, :])
                d2 = np.maximum(qn2[qs, None] + xn2[None, :] - 2.0 * dot, 0.0)
                high = np.sqrt(d2 + err)
                low = np.sqrt(np.maximum(d2 - err, 0.0))
            elif metric == "cosine":
                high = 1.0 - dot / (qn[qs, None] * xn[None, :]) + 1e-9
                low = high - 2e-9
            else:
                raise ValueError(f"unknown metric {metric!r}")
        # pairs without a distance (NaN, or a zero vector under cosine) take no part
        out = ~np.isfinite(high)
        if exclude_self:
            out |= qids[qs, None] == ids[None, :]
        high = np.where(out, np.inf, high)
        # the k-th smallest upper bound: whatever lies below it for sure or may lie below it is a candidate
        kth = np.partition(high, kk - 1, axis=1)[:, kk - 1]
        keep = ~out & (low <= kth[:, None] + slack)
        rows, cols = np.nonzero(keep)
        rows = rows + s
        if rows.size == 0:
            continue
        exact = np.empty(rows.size)
        for p in range(0, rows.size, 100_000):
            r, c = rows[p:p + 100_000], cols[p:p + 100_000]
            if metric == "l2":
                diff = Qd[r] - Xd[c]
                exact[p:p + r.size] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            else:
                exact[p:p + r.size] = 1.0 - np.einsum("ij,ij->i", Qd[r], Xd[c]) / (qn[r] * xn[c])
        out_q.append(rows)
        out_c.append(cols)
        out_d.append(_round_half_up(exact, decimals))
    if not out_q:
        e = np.empty(0, dtype=np.int64)
        return e, e, np.empty(0)
    q_idx = np.concatenate(out_q)
    c_idx = np.concatenate(out_c)
    dist = np.concatenate(out_d)
    return _prune(q_idx, c_idx, dist, ids, k)


class Nearest:
    """Running top-k of the queries over tiles of the corpus, Euclidean.

    A tile costs one product in single precision and one comparison a pair:
    with rows (q, 1) and (-2x, x2) the product is the squared distance less
    q2, and a pair is looked at again, in doubles, only if that lies below the
    query's k-th distance so far, with the rounding error of the product added
    to it.  The first tile, and vectors that single precision cannot hold or
    tell apart, go through ``topk_block``."""

    def __init__(self, qids: np.ndarray, Q: np.ndarray, k: int, exclude_self: bool, decimals: int):
        self.qids, self.Q, self.k, self.exclude_self, self.decimals = qids, Q.astype(np.float64, copy=False), k, exclude_self, decimals
        self.n2 = np.einsum("ij,ij->i", self.Q, self.Q)
        with np.errstate(over="ignore", invalid="ignore"):
            self.Q1 = np.hstack([self.Q, np.ones((len(Q), 1))]).astype(np.float32)
        self.kth, self.seen = np.full(len(Q), np.inf), 0
        self.rows = (np.empty(0, dtype=np.int64), np.empty(0, dtype=qids.dtype), np.empty(0))     # query, id, distance

    def _add(self, q, ids, d) -> None:
        if not len(q):
            return
        q, ids, d = (np.concatenate([a.astype(b.dtype), b]) for a, b in zip(self.rows, (q, ids, d)))
        q, c, d = _prune(q, np.arange(len(q)), d, ids, self.k)
        self.rows = q, ids[c], d
        full = np.flatnonzero(np.bincount(q, minlength=len(self.Q)) == self.k)
        self.kth[full] = d[np.searchsorted(q, full, "right") - 1]

    def add(self, ids: np.ndarray, X: np.ndarray) -> None:
        at = 0
        while at < len(ids):      # as many rows as were seen before, so that the bounds follow the rows
            to = at + min(max(self.seen, FIRST), TILE)
            self._tile(ids[at:to], X[at:to].astype(np.float64, copy=False))
            self.seen += len(ids[at:to])
            at = to

    def _tile(self, ids: np.ndarray, X: np.ndarray) -> None:
        x2 = np.einsum("ij,ij->i", X, X)
        sound = x2 < 1e30                     # not NaN either
        if not sound.all():
            self._plain(np.arange(len(self.Q)), ids[~sound], X[~sound])
            ids, X, x2 = ids[sound], X[sound], x2[sound]
        if not len(ids):
            return
        X1 = np.hstack([-2.0 * X, x2[:, None]]).astype(np.float32).T.copy()
        # a product sums up to 2 |q| |x| + x2 at most, and so to q2 + 2 x2
        error = (X.shape[1] + 8) * 2.0 * np.finfo(np.float32).eps * (self.n2 + 2.0 * float(x2.max()))
        with np.errstate(over="ignore", invalid="ignore"):
            bound = (self.kth + 2 * 10.0 ** (-self.decimals)) ** 2 - self.n2 + error
        fast = np.isfinite(bound) & (self.n2 < 1e30)
        plain, new = [np.flatnonzero(~fast)], []
        todo, step = np.flatnonzero(fast), max(1, _PAIR_BUDGET // len(ids))
        for s in range(0, len(todo), step):
            at = todo[s:s + step]
            near = (self.Q1[at] @ X1) <= np.nextafter(bound[at].astype(np.float32), np.float32(np.inf))[:, None]
            if np.count_nonzero(near) > near.size // 16 + len(at) * self.k:      # single precision doesn't tell these apart
                plain.append(at)
                continue
            pair = np.flatnonzero(near)
            r, c = at[pair // len(ids)], pair % len(ids)
            if self.exclude_self:
                other = self.qids[r] != ids[c]
                r, c = r[other], c[other]
            d = np.empty(len(r))
            for p in range(0, len(r), 100_000):
                diff = self.Q[r[p:p + 100_000]] - X[c[p:p + 100_000]]
                d[p:p + 100_000] = _round_half_up(np.sqrt(np.einsum("ij,ij->i", diff, diff)), self.decimals)
            better = d <= self.kth[r]
            new.append((r[better], ids[c[better]], d[better]))
        if new:
            self._add(*(np.concatenate(x) for x in zip(*new)))
        for at in plain:
            self._plain(at, ids, X)

    def _plain(self, at, ids, Xd) -> None:
        if len(at) and len(ids):
            q, c, d = topk_block(self.qids[at], self.Q[at], ids, Xd, self.k, "l2", self.exclude_self, self.decimals)
            self._add(at[q], ids[c], d)


def _prune(q_idx, c_idx, dist, ids, k):
    pdf = pd.DataFrame({"q": q_idx, "c": c_idx, "d": dist, "id": ids[c_idx]})
    pdf = pdf[np.isfinite(pdf["d"].to_numpy())]
    pdf = pdf.sort_values(["q", "d", "id"], kind="mergesort").groupby("q", sort=False).head(k)
    return pdf["q"].to_numpy(), pdf["c"].to_numpy(), pdf["d"].to_numpy()


def _stack(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), dim) if len(col) else np.empty((0, dim), dtype=np.float32)


def _slices(rows: tuple, size: int = 500_000):
    for i in range(0, len(rows[0]), size):
        yield tuple(x[i:i + size] for x in rows)


def _final_topk(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return (partial.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("long")))


def knn_join(queries: DataFrame, corpus: DataFrame, k: int = 3, *,
             query_id: str = "qid", query_vec: str = "qvec",
             corpus_id: str = "id", corpus_vec: str = "vec",
             metric: str = "l2", exclude_self: bool = False, decimals: int = 5,
             strategy: str = "auto",
             max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
             block_bytes: int = 32 << 20) -> DataFrame:
    """For every query row, its k nearest corpus rows.

    Returns ``qid, id, distance, rank`` (rank 1-based, ties by id).  Rows
    with a null vector on either side take no part (filter F4).
    """
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("qvec")).where(
        F.col("qvec").isNotNull())
    c = corpus.select(F.col(corpus_id).alias("id"), F.col(corpus_vec).alias("vec")).where(
        F.col("vec").isNotNull())
    qid_type = q.schema["qid"].dataType
    cid_type = c.schema["id"].dataType
    out_schema = T.StructType([
        T.StructField("qid", qid_type), T.StructField("id", cid_type),
        T.StructField("distance", T.DoubleType()),
    ])
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("qvec")).alias("dim")).first()
    nq, dim = int(stats["n"]), int(stats["dim"] or 0)
    if nq == 0:
        return _final_topk(spark.createDataFrame([], out_schema), k)
    q_bytes = nq * dim * 8
    if strategy == "auto":
        strategy = "broadcast" if q_bytes <= max_broadcast_bytes else "blocked"
    if strategy == "broadcast":
        if q_bytes > max_broadcast_bytes:
            raise ValueError(f"query block {q_bytes} B exceeds broadcast bound {max_broadcast_bytes} B")
        partial = _broadcast_partial(q, c, k, dim, metric, exclude_self, decimals, out_schema)
    elif strategy == "blocked":
        partial = _blocked_partial(q, c, k, dim, nq, metric, exclude_self, decimals, out_schema,
                                   block_bytes)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return _final_topk(partial, k)


def _broadcast_partial(q, c, k, dim, metric, exclude_self, decimals, out_schema):
    spark = q.sparkSession
    tbl = q.toArrow()
    qids = tbl.column("qid").to_numpy(zero_copy_only=False)
    Q = _stack(tbl.column("qvec"), dim).astype(np.float64)
    bc = spark.sparkContext.broadcast((qids, Q))
    qtype = _arrow_type(out_schema["qid"].dataType)
    ctype = _arrow_type(out_schema["id"].dataType)
    arrow_schema = pa.schema([("qid", qtype), ("id", ctype), ("distance", pa.float64())])

    def scan(batches):
        bq, BQ = bc.value
        near = Nearest(bq, BQ, k, exclude_self, decimals) if metric == "l2" and len(bq) else None
        acc: list[tuple] = []
        held = 0

        def prune() -> list[tuple]:
            if not acc:
                return []
            qs, idv, ds = (np.concatenate([part[j] for part in acc]) for j in range(3))
            qi, ci, d = _prune(qs, np.arange(idv.size), ds, idv, k)
            return [(qi, idv[ci], d)]

        for rb in batches:
            if rb.num_rows == 0:
                continue
            ids = rb.column("id").to_numpy(zero_copy_only=False)
            X = _stack(rb.column("vec"), dim)
            if near is not None:
                near.add(ids, X)
                continue
            qi, ci, d = topk_block(bq, BQ, ids, X, k, metric, exclude_self, decimals)
            acc.append((qi, ids[ci], d))
            held += len(d)
            if held > 2 * len(bq) * k:      # never more than three times the partial top-k in memory
                acc = prune()
                held = len(acc[0][0])
        for qi, idv, d in prune() if near is None else _slices(near.rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(bq[qi], type=qtype), pa.array(idv, type=ctype), pa.array(d, type=pa.float64())],
                schema=arrow_schema)

    return c.mapInArrow(scan, out_schema)


def _blocked_partial(q, c, k, dim, nq, metric, exclude_self, decimals, out_schema, block_bytes):
    n = c.count()
    B = max(1, math.ceil(nq * dim * 8 / block_bytes))
    C = max(1, math.ceil(n * dim * 8 / block_bytes))
    qb = (q.withColumn("_qb", F.pmod(F.xxhash64("qid"), F.lit(B)))
          .withColumn("_cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(C - 1).cast("long")))))
    cb = (c.withColumn("_cb", F.pmod(F.xxhash64("id"), F.lit(C)))
          .withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(B - 1).cast("long")))))

    def cell(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({"qid": [], "id": [], "distance": []})
        qids = qpdf["qid"].to_numpy()
        ids = cpdf["id"].to_numpy()
        Q = np.stack(qpdf["qvec"].to_numpy()).astype(np.float64)
        X = np.stack(cpdf["vec"].to_numpy()).astype(np.float64)
        if metric == "l2":
            near = Nearest(qids, Q, k, exclude_self, decimals)
            near.add(ids, X)
            qi, idv, d = near.rows
            return pd.DataFrame({"qid": qids[qi], "id": idv, "distance": d})
        qi, ci, d = topk_block(qids, Q, ids, X, k, metric, exclude_self, decimals)
        return pd.DataFrame({"qid": qids[qi], "id": ids[ci], "distance": d})

    return (qb.groupBy("_qb", "_cb")
            .cogroup(cb.groupBy("_qb", "_cb"))
            .applyInPandas(cell, out_schema))


def knn_brute_force(qids, Q, ids, X, k, metric="l2", exclude_self=False, decimals=5):
    """Plain-Python restatement used by the tests: every pair, sorted."""
    rows = []
    for i, qv in zip(qids, Q):
        cand = []
        for j, xv in zip(ids, X):
            if exclude_self and i == j:
                continue
            a = np.asarray(qv, dtype=np.float64)
            b = np.asarray(xv, dtype=np.float64)
            if metric == "l2":
                d = float(np.sqrt(((a - b) ** 2).sum()))
            else:
                d = 1.0 - float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b))
            cand.append((float(_round_half_up(np.array([d]), decimals)[0]), j))
        cand.sort()
        for r, (d, j) in enumerate(cand[:k], 1):
            rows.append((i, j, d, r))
    return rows
