"""Hard negatives by a GNAT-style multiway hyperplane tree.

Scores are inner products.  Every vector gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, an
anchor gets 0 there; then |a - x|^2 = |a|^2 + M^2 - 2 <a, x>, so a window of scores is an annulus of distances
around the anchor.  A node of the tree has split points; a vector belongs to the nearest of them, and for each
split point i and child j the node keeps the smallest and the largest distance from i to the vectors under j.  A
child whose ranges show that none of its vectors lies in any annulus of an anchor is not visited for it.  Leaves
are exact: every score in them is computed.

Split points come from a bounded sample (``sample_rows``); the ranges and leaves cover every row.  A leaf is cut
into blocks of bounded size, so that neither a cluster nor thousands of equal vectors make a large group.  A
visit is a join of (block of anchors, block of rows) with both blocks, each a packed matrix; what comes out is
only what can still be among an anchor's first.  Positives first: their ``near`` most promising leaves give a
bound, then all leaves that can beat it; the same again for the windows of negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import Scratch

BLOCK_ROWS = 2048
BLOCK_ANCHORS = 256
#: Result rows a task gathers before it merges them.
HELD_ROWS = 400_000
#: Slack of computed distances, as a share of the largest norm (a hundred times their rounding).
SLACK = 1e-6


@dataclass
class Tree:
    norm: float
    nodes: list[tuple[np.ndarray, list[int]]] = field(default_factory=list)  # split points, children (a node, or -1 - leaf)
    ranges: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # per node lowest and highest [split point, child]
    leaves: int = 1

    def far(self, x: np.ndarray, points: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Distances of rows (or anchors, whose added component is 0) to split points."""
        m2 = self.norm ** 2
        up = lambda v: np.sqrt(np.maximum(m2 - (v * v).sum(1), 0))
        if anchors:
            d2 = (x * x).sum(1)[:, None] + m2 - 2 * x @ points.T
        else:
            d2 = 2 * m2 - 2 * (x @ points.T + np.outer(up(x), up(points)))
        return np.sqrt(np.maximum(d2, 0))

    def leaf_of(self, x: np.ndarray, seen: Callable | None = None) -> np.ndarray:
        """Leaf of every row; ``seen(node, distances, children)`` is told what passed a node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            node, rows = todo.pop()
            points, children = self.nodes[node]
            d = self.far(x[rows], points)
            near = d.argmin(1)
            if seen:
                seen(node, d, near)
            for j, child in enumerate(children):
                part = rows[near == j]
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out

    def reach(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest score that the ranges allow, [anchor, leaf]; an empty leaf has none (inf, -inf)."""
        n, slack = len(anchors), SLACK * self.norm
        size = (anchors * anchors).sum(1)[:, None] + self.norm ** 2
        near, far = np.zeros((n, self.leaves)), np.full((n, self.leaves), np.inf)
        todo = [(0, np.zeros(n), np.full(n, np.inf))] if self.nodes else []
        while todo:
            node, low, high = todo.pop()
            points, children = self.nodes[node]
            lo, hi = self.ranges[node]
            d = self.far(anchors, points, anchors=True)
            for j, child in enumerate(children):
                least = np.maximum(low, np.maximum(lo[:, j] - d, d - hi[:, j]).max(1))
                most = np.minimum(high, (d + hi[:, j]).min(1))
                if child < 0:
                    near[:, -1 - child], far[:, -1 - child] = least, most
                else:
                    todo.append((child, least, most))
        gone = np.isinf(near) | (far == -np.inf)
        low, high = np.maximum(near - slack, 0), far + slack
        top = np.where(gone, -np.inf, (size - low * low) / 2)
        bottom = np.where(gone, np.inf, np.where(np.isinf(high), -np.inf, (size - high * high) / 2))
        return bottom - slack * self.norm, top + slack * self.norm


def grow(sample: np.ndarray, rows: int, norm: float, branch: int, leaf_rows: int) -> Tree:
    """A tree over the sample whose leaves hold about ``leaf_rows`` of all rows; a part of the sample with too few
    distinct vectors stays a leaf."""
    tree = Tree(norm, leaves=0)

    def split(part: np.ndarray) -> int:
        want = min(branch, -(-len(part) * rows // (max(len(sample), 1) * leaf_rows)), len(part) // 4)
        picked: list[int] = []
        if want >= 2:
            # of three times as many candidates the ones farthest from those picked before, as in a GNAT
            pool = part[:3 * want]
            far = np.full(len(pool), np.inf)
            at = 0
            while len(picked) < want and far[at] > SLACK * norm:
                picked.append(int(pool[at]))
                far = np.minimum(far, tree.far(sample[pool], sample[picked[-1:]])[:, 0])
                at = int(far.argmax())
        if len(picked) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.nodes)
        points = sample[picked]
        tree.nodes.append((points, []))
        near = tree.far(sample[part], points).argmin(1)
        tree.nodes[node] = (points, [split(part[near == j]) for j in range(len(picked))])
        return node

    split(np.arange(len(sample)))
    return tree


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, short ones filled up with 0."""
    ends = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(vectors), width))
    size = np.diff(ends)
    rows = np.repeat(np.arange(len(vectors)), size)
    out[rows, np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)] = flat[ends[0]:ends[-1]]
    return out


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label, vec of the rows that take part."""
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                      F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return out.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)


def assign(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    """``rows`` with the leaf of every row and a number that deals a leaf's rows over its blocks."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = 0
        for b in batches:
            leaf = tree.leaf_of(matrix(b.column("vec"), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(np.arange(dealt, dealt + b.num_rows))],
                                             [*b.schema.names, "leaf", "deal"])
            dealt += b.num_rows
    return rows.mapInArrow(task, "id bigint, label bigint, vec array<double>, leaf bigint, deal bigint")


def measure(rows: DataFrame, tree: Tree, width: int) -> None:
    """Fill in the tree's ranges from all rows: one partial table a task, merged by min and max.  What reaches the
    driver is bounded by the tree: split points x children of each node."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {n: np.full((len(c), len(c)), np.inf) for n, (_, c) in enumerate(tree.nodes)}
        most = {n: -x for n, x in least.items()}

        def seen(node: int, d: np.ndarray, near: np.ndarray) -> None:
            for j in range(d.shape[1]):
                if (mine := near == j).any():
                    least[node][:, j] = np.minimum(least[node][:, j], d[mine].min(0))
                    most[node][:, j] = np.maximum(most[node][:, j], d[mine].max(0))
        for b in batches:
            tree.leaf_of(matrix(b.column("vec"), width), seen)
        for n in least:
            i, j = np.nonzero(np.isfinite(least[n]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n)), pa.array(i), pa.array(j), pa.array(least[n][i, j]), pa.array(most[n][i, j])],
                                             ["node", "i", "j", "lo", "hi"])
    found = rows.select("vec").mapInArrow(task, "node bigint, i bigint, j bigint, lo double, hi double")
    got = found.groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect() if tree.nodes else []
    tree.ranges = [(np.full((len(c), len(c)), np.inf), np.full((len(c), len(c)), -np.inf)) for _, c in tree.nodes]
    for r in got:
        tree.ranges[r.node][0][r.i, r.j], tree.ranges[r.node][1][r.i, r.j] = r.lo, r.hi


TYPES = {"double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def pack(rows: DataFrame, key: Column, width: int, extra: dict[str, str] | None = None) -> DataFrame:
    """One row per ``key``: its rows by id as lists and one matrix.  Groups are bounded by the caller."""
    extra = extra or {}
    schema = f"block bigint, ids array<bigint>, labels array<bigint>, mat binary{''.join(f', {n} array<{t}>' for n, t in extra.items())}"

    def task(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("id", "ascending"), ("label", "ascending")])
        m = matrix(group.column("vec").combine_chunks(), width)
        # whole numbers of 16 bits travel as such
        small = not m.size or (np.abs(m).max() < 32768 and (m == np.rint(m)).all())
        raw = b"s" + m.astype("<i2").tobytes() if small else b"d" + m.astype("<f8").tobytes()
        listed = lambda c, kind: pa.array([group.column(c).to_pylist()], pa.list_(kind))
        more = [listed(c, TYPES[t]) for c, t in extra.items()]
        return pa.table([group.column("block")[:1], listed("id", pa.int64()), listed("label", pa.int64()), pa.array([raw], pa.binary()), *more],
                        ["block", "ids", "labels", "mat", *extra])
    return rows.select(key.alias("block"), "id", "label", "vec", *extra).groupBy("block").applyInArrow(task, schema)


def unpack(raw: bytes, width: int) -> np.ndarray:
    kind = "<i2" if raw[:1] == b"s" else "<f8"
    return np.frombuffer(raw, kind, offset=1).reshape(-1, width).astype(float)


def dealt(count: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """(first block, blocks) of every leaf, for blocks of at most about ``size``."""
    out, first = {}, 0
    for leaf in sorted(count):
        out[leaf] = (first, -(-count[leaf] // size))
        first += out[leaf][1]
    return out


def gathered(count: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """As ``dealt``, with small leaves that follow one another (neighbours in the tree) in one block."""
    out, first, held = {}, 0, 0
    for leaf in sorted(count):
        if held and held + count[leaf] > size:
            first, held = first + 1, 0
        blocks = -(-count[leaf] // size)
        out[leaf] = (first, blocks)
        if blocks > 1:
            first, held = first + blocks, 0
        else:
            held += count[leaf]
    return out


def block_key(rows: DataFrame, blocks: dict[int, tuple[int, int]]) -> DataFrame:
    """``rows`` with ``block``; the table of leaves is bounded by the tree."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(k, a, n) for k, (a, n) in blocks.items()] or [(0, 0, 1)], "leaf long, _first long, _n long")
    spread = F.pmod(F.xxhash64("deal", "id"), F.col("_n"))
    return rows.join(F.broadcast(table), "leaf").withColumn("block", F.col("_first") + spread).drop("_first", "_n")


def visits(anchors: DataFrame, tree: Tree, blocks: dict[int, tuple[int, int]], width: int, wanted: Callable, near: int, first: bool) -> DataFrame:
    """(a, b): blocks of rows to score for each block of anchors.  ``wanted(row, bottom, top)`` says which leaves can
    hold something for each anchor and how promising each is; the first round takes the ``near`` best of them, the
    second all that the first, by the same bounds, left out."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bottom, top = tree.reach(unpack(row["mat"], width))
                open_, worth, started = wanted(row, bottom, top)
                order = np.argsort(np.where(started, -worth, np.inf), axis=1, kind="stable")[:, :near]
                before = np.zeros(tree.leaves, bool)
                before[order[np.take_along_axis(started, order, 1)]] = True
                leaves = before if first else open_.any(0) & ~before
                b = [x for leaf in np.flatnonzero(leaves).tolist() if leaf in blocks for x in range(blocks[leaf][0], sum(blocks[leaf]))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), row["block"])), pa.array(b, pa.int64())], ["a", "b"])
    return anchors.mapInArrow(task, "a bigint, b bigint")


def first_rows(cols: list[np.ndarray], keep: int) -> list[np.ndarray]:
    """Of columns (group columns..., id, score) the first ``keep`` rows of every group, by score, then id."""
    *groups, ids, score = cols
    order = np.lexsort((ids, -score, *groups[::-1]))
    cols = [c[order] for c in cols]
    new = np.ones(len(ids), bool)
    if len(ids):
        new[1:] = np.any([g[1:] != g[:-1] for g in cols[:len(groups)]], axis=0)
    at = np.arange(len(ids))
    rank = at - np.maximum.accumulate(np.where(new, at, 0))
    return [c[rank < keep] for c in cols]


def meet(pairs: DataFrame, anchors: DataFrame, rows: DataFrame, kernel: Callable, schema: str, width: int, keep: int) -> DataFrame:
    """``kernel(anchor block, row block, scores)`` over every pair of blocks; a task passes on the first ``keep`` rows of
    each group it has seen, merging whenever ``HELD_ROWS`` have gathered."""
    extra = [c for c in anchors.columns if c not in ("block", "ids", "labels", "mat")]
    left = anchors.select(F.col("block").alias("a"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("mat").alias("a_mat"), *extra)
    joined = pairs.join(left, "a").join(rows.withColumnRenamed("block", "b"), "b")
    names = [x.split()[0] for x in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                arr = lambda n, kind=float: np.array(row[n].as_py(), kind)
                x, y = unpack(row["a_mat"].as_py(), width), unpack(row["mat"].as_py(), width)
                out = kernel({n: row[n].as_py() for n in extra}, arr("a_ids", np.int64), arr("a_labels", np.int64),
                             arr("ids", np.int64), arr("labels", np.int64), x @ y.T)
                held.append(out)
                size += len(out[0])
                if size > HELD_ROWS:
                    held = [first_rows([np.concatenate(c) for c in zip(*held, strict=True)], keep)]
                    size = len(held[0][0])
                    if size > HELD_ROWS // 2:  # many anchors: pass on what is known so far
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in first_rows([np.concatenate(c) for c in zip(*held, strict=True)], keep)], names)
    return joined.mapInArrow(task, schema)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5,
         negatives: int = 10, window: tuple[int, int, int] = (30, 90, 100), sample_rows: int = 4096, branch: int = 16,
         leaf_rows: int = BLOCK_ROWS, near: int = 2) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of another label whose score lies between
    window[0] / window[2] and window[1] / window[2] of the positive's.  Higher scores come first, ties by smaller id.

    ``is_anchor`` is a condition on the column ``id``.  Ids and labels are integers.  Scores are exact for whole-number
    components (up to 2^53), which the caller provides.  Rows without id, label or vector and rows with a null or
    non-finite component take no part.  A vector shorter than the longest counts as filled up with 0; an empty one
    scores 0.  A repeated anchor id is one anchor (the row with the smallest label, then vector); rows with the
    anchor's own id are not among its positives or negatives; other repeated rows are rows like any other, and a
    repeated positive has its negatives once per row.  No rows: none are returned.  Other columns are not read."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    low, high, unit = window
    table = usable(rows, id_col, vector_col, label_col)
    size = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    stats = table.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("m2"), F.max(F.size("vec")).alias("width")).first()
    width, norm = max(stats["width"] or 0, 1), float(stats["m2"] or 0) ** 0.5
    picked = table.select("vec", "id").orderBy(F.xxhash64("id", "vec"), "id").limit(sample_rows).select("vec").toArrow()["vec"].combine_chunks()
    tree = grow(matrix(picked, width), stats["n"], norm, branch, leaf_rows)
    table = scratch.cut(assign(table, tree, width), "assigned")
    measure(table, tree, width)
    is_a = table.where(is_anchor)
    per_leaf = {r["leaf"]: (r["n"], r["a"]) for r in table.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("a")).collect()}
    blocks = dealt({k: n for k, (n, _) in per_leaf.items()}, BLOCK_ROWS)
    packed = scratch.cut(pack(block_key(table, blocks), F.col("block"), width), "blocks")
    mine_ = F.min(F.struct("label", "vec", "leaf", "deal")).alias("m")  # partially aggregated
    anchors = is_a.groupBy("id").agg(mine_).select("id", "m.*")
    anchors = scratch.cut(block_key(anchors, gathered({k: a for k, (_, a) in per_leaf.items() if a}, BLOCK_ANCHORS)).drop("leaf", "deal"), "anchors")

    # positives: the first ones of the most promising leaves bound what the other leaves must offer
    def best(name: str, who: DataFrame, first: bool) -> DataFrame:
        def wanted(row, bottom, top):
            floor = np.array(row["floor"])[:, None]
            return top >= floor, top, top > -np.inf

        def kernel(extra, a_ids, a_labels, ids, labels, score):
            floor = np.array(extra["floor"])[:, None]
            ok = (labels[None] == a_labels[:, None]) & (ids[None] != a_ids[:, None]) & (score >= floor)
            order = np.argsort(np.where(ok, -score, np.inf), axis=1, kind="stable")[:, :positives]  # rows stand by id
            i, j = np.nonzero(np.take_along_axis(ok, order, 1))
            return a_ids[i], ids[order[i, j]], score[i, order[i, j]]
        pairs = visits(who, tree, blocks, width, wanted, near, first)
        return scratch.cut(meet(pairs, who, packed, kernel, "anchor_id bigint, positive_id bigint, positive_score double", width, positives), name)

    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    found = best("positives", pack(anchors.withColumn("floor", F.lit(-np.inf)), F.col("block"), width, {"floor": "double"}), True)
    floors = found.withColumn("rank", rank).where(F.col("rank") == positives).select(F.col("anchor_id").alias("id"), F.col("positive_score").alias("floor"))
    bounded = anchors.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-np.inf)))
    found = found.union(best("positives2", pack(bounded, F.col("block"), width, {"floor": "double"}), False))
    chosen = scratch.cut(found.withColumn("nth", rank).where(F.col("nth") <= positives), "chosen")

    # negatives: the same with the windows of each anchor's positives
    state = chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("p"))  # few rows each
    state = state.select(F.col("anchor_id").alias("id"), F.col("p.nth").alias("nths"), F.col("p.positive_score").alias("scores"))
    extra = {"nths": "array<int>", "scores": "array<double>", "floors": "array<double>"}

    def padded(row: dict, name: str) -> np.ndarray:
        out = np.full((len(row[name]), positives), np.nan)
        for k, x in enumerate(row[name]):
            out[k, :len(x)] = x
        return out

    def windows(name: str, who: DataFrame, first: bool) -> DataFrame:
        def wanted(row, bottom, top):
            score, floor = padded(row, "scores")[:, :, None], padded(row, "floors")[:, :, None]
            with np.errstate(invalid="ignore"):
                least = np.maximum(score * low / unit, floor)
                cap = score * high / unit
                slack = 1e-9 * np.abs(score) + 1e-9
                begun = (top[:, None] >= score * low / unit - slack) & (bottom[:, None] <= cap + slack)
                open_ = begun & (top[:, None] >= least - slack)
                worth = -np.nanmin(np.where(begun, np.abs((np.maximum(top[:, None], -1e300) + np.maximum(bottom[:, None], -1e300)) / 2 - cap), np.inf), axis=1)
            return open_.any(1), worth, begun.any(1)

        def kernel(state, a_ids, a_labels, ids, labels, score):
            ok = (labels[None] != a_labels[:, None]) & (ids[None] != a_ids[:, None])
            order = np.argsort(np.where(ok, -score, np.inf), axis=1, kind="stable")
            ranked = np.take_along_axis(np.where(ok, score, -np.inf), order, 1)
            p, floor, out = padded(state, "scores"), padded(state, "floors"), []
            for k in range(positives):
                s = p[:, k, None]
                with np.errstate(invalid="ignore"):
                    start = (unit * ranked > high * s).sum(1)
                    at = np.minimum(start[:, None] + np.arange(negatives), len(ids) - 1)
                    got = np.take_along_axis(ranked, at, 1)
                    fits = (start[:, None] + np.arange(negatives) < len(ids)) & np.isfinite(got) & (unit * got >= low * s) & (unit * got <= high * s) & (got >= floor[:, k, None])
                i, j = np.nonzero(fits)
                out.append((a_ids[i], np.full(len(i), k + 1), ids[order[i, at[i, j]]], got[i, j]))
            return [np.concatenate(c) for c in zip(*out, strict=True)]
        pairs = visits(who, tree, blocks, width, wanted, near, first)
        return scratch.cut(meet(pairs, who, packed, kernel, "anchor_id bigint, nth bigint, negative_id bigint, negative_score double", width, negatives), name)

    place = F.row_number().over(Window.partitionBy("anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    with_p = scratch.cut(anchors.join(state, "id"), "windows")
    none = F.transform("scores", lambda _: F.lit(-np.inf))
    got = windows("negatives", pack(with_p.withColumn("floors", none), F.col("block"), width, extra), True)
    floors = got.withColumn("rank", place).where(F.col("rank") == negatives)
    floors = floors.groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("nth").cast("int"), "negative_score"))).alias("f"))
    with_f = with_p.join(floors, "id", "left").withColumn("floors", F.transform("nths", lambda n: F.coalesce(F.try_element_at("f", n), F.lit(-np.inf)))).drop("f")
    got = got.union(windows("negatives2", pack(with_f, F.col("block"), width, extra), False))
    got = got.withColumn("rank", place).where(F.col("rank") <= negatives)
    return (got.join(chosen, ["anchor_id", "nth"])
            .select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score"), F.col("negative_score")))
