"""Near-duplicate documents by b-bit MinHash.

Signatures pack the low ``BITS`` bits of ``bands * rows`` minima over a document's set of word shingles.  Bands of
the packed signature propose pairs, the count of equal lanes (bits of the folded exclusive or), corrected for
chance collisions, estimates their similarity, and the full shingle sets confirm every link exactly.

Documents with equal sets form one node first, so exact copies never meet as pairs.  Inside a band bucket
pairs are not all emitted: each node is first confirmed against one pivot, the bucket pivot it shares most
bands with, which turns a large group of near copies into one component.  What is left in different components
is compared in cells, blocks of a bucket's nodes that carry signatures and shingle sets: first, for a few turns,
every block with itself only (each node once), then every pair of blocks.  A cell goes through its probable pairs,
the likeliest first, skips those that are in one component by then, confirms the others on the sets and passes on
the links that join components; no list of pairs leaves it.  No link between components is lost.

Scale: band buckets are counted with partial aggregation; a hot bucket is split by the adaptive skew join
because every join reads written tables.  Texts of nodes that occur in a pair are fetched once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import kernels as K
from scriptorium.llm.common import Scratch, components

#: Bands and rows at thresholds of 0.75 and more; ``scheme`` has those of lower ones.
BANDS, ROWS, BITS = 48, 5, 8
#: A link is in no common band with at most this probability, at any threshold.
MISS = 2.5e-6
_gen = np.random.default_rng(77)
MUL = _gen.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _gen.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64)
BAND_MUL = _gen.integers(1, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A pair is confirmed on full sets unless its estimate is this far below the threshold, and so many deviations.
SLACK, DEVIATIONS = 0.12, 4.25
#: Turns of pivots before what is left is compared in blocks (the result is the same after any number).
STAR_TURNS = 2
#: Turns in which blocks are compared with themselves only.
BLOCK_TURNS = 2
#: Nodes of a block of a bucket, and shingles of all of them.
BLOCK_NODES, BLOCK_SHINGLES = 512, 1 << 20


def scheme(threshold: float) -> tuple[int, int, float]:
    """(bands, rows, slack): the most rows a band, out of as many minima as ``BANDS * ROWS``, that miss a pair at the
    threshold with a probability of ``MISS`` at most; more minima, a row each, where none does."""
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold} is not above 0 and at most 1")
    total = BANDS * ROWS
    bands, rows = next(((total // r, r) for r in range(ROWS, 0, -1) if (1 - threshold ** r) ** (total // r) <= MISS),
                       (math.ceil(math.log(MISS) / math.log1p(-threshold)) if threshold < 1 else 1, 1))
    return bands, rows, max(SLACK, DEVIATIONS * math.sqrt(threshold * (1 - threshold) / (bands * rows)))


def hashes(minima: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of so many minima."""
    more = np.random.default_rng(78).integers(1, 1 << 62, (max(0, minima - len(MUL)), 2), dtype=np.uint64)
    return np.concatenate((MUL, more[:, 0] * np.uint64(2) + np.uint64(1)))[:minima], np.concatenate((ADD, more[:, 1]))[:minima]


def signature(s: np.ndarray, mul: np.ndarray = MUL, add: np.ndarray = ADD) -> bytes:
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(s, len(s) // 4096 + 1):
        low = np.minimum(low, (part[:, None] * mul + add).min(0))
    return (low ^ (low >> np.uint64(32))).astype(np.uint8).tobytes()


def band_keys(sigs: list[bytes], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), bands, rows).astype(np.uint64)
    keys = (K.mix(parts + np.uint64(1)) * BAND_MUL[:rows]).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return K.mix(keys).view(np.int64)


def packed(sigs: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit words, filled up with 0."""
    size = len(sigs[0]) if sigs else 0
    out = np.zeros((len(sigs), -(-size // 8) * 8), np.uint8)
    out[:, :size] = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), size)
    return out.view(np.uint64)


def likeness(x: np.ndarray, y: np.ndarray, lanes: int) -> np.ndarray:
    """Similarities of packed rows from the bits that count unequal lanes, corrected for chance collisions."""
    apart = x ^ y
    for fold in (4, 2, 1):
        apart |= apart >> np.uint64(fold)
    unlike = np.bitwise_count(apart & np.uint64(0x0101010101010101)).sum(1, dtype=np.int64)
    chance = 2.0 ** -BITS
    return (1 - unlike / lanes - chance) / (1 - chance)


def estimate(a: list[bytes], b: list[bytes]) -> np.ndarray:
    return likeness(packed(a), packed(b), len(a[0]) if a else 1)


def _texts(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").lower() for t in column.to_pylist()]


def _sets(minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul, add = hashes(minima)
        for b in batches:
            raw = _texts(b.column("_text"))
            n, key, sig = [], [], []
            for _, part in K.by_bytes(raw):
                for s in K.shingle_sets(part):
                    n.append(len(s))
                    key.append(np.array([K.mix(s).sum(), K.mix(s ^ MUL[0]).sum()], np.uint64).tobytes() if len(s) else None)
                    sig.append(signature(s, mul, add) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_tk"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())],
                                             ["_id", "_tk", "_n", "_key", "_sig"])
    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                keys = band_keys(part.column("_sig").to_pylist(), bands, rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("_nid").to_numpy(), bands)),
                                                  pa.array(np.repeat(part.column("_n").to_numpy(), bands))], ["_band", "_nid", "_n"])
    return run


def compare_cells(num: int, den: int, floor: float, bands: int = BANDS, rows: int = ROWS):
    """A task over rows sorted by cell (_band, _i, _j): links between the blocks _i and _j of a bucket that join components.

    Every probable pair (size and estimate allow the threshold) of different components is looked at in the cell of
    the first band it shares only."""
    def probable(band, a, b, same_block, comp, n, sig, words) -> tuple[np.ndarray, np.ndarray]:
        """Probable pairs, the likeliest first."""
        found = []
        step = max(1, 100_000 // max(1, len(b)))
        for at in range(0, len(a), step):
            x, y = np.repeat(a[at:at + step], len(b)), np.tile(b, len(a[at:at + step]))
            take = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num)
            if same_block:
                take &= x < y
            x, y = x[take], y[take]
            near = likeness(words[x], words[y], bands * rows)
            likely = near >= floor
            x, y, near = x[likely], y[likely], near[likely]
            if len(x):
                shared = (sig[x] == sig[y]).reshape(-1, bands, rows).all(2)
                first = band_keys([r.tobytes() for r in sig[x]], bands, rows)[np.arange(len(x)), shared.argmax(1)] == band
                found.append((x[first], y[first], near[first]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y, near = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(-near, kind="stable")
        return x[order], y[order]

    def cell(keys, own, nid, comp, n, sig, words, sets) -> tuple[list[int], list[int]]:
        band, i, j = keys
        x, y = probable(band, np.flatnonzero(own == i), np.flatnonzero(own == j), i == j, comp, n, sig, words)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c
        out_x, out_y = [], []
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(int(comp[p])), find(int(comp[q]))
            if a == b:
                continue
            both = len(np.intersect1d(np.frombuffer(sets[p].as_buffer(), np.uint64), np.frombuffer(sets[q].as_buffer(), np.uint64), assume_unique=True))
            if den * both >= num * (int(n[p]) + int(n[q]) - both):
                root[a] = b
                out_x.append(int(nid[p]))
                out_y.append(int(nid[q]))
        return out_x, out_y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cells(table: pa.Table, last: bool):
            """Pairs of the whole cells of ``table``; what may go on is kept."""
            held.clear()
            if not table.num_rows:
                return
            keys = np.stack([table.column(c).to_numpy() for c in ("_band", "_i", "_j")], 1)
            starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))
            if not last:
                held.extend(table.slice(starts[-2]).to_batches())
                starts = starts[:-1]
            own, nid, comp, n = (table.column(c).to_numpy() for c in ("_own", "_nid", "_c", "_n"))
            raw, sets = table.column("_sig").to_pylist(), table.column("_set").combine_chunks()
            sig, words = np.frombuffer(b"".join(raw), np.uint8).reshape(table.num_rows, -1), packed(raw)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                x, y = cell(keys[s], own[s:e], nid[s:e], comp[s:e], n[s:e], sig[s:e], words[s:e], sets[s:e])
                if x:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["_x", "_y"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                yield from cells(pa.Table.from_batches([*held, batch.slice(at, 4000)]), False)
        if held:
            yield from cells(pa.Table.from_batches(list(held)), True)
    return run


def text_key(text) -> object:
    """The 64-bit key that tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (75, 100)) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept, text_key.

    Words are runs of anything but ASCII white space after lower-casing A-Z; a set holds the distinct 5-word
    shingles, the whole sequence where there are fewer words.  Null, empty and blank texts have an empty set
    and are linked with nothing.  Links need intersection / union >= threshold, exactly; at any threshold
    above 0 the candidate search misses a link with probability ``MISS`` at most.  component_id is the
    smallest id reachable (the row's own if its set is empty); rows of a null id never give one.  Repeated rows
    are rows of one node.  An empty table gives no rows.
    """
    num, den = threshold
    n_bands, n_rows, slack = scheme(num / den)
    floor = num / den - slack
    scratch = Scratch(docs.sparkSession, "near")
    text = F.coalesce(docs[text_col], F.lit(""))
    src = docs.select(docs[id_col].alias("_id"), text_key(docs[text_col]).alias("_tk"), text.alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    rows = scratch.cut(src.mapInArrow(_sets(n_bands * n_rows), f"_id {kind}, _tk bigint, _n bigint, _key binary, _sig binary"), "rows")
    nodes = rows.where("_n > 0").groupBy("_key").agg(F.min("_id").alias("_lo"), F.min(F.struct("_id", "_tk")).alias("_rep"),
                                                      F.first("_n").alias("_n"), F.first("_sig").alias("_sig"))
    nodes = scratch.cut(nodes.withColumn("_nid", F.monotonically_increasing_id()), "nodes")
    rows = scratch.cut(rows.select("_id", "_tk", "_n", "_key"), "slim")  # signatures are needed once a node only
    scratch.drop("rows")
    bands = scratch.cut(nodes.select("_nid", "_n", "_sig").mapInArrow(_bands(n_bands, n_rows), "_band bigint, _nid bigint, _n bigint"), "bands")
    shared = bands.groupBy("_band").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_band")
    shared = scratch.cut(shared, "shared")
    bands = scratch.cut(bands.join(shared.hint("shuffle_hash"), "_band"), "buckets")
    scratch.drop("bands", "shared")
    # texts of every node that shares a bucket, fetched once
    some = nodes.join(bands.select("_nid").distinct(), "_nid", "left_semi").select("_nid", F.col("_rep._id").alias("_rid"), F.col("_rep._tk").alias("_rtk"))
    some = scratch.cut(some, "some")
    texts = scratch.cut(src.join(some.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_tk") == F.col("_rtk"))).select("_nid", "_text"), "texts")
    sigs = nodes.select("_nid", "_n", "_sig")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = _texts(b.column("_tx")), _texts(b.column("_ty"))
            ok, last, mine = [], None, None
            for x, y in zip(xs, ys, strict=True):
                if y != last:
                    last, mine = y, K.shingle_sets([y])[0]
                s = K.shingle_sets([x])[0]
                both = len(np.intersect1d(s, mine, assume_unique=True))
                ok.append(den * both >= num * (len(s) + len(mine) - both))
            yield b.select(["_x", "_y"]).filter(pa.array(ok, pa.bool_()))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s.tobytes() for _, part in K.by_bytes(_texts(b.column("_text"))) for s in K.shingle_sets(part)]
            yield pa.RecordBatch.from_arrays([b.column("_nid"), pa.array(found, pa.binary())], ["_nid", "_set"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = estimate(b.column("_sx").to_pylist(), b.column("_sy").to_pylist()) >= floor
                yield b.select(["_x", "_y"]).filter(pa.array(near))

    def probable(pairs: DataFrame) -> DataFrame:
        """The pairs (_x, _y) whose sizes and estimates allow the threshold."""
        both = pairs.join(sigs.select(F.col("_nid").alias("_x"), F.col("_sig").alias("_sx"), F.col("_n").alias("_nx")), "_x")
        both = both.join(sigs.select(F.col("_nid").alias("_y"), F.col("_sig").alias("_sy"), F.col("_n").alias("_ny")), "_y")
        both = both.where(F.least("_nx", "_ny") * den >= F.greatest("_nx", "_ny") * num).select("_x", "_y", "_sx", "_sy")
        return both.mapInArrow(likely, "_x bigint, _y bigint")

    def cell_links(rows: DataFrame, sets: DataFrame, turn: int | None) -> DataFrame:
        """Links between nodes of one bucket in different components.

        A bucket is dealt by hash to blocks of about ``BLOCK_NODES`` nodes and ``BLOCK_SHINGLES`` shingles.  With
        ``turn`` a block is compared with itself, dealt anew each turn; without, with every block of its bucket.
        No task holds more than two blocks, and no list of a bucket's pairs is made."""
        wide = rows.join(sets, "_nid")
        wide = wide.withColumn("_blocks", F.ceil(F.greatest(F.col("_m") / BLOCK_NODES, F.col("_sum") / BLOCK_SHINGLES)))
        wide = wide.withColumn("_own", F.pmod(F.xxhash64("_nid", F.lit(turn or 0)), F.col("_blocks")))
        others = F.array("_own") if turn is not None else F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)
        wide = wide.withColumn("_other", F.explode(others))
        wide = wide.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
        wide = wide.select("_band", "_i", "_j", "_own", "_nid", "_c", "_n", "_sig", "_set")
        cells = wide.repartition("_band", "_i", "_j").sortWithinPartitions("_band", "_i", "_j")
        return cells.mapInArrow(compare_cells(num, den, floor, n_bands, n_rows), "_x bigint, _y bigint")

    def confirmed(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The pairs whose full sets reach the threshold, and the pairs tried.

        The join strategy is fixed: pairs and texts grow with the corpus, so neither is ever broadcast."""
        pairs = scratch.cut(pairs, f"{name}-likely")
        full = pairs.hint("shuffle_hash").join(texts.select(F.col("_nid").alias("_x"), F.col("_text").alias("_tx")), "_x")
        full = full.join(texts.select(F.col("_nid").alias("_y"), F.col("_text").alias("_ty")).hint("merge"), "_y").select("_x", "_y", "_tx", "_ty")
        return scratch.cut(full.mapInArrow(confirm, "_x bigint, _y bigint"), f"{name}-links"), pairs

    def merged(label: DataFrame, new: DataFrame, name: str) -> DataFrame:
        """``label`` (_nid, _c) after joining the components that the new links connect."""
        ends = new.join(label.select(F.col("_nid").alias("_x"), F.col("_c").alias("a")), "_x")
        ends = ends.join(label.select(F.col("_nid").alias("_y"), F.col("_c").alias("b")), "_y").select("a", "b")
        moved = components(ends, scratch).select(F.col("node").alias("_c"), "root")
        out = scratch.cut(label.join(moved, "_c", "left").select("_nid", F.coalesce("root", "_c").alias("_c")), f"{name}-label")
        scratch.drop("cc", *[k for k in scratch.paths if k.endswith("-label") and k != f"{name}-label"])
        return out

    label, turn, productive, sets = some.select("_nid", F.col("_nid").alias("_c")), 0, True, None
    while True:
        now = scratch.cut(bands.join(label, "_nid"), f"now{turn}")
        mixed = now.groupBy("_band").agg(F.count(F.lit(1)).alias("_m"), F.sum("_n").alias("_sum"), F.min("_c").alias("_a"), F.max("_c").alias("_z"))
        mixed = scratch.cut(mixed.where("_a <> _z").select("_band", "_m", "_sum"), f"mixed{turn}")
        open_rows = scratch.cut(now.join(mixed, "_band"), f"open{turn}")
        scratch.drop("buckets", f"now{turn - 1}", f"open{turn - 1}", f"now{turn}", f"mixed{turn}")
        bands = open_rows.select("_band", "_nid", "_n")  # a bucket that is one component stays one
        widest = open_rows.agg(F.max("_m")).head()[0]
        if not widest:
            break
        if turn >= STAR_TURNS or turn and not productive:
            if sets is None:
                nodes_open = open_rows.select("_nid").distinct()
                sets = texts.join(nodes_open, "_nid").mapInArrow(shingled, "_nid bigint, _set binary").join(sigs.select("_nid", "_sig"), "_nid")
                sets = scratch.cut(sets, "sets")
                scratch.drop("texts")
                cells_from = turn
            last = turn - cells_from >= BLOCK_TURNS or widest <= BLOCK_NODES
            new = scratch.cut(cell_links(open_rows, sets, None if last else turn), f"cells{turn}")
            label = merged(label, new, f"turn{turn}")
            if last:
                break
            turn += 1
            continue
        # pivots: one node per bucket, another one each turn; every node takes the pivot it shares most buckets with
        pivot = open_rows.groupBy("_band").agg(F.min(F.struct(F.xxhash64("_nid", "_band", F.lit(turn)), F.col("_nid").alias("p"), F.col("_c").alias("c"))).alias("_p"))
        pivot = scratch.cut(pivot.select("_band", F.col("_p.p").alias("_y"), F.col("_p.c").alias("_cy")), f"pivots{turn}")
        stars = open_rows.join(pivot, "_band").where("_c <> _cy").groupBy(F.col("_nid").alias("_x"), "_y").agg(F.count(F.lit(1)).alias("_k"))
        stars = stars.groupBy("_x").agg(F.max(F.struct("_k", "_y")).alias("_b")).select("_x", F.col("_b._y").alias("_y"))
        new, tried = confirmed(probable(stars), f"star{turn}")
        productive = new.count() * 20 >= tried.count()
        label = merged(label, new, f"turn{turn}")
        scratch.drop(f"pivots{turn}", f"star{turn}-likely", f"star{turn}-links")
        turn += 1
    named = nodes.select("_nid", "_key", "_lo").join(label, "_nid", "left").withColumn("_root", F.coalesce("_c", "_nid"))
    lows = named.groupBy("_root").agg(F.min("_lo").alias("_low"))
    named = scratch.cut(named.join(lows, "_root").select("_key", "_low"), "named")
    own = F.when(F.col("_n") > 0, F.col("_low")).otherwise(F.col("_id"))
    return rows.join(named, "_key", "left").select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), own.alias("component_id"),
                                                   F.col("_id").eqNullSafe(own).alias("kept"), F.col("_tk").alias("text_key"))
