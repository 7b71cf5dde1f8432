"""SentencePiece (BPE) encoding by suffix-array matching, and decoding.

A batch's distinct units (a run of spaces with the letters after it; no piece crosses a unit) are laid end
to end and indexed by a suffix array as deep as the longest piece.  Every piece of the vocabulary is looked
up in it by binary search; its range of suffixes gives all its occurrences at once.  The occurrences are the
edges (start, end, rank); sorted by position they are relaxed together for all units: in each round every
unit takes its best edge that joins exactly two of its current symbols (the leftmost of equal ranks) until
none is left, which is the merge order of the model.  The edges of long units come from a heap instead, which is
the same order and visits each edge once.  Characters without a piece fall back to byte pieces.

Scale: one scan, no shuffle; the vocabulary (some 32,000 strings) travels with the task.  The index covers
``INDEX_CHARS`` characters of new units at a time; a worker process keeps one encoder over its tasks, which
remembers at most ``MEMO`` units.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scriptorium.llm.common import map_rows, require_new

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
INDEX_CHARS = 400_000
MEMO = 300_000
#: Longer units take their edges from a heap: a round of the joint relaxation takes one edge a unit.
LONG_UNIT = 48


@dataclass
class Vocabulary:
    """Pieces by id, their merge ranks (lower first, equal scores alike), and the ids of the byte pieces."""
    pieces: list[str]
    ranks: np.ndarray
    kinds: np.ndarray  # 0 text, 1 control or unknown, 2 byte

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        kinds = np.array([2 if m.is_byte(i) else int(m.is_control(i) or m.is_unknown(i)) for i in range(n)])
        crossing = [p for p, k in zip(pieces, kinds, strict=True) if k == 0 and (SPACE in p.lstrip(SPACE) or (len(p) > 1 and "\n" in p))]
        if crossing:
            raise ValueError(f"pieces cross units: {crossing[:3]}")
        scores = np.array([m.get_score(i) for i in range(n)])
        return Vocabulary(pieces, np.unique(-scores, return_inverse=True)[1], kinds)

    def digest(self) -> str:
        return hashlib.sha256("\0".join(self.pieces).encode("utf-8", "surrogatepass") + self.ranks.tobytes() + self.kinds.tobytes()).hexdigest()


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        text = [i for i, k in enumerate(vocab.kinds) if k == 0]
        self.ids = {vocab.pieces[i]: i for i in text}
        self.byte = {int(vocab.pieces[i][3:5], 16): i for i, k in enumerate(vocab.kinds) if k == 2}
        many = sorted((i for i in text if len(vocab.pieces[i]) > 1), key=lambda i: vocab.pieces[i])
        letters = sorted(set("".join(vocab.pieces[i] for i in many)))
        letter = {c: k + 1 for k, c in enumerate(letters)}  # dense codes; 0: in no longer piece
        self.letter = np.zeros(0x110000, ">u2")
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.single = np.full(0x110000, -1, np.int32)
        for c, i in self.ids.items():
            if len(c) == 1:
                self.single[ord(c)] = i
        self.depth = max((len(vocab.pieces[i]) for i in many), default=1)
        self.many = np.array(many, np.int64)
        self.many_len = np.array([len(vocab.pieces[i]) for i in many], np.int64)
        codes = np.zeros((len(many), self.depth), ">u2")
        tops = np.full((len(many), self.depth), 0xFFFF, ">u2")
        for r, i in enumerate(many):
            row = [letter[c] for c in vocab.pieces[i]]
            codes[r, :len(row)] = row
            tops[r, :len(row)] = row
        self.low, self.high = codes.view(f"S{2 * self.depth}").ravel(), tops.view(f"S{2 * self.depth}").ravel()
        self.place: dict[str, int] = {}  # numbers of the units met, in order
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)  # their ids end to end

    def edges(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index into ``many``) of every occurrence of a longer piece in code points, by position.

        The index is cut into stretches of ``INDEX_CHARS`` that overlap by the longest piece."""
        found = []
        for at in range(0, len(chars), INDEX_CHARS):
            part = chars[at:at + INDEX_CHARS + self.depth - 1]
            n = len(part)
            padded = np.zeros(n + self.depth, ">u2")
            padded[:n] = self.letter[part]
            rows = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[:min(n, INDEX_CHARS)]
            suffixes = np.ascontiguousarray(rows).view(f"S{2 * self.depth}").ravel()
            order = np.argsort(suffixes, kind="stable")  # the suffix array, as deep as the longest piece
            suffixes = suffixes[order]
            a, b = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
            hits = b - a
            start = order[np.repeat(a - np.concatenate(([0], np.cumsum(hits)[:-1])), hits) + np.arange(hits.sum())]
            piece = np.repeat(np.arange(len(self.many)), hits)
            by = np.argsort(start, kind="stable")
            found.append((start[by] + at, piece[by]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def relax(self, units: list[str], single: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, end to end, and how many each has.

        ``single`` takes the edges one after another, for units so long that a round an edge would not do."""
        text = "".join(units)
        lens = np.array([len(u) for u in units])
        ends = np.cumsum(lens)
        unit = np.repeat(np.arange(len(units)), lens)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        start, piece = self.edges(chars)
        stop = start + self.many_len[piece]
        inside = stop <= ends[unit[start]]
        start, piece, stop = start[inside], piece[inside], stop[inside]
        ids = self.single[chars].astype(np.int64)
        cut = np.ones(len(text) + 1, bool)  # symbol boundaries
        (self.by_heap if single else self.by_rounds)(start, piece, stop, unit, ids, cut)
        symbols = np.flatnonzero(cut[:-1])
        got = ids[symbols]
        count = np.ones(len(got), np.int64)
        raw = {k: self.fallback(text[symbols[k]]) for k in np.flatnonzero(got < 0).tolist()}
        for k, b in raw.items():
            count[k] = len(b)
        out, upto = np.repeat(got, count), np.concatenate(([0], np.cumsum(count)))
        for k, b in raw.items():
            out[upto[k]:upto[k + 1]] = b
        return out.astype(np.int32), np.diff(upto[np.searchsorted(symbols, np.concatenate(([0], ends)))])

    def by_rounds(self, start, piece, stop, unit, ids, cut) -> None:
        """Every unit takes its best joinable edge in each round."""
        rank = (self.vocab.ranks[self.many[piece]].astype(np.int64) << 32) | start
        while len(start):
            upto = np.cumsum(cut)
            inner = upto[stop - 1] - upto[start]
            live = cut[start] & cut[stop] & (inner > 0)
            start, piece, stop, rank, inner = start[live], piece[live], stop[live], rank[live], inner[live]
            ready = np.flatnonzero(inner == 1)
            if not len(ready):
                break
            own = unit[start[ready]]
            heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            best = np.minimum.reduceat(rank[ready], heads)
            take = ready[rank[ready] == np.repeat(best, np.diff(np.append(heads, len(own))))]
            borders = np.flatnonzero(cut)
            cut[borders[upto[start[take]]]] = False
            ids[start[take]] = self.many[piece[take]]

    def by_heap(self, start, piece, stop, unit, ids, cut) -> None:
        """One edge after the other, the best of all joinable ones."""
        ranks, pieces, ends = self.vocab.ranks[self.many[piece]].tolist(), self.many[piece].tolist(), stop.tolist()
        first = np.searchsorted(start, np.arange(len(cut) + 1)).tolist()  # edges by start
        after, before = list(range(1, len(cut) + 1)), list(range(-1, len(cut) - 1))  # neighbouring symbol boundaries
        heap = [(ranks[e], i, e) for e, i in enumerate(start.tolist()) if ends[e] == i + 2]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            mid, j = after[i], ends[e]
            if not (cut[i] and cut[j] and mid < j and after[mid] == j):
                continue
            cut[mid] = False
            after[i], before[j], ids[i] = j, i, pieces[e]
            for x, y in ((i, after[j]), (before[i], j)):
                if x >= 0:
                    for k in range(first[x], first[x + 1]):
                        if ends[k] == y:
                            heapq.heappush(heap, (ranks[k], x, k))

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and how many each has; none for an empty one."""
        split = [_UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        ids, counts, group, size, first = [], [], set(), 0, 0
        for r, units in enumerate(split):
            fresh = set(units).difference(self.place)
            fresh -= group
            group |= fresh
            size += sum(map(len, fresh))
            if size >= INDEX_CHARS or r == len(split) - 1:
                self.learn(group)
                part = split[first:r + 1]
                at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(part)), np.int64)
                count = self.ends[at + 1] - self.ends[at]
                upto = np.concatenate(([0], np.cumsum(count)))
                ids.append(self.flat[np.arange(upto[-1]) + np.repeat(self.ends[at] - upto[:-1], count)])
                counts.append(np.diff(upto[np.cumsum([0] + [len(u) for u in part])]))
                group, size, first = set(), 0, r + 1
                self.forget()
        return np.concatenate(ids or [np.zeros(0, np.int32)]), np.concatenate(counts or [np.zeros(0, np.int64)])

    def learn(self, units: set[str]) -> None:
        """Number the units and keep their ids."""
        for single in (False, True):
            todo = sorted(u for u in units if (len(u) > LONG_UNIT) == single)
            sizes = np.cumsum([len(u) for u in todo]) // INDEX_CHARS
            for a, b in zip(*(lambda x: (x[:-1], x[1:]))(np.searchsorted(sizes, np.arange(sizes[-1] + 2)) if todo else [0]), strict=True):
                part = todo[a:b]
                if part:
                    ids, count = self.relax(part, single)
                    self.place.update(zip(part, range(len(self.place), len(self.place) + len(part)), strict=True))
                    self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(count)))
                    self.flat = np.concatenate((self.flat, ids))

    def forget(self) -> None:
        """The older half of the units, when there are too many."""
        if len(self.place) > MEMO:
            half = len(self.place) // 2
            self.place = {u: k for k, u in enumerate(islice(self.place, half, None))}
            self.flat, self.ends = self.flat[self.ends[half]:], self.ends[half:] - self.ends[half]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocab: Vocabulary) -> Encoder:
    """The worker process's encoder of this vocabulary, with the units it has met in earlier tasks."""
    key = vocab.digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocab)
    return _ENCODERS[key]


class Decoder:
    def __init__(self, vocab: Vocabulary):
        self.raw = [bytes([int(p[3:5], 16)]) if k == 2 else b"" if k == 1 else p.replace(SPACE, " ").encode() for p, k in zip(vocab.pieces, vocab.kinds, strict=True)]

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined (broken ones become U+FFFD), the leading space taken off."""
        text = b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_texts(docs: DataFrame, text_col: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with ``out``: array<int> of the whole text's ids; null and empty texts have none.

    The ids are those of the model's own encoder, its leading space included.  Rows are independent."""
    vocab = Vocabulary.load(model)
    at = docs.columns.index(text_col)
    schema = docs.selectExpr("*", f"cast(array() as array<int>) as `{out}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                ids = encoder.encode([t or "" for t in b.column(at).to_pylist()])
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with ``out``: the text of the ids; null for null ids.  Spaces that the text wrote as U+2581 come back as spaces."""
    vocab = Vocabulary.load(model)
    at = rows.columns.index(ids_col)
    schema = rows.selectExpr("*", f"cast(null as string) as `{out}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocab)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                text = [None if not x.is_valid else decoder.decode(x.values.to_numpy(zero_copy_only=False)) for x in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def _tasks(vocab: Vocabulary, text_at: int | None, ids_at: int | None, decode: bool):
    """A task that adds the ids of column ``text_at`` and, with ``decode``, the text of the ids (own or of column ``ids_at``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = encoder_of(vocab) if text_at is not None else None, Decoder(vocab)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                cols = list(b.columns)
                if encoder:
                    flat, count = encoder.encode([t or "" for t in b.column(text_at).to_pylist()])
                    ends = np.concatenate(([0], np.cumsum(count)))
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                if decode:
                    lists = cols[-1] if encoder else b.column(ids_at)
                    cols.append(pa.array([decoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{k}" for k in range(len(cols))])
    return run


def _added(rows: DataFrame, columns: dict[str, str]):
    """The schema with more columns."""
    require_new(rows, *columns)
    return rows.selectExpr("*", *[f"cast(null as {t}) as `{c}`" for c, t in columns.items()]).schema


def encode_texts(docs: DataFrame, text_col: str = "text", out: str = "ids", model: str = MODEL, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``out``: array<int> of the whole text's ids; null and empty texts have none.  With ``decoded`` also
    the text that ``decode_ids`` gives for them, in the same pass.

    The ids are those of the model's own encoder, its leading space included.  Rows are independent.  A name in use
    for a new column is refused."""
    schema = _added(docs, {out: "array<int>"} | ({decoded: "string"} if decoded else {}))
    return map_rows(docs, _tasks(Vocabulary.load(model), docs.columns.index(text_col), None, bool(decoded)), schema)


def decode_ids(rows: DataFrame, ids_col: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with ``out``: the text of the ids; null for null ids.  Spaces that the text wrote as U+2581 come back as
    spaces.  A name in use for the new column is refused."""
    schema = _added(rows, {out: "string"})
    return map_rows(rows, _tasks(Vocabulary.load(model), None, rows.columns.index(ids_col), True), schema)
