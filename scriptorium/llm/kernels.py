"""Numpy kernels over byte buffers, used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

M = np.uint64
_rng = np.random.default_rng(20240501)
#: Random odd multiplier of the prefix hash and a random value per byte.
BASE = M(0x9E3779B97F4A7C15)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * M(2) + M(1)
WORD_MUL = _rng.integers(1, 1 << 62, 8, dtype=np.uint64) * M(2) + M(1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> M(30))
    x = x * M(0xBF58476D1CE4E5B9)
    x = x ^ (x >> M(27))
    x = x * M(0x94D049BB133111EB)
    return x ^ (x >> M(31))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: np.uint64) -> np.uint64:
    return M(pow(int(base), -1, 1 << 64))


def by_bytes(items: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, items) in runs of about ``limit`` bytes; a longer item comes alone."""
    start, size = 0, 0
    for i, x in enumerate(items):
        if i > start and size + len(x) > limit:
            yield start, items[start:i]
            start, size = i, 0
        size += len(x)
    if start < len(items):
        yield start, items[start:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and words per text."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    space = SPACES[buf]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) < len(starts):
        ends = np.append(ends, len(buf))
    place = powers(len(buf) + 1, BASE)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[buf] * place[:-1], dtype=np.uint64)))
    back = powers(len(buf) + 1, inverse(BASE))
    words = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    per = np.diff(np.searchsorted(starts, offsets))
    return words, per


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles; with fewer words the whole
    sequence is the one shingle; without words none."""
    words, per = word_hashes(texts)
    out, at = [], 0
    n = len(words) - width + 1
    roll = np.zeros(max(n, 0), np.uint64)
    for j in range(width):
        if n > 0:
            roll += words[j:j + n] * WORD_MUL[j]
    roll = mix(roll)
    for k in per:
        if k >= width:
            out.append(np.unique(roll[at:at + k - width + 1]))
        elif k:
            out.append(mix((words[at:at + k] * WORD_MUL[:k]).sum(keepdims=True) + M(k)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out
