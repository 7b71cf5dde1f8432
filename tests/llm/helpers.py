"""Brute-force versions of the operators, in plain Python over small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, key string, kept string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def corpus(seed: int = 5) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, blank, very long and repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)] + ["é", "日本", "Straße", "I'm", "x-y"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(80)
    rows, base = [], [text(rng.randint(3, 200)) for _ in range(12)]
    for b in base:
        rows.append(b)
        for _ in range(3):
            w = b.split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
        rows.append(b.upper())
    rows += [base[0]] * 6 + [text(30) + " " + passage + " " + text(30) for _ in range(8)]
    rows += [None, None, "", "", "   \n", "one", "One", "a b c d", "a b c d", "=" * 700, "ab" * 600, passage, text(6000), text(4) + "\n" + passage * 2]
    out = [(i * 3 + 1, t) for i, t in enumerate(rows)]
    out += [out[0], out[0], (None, base[1]), (None, "only null id " + passage)]
    rng.shuffle(out)
    return out


def frame(spark, rows, parts: int = 3):
    """The rows as a table with extra columns whose names clash with internal ones."""
    data = [(d, t, "en", None, 0, 7, "k", "x") for d, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def shingles(t: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows: list[tuple]) -> list[int]:
    """Smallest id reachable of every row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]


def without_repeats(texts: list[bytes], depth: int = 200) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept bytes) of every text."""
    seen = Counter(t[i:i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - depth + 1):
            if seen[t[i:i + depth]] > 1:
                gone[i:i + depth] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


_KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t: str) -> list[str]:
    out = []
    for kind, pattern in _KINDS.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and _luhn(d),
                  "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def word_runs(words: list[str], min_length: int = 12) -> list[tuple]:
    """(start, length, period) of all runs: every lag's maximal stretches, the smallest lag of equal ones."""
    out: dict[tuple, int] = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def planted_words(doc_id: int | None, text: str | None) -> list[str]:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    a = (h // 10) % len(w)
    p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def run_row(doc_id: int | None, words: list[str]) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    runs = word_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    return (len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept)))
