"""Every operator against a brute-force version: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm import helpers as H

ROWS = H.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return H.frame(spark, ROWS)


def test_exact_dedup(spark, docs):
    from scriptorium.llm.exact_dedup import exact_dedup
    got = exact_dedup(docs, carry=[docs["doc_id"], docs["text"], docs["kept"].alias("other")], first_width=4, growth=3).collect()
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[t or ""].append(d)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(ROWS)
    for r in got:
        ids = [d for d in groups[r.text or ""] if d is not None]
        assert r.keep_id == (max(ids) if ids else None) and r.group_size == len(groups[r.text or ""])
        assert not r.kept or r.doc_id == r.keep_id
    assert Counter(r.text or "" for r in got if r.kept) == Counter(groups.keys())
    assert exact_dedup(docs.limit(0)).count() == 0
    assert set(docs.columns) <= set(exact_dedup(docs.drop("kept")).columns) | {"kept"}


def test_near_dedup(spark, docs):
    from scriptorium.llm.near_dedup import near_dedup
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup(docs).collect())
    want = Counter((d, len(H.shingles(t)), c, d == c) for (d, t), c in zip(ROWS, H.near_components(ROWS), strict=True))
    assert got == want
    assert near_dedup(docs.limit(0)).count() == 0


def test_near_dedup_large_group(spark, monkeypatch):
    """A group whose members are linked through others only, and a passage that many unlike texts share; in many blocks."""
    from scriptorium.llm.near_dedup import near_dedup
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = [word() for _ in range(200)]
    rows = []
    for i in range(60):
        rows.append((1000 - i, " ".join(text)))
        text[rng.randrange(200)] = word()
    passage = " ".join(word() for _ in range(60))
    rows += [(2000 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(60)]
    monkeypatch.setattr("scriptorium.llm.near_dedup.BLOCK_NODES", 5)
    got = {r.doc_id: r.component_id for r in near_dedup(H.frame(spark, rows)).collect()}
    assert got == {d: c for (d, _), c in zip(rows, H.near_components(rows), strict=True)}


def test_near_dedup_low_threshold(spark):
    """Pairs just at a low threshold are all found; the given threshold keeps its bands."""
    from scriptorium.llm import near_dedup as N
    assert N.scheme(0.75) == (N.BANDS, N.ROWS, N.SLACK)
    for t in (0.01, 0.05, 0.2, 0.5, 0.6, 0.7, 0.75, 0.9, 1.0):
        bands, rows, slack = N.scheme(t)
        assert (1 - t ** rows) ** bands <= N.MISS and slack >= 4.2 * (t * (1 - t) / (bands * rows)) ** 0.5
    for t in (0, -0.1, 1.1):
        with pytest.raises(ValueError):
            N.scheme(t)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    rows = []
    for i in range(150):  # 60 shared of 120 shingles, then 59 of 121
        same = 64 if i < 120 else 63
        common = [word() for _ in range(same)]
        rows += [(2 * i + k, " ".join(common + [word() for _ in range(94 - same)])) for k in (1, 2)]
    got = {r.doc_id: r.component_id for r in N.near_dedup(H.frame(spark, rows), threshold=(50, 100)).collect()}
    assert got == {d: d - (d % 2 == 0 and d <= 240) for d, _ in rows}


def test_cells_link_what_brute_force_links():
    """Blocks of all buckets, cut into small batches: only true links between different components leave, none twice, and
    they join what all links of pairs with a common band join."""
    import numpy as np
    import pyarrow as pa

    from scriptorium.llm import near_dedup as N
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(300) < rng.choice([0.9, 0.93, 0.96])], rng.integers(0, 1 << 62, 10).astype(np.uint64)))) for _ in range(40)]
    sigs = [N.signature(s) for s in sets]
    keys, comp, size = N.band_keys(sigs), [i % 20 for i in range(40)], [len(s) for s in sets]
    rows = []
    for j in range(N.BANDS):
        for key in set(keys[:, j]):
            for x in np.flatnonzero(keys[:, j] == key):
                rows += [(int(key), min(x % 3, o), max(x % 3, o), x % 3, x, comp[x], size[x], sigs[x], sets[x].tobytes()) for o in range(3)]
    rows.sort(key=lambda r: r[:3])
    table = pa.table(dict(zip(("_band", "_i", "_j", "_own", "_nid", "_c", "_n", "_sig", "_set"), map(list, zip(*rows, strict=True)), strict=True)))
    for num in (70, 75, 80, 85):
        got = [(min(x, y), max(x, y)) for b in N.compare_cells(num, 100, num / 100 - 0.2)(iter(table.to_batches(max_chunksize=37)))
               for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        want = set()
        for y in range(40):
            for x in range(y):
                both = len(np.intersect1d(sets[x], sets[y]))
                if comp[x] != comp[y] and (keys[x] == keys[y]).any() and 100 * both >= num * (size[x] + size[y] - both):
                    want.add((x, y))

        def joined(pairs):
            root = {c: c for c in comp}
            for x, y in pairs:
                a, b = root[comp[x]], root[comp[y]]
                root = {c: b if r == a else r for c, r in root.items()}
            groups: dict = {}
            for c, r in root.items():
                groups.setdefault(r, set()).add(c)
            return sorted(map(sorted, groups.values()))
        assert len(got) == len(set(got)) and set(got) <= want and joined(got) == joined(want)
    assert len(want) < 780


def test_bbit_estimate_is_corrected():
    import numpy as np

    from scriptorium.llm import near_dedup as N
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (600, 100, 100))
    x, y = (N.signature(np.unique(np.concatenate((common, z)))) for z in (a, b))
    assert abs(N.estimate([x], [y])[0] - 0.75) < 0.12 and N.estimate([x], [x])[0] == 1.0
    lanes = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    plain = ((lanes[0] == lanes[1]).mean() - 2.0 ** -N.BITS) / (1 - 2.0 ** -N.BITS)
    assert len(x) == N.BANDS * N.ROWS and abs(N.estimate([x], [y])[0] - plain) < 1e-12


def test_repeats(spark, docs):
    from scriptorium.llm.substring_dedup import remove_repeats
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_text), r.kept_sha256) for r in remove_repeats(docs).collect())
    want = H.without_repeats([(t or "").encode() for _, t in ROWS])
    assert got == Counter((d, n, gone, spans, kept, H.sha(kept)) for (d, _), (n, gone, spans, kept) in zip(ROWS, want, strict=True))
    assert remove_repeats(docs.limit(0)).count() == 0


def test_repeats_across_segments(monkeypatch):
    """Runs cut at the segments of a very long text are found like others."""
    import numpy as np
    import pyarrow as pa

    from scriptorium.llm import substring_dedup as S
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text], pa.binary())], ["key", "text"])

    def windows():
        out = []
        for b in S.first_pass(iter([batch])):
            for at in b.column("at").to_numpy():
                out += range(at // 256, at // 256 + at % 256)
        return out
    whole = windows()
    monkeypatch.setattr(S, "SEGMENT", 700)
    assert sorted(whole) == sorted(windows()) == list(range(len(text) - S.DEPTH + 1))
    assert np.all(np.diff(sorted(whole)) == 1)


def test_pii(spark):
    from scriptorium.llm import pii
    rng = random.Random(9)
    bits = ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-5678", "+1",
            " ", "  ", "-", "5", "12", "é", "日", "_w@q.r.", "%", "+", "0001.002.003.255", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "ssn 123-45-6789",
            "123-45-6789", "A@b@c.d", "9" * 25, "\n", "(", ")"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)] + [None, "", "a" * 90_000, "1" * 90_000, "+1 " * 9000, "a@b.c " * 500]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, gap string").repartition(4)
    for r in pii.pii_spans(df).collect():
        spans = [f"{s.kind}:{s.start}:{s.end}" for s in r.pii]
        t = texts[r.doc_id] or ""
        assert [s for s in spans if s.split(":")[0] in pii.BASE] == H.base_spans(t), t
    added = spark.createDataFrame([(1, "pay to DE89 3704 0044 0532 0130 00 now"), (2, "DE88 3704 0044 0532 0130 00"), (3, "ssn 123-45-6789"), (4, "no 123-45-6789")], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.pii] for r in pii.pii_spans(added).collect()}
    assert "iban" in got[1] and "iban" not in got[2] and got[3] == ["ssn"] and got[4] == []
    one = pii.pii_spans(spark.createDataFrame([("mail me: a@b.cd, or é 1.2.3.4!",)], "text string")).select(pii.redact(F.col("text"), F.col("pii"))).head()[0]
    assert one == "mail me: [EMAIL], or é [IP]!"


def test_mixing(spark):
    from scriptorium.llm.mixing import mix
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 20)), rng.choice(["en", "de", None]), rng.choice(["a1", "a1", "a1", "b2", "c3", None])) for i in range(400)]
    rows += [rows[0], (None, "x y", "en", "a1"), (900, None, "en", "a1")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, lang string, source string, _tok string, epoch int").repartition(3)
    domain = F.substring(df["source"], 1, 1)
    weights = {"a": 3, ("a", "en"): 2, ("*", "de"): 5}
    total = sum(len((t or "").split()) for _, t, _, _ in rows)
    for budget in (None, total // 3, 3 * total, 100 * total):
        got = mix(df, domain, weights, budget=budget, max_epochs=4, carry=[df["epoch"].alias("mine")]).collect()
        assert len({(r.doc_id, r.domain, r.lang, r.source, r.epoch) for r in got}) >= len(got) - 4  # one row repeats
        picked, have = Counter(), Counter()
        for r in got:
            picked[r.domain, r.lang, r.source] += r.n_tokens
        for _, t, lang, source in rows:
            have[(source or "")[:1], lang or "", source or ""] += len((t or "").split())
        leaf = _budgets(have, weights, total if budget is None else budget, 4)
        for k, b in leaf.items():
            assert b <= picked[k] < b + 20 or picked[k] == b, (budget, k, b, picked[k])
    assert mix(df.limit(0), domain, weights).count() == 0


def _budgets(have, weights, budget, epochs):
    def weight(path):
        out = 1
        for k, w in weights.items():
            k = (k,) if isinstance(k, str) else k
            if len(k) == len(path) and all(a in ("*", b) for a, b in zip(k, path, strict=True)):
                out = w
        return out

    def share(path, budget):
        kids = sorted({k[:len(path) + 1] for k in have if k[:len(path)] == path and have[k]})
        cap = {c: sum(epochs * v for k, v in have.items() if k[:len(c)] == c) for c in kids}
        open_, left, got = set(kids), budget, {}
        while True:
            full = {c for c in open_ if cap[c] * sum(weight(o) for o in open_) <= left * weight(c)}
            if not full:
                break
            for c in full:
                got[c] = cap[c]
            left -= sum(cap[c] for c in full)
            open_ -= full
        for c in open_:
            got[c] = left * weight(c) // sum(weight(o) for o in open_)
        return got if len(path) == 2 else {k: v for c, b in got.items() for k, v in share(c, b).items()}
    return share((), budget)


def test_fingerprint(spark, docs):
    from scriptorium.llm import fingerprint as fp
    got = fp.fingerprint_edits(docs.drop("_id"), parts=4).select("doc_id", "n_chars", "edited_text", "_bins", fp.likeness(F.col("_bins"), F.col("_edited_bins")).alias("e"),
                                                    fp.likeness(F.col("_bins"), F.col("_next_bins")).alias("n")).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, close = Counter(), []
    likes = defaultdict(list)
    for r in got:
        likes[r.doc_id, r.edited_text].append(r)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        want[d, len(t), edited] += 1
        a, b = H.shingles(t.lower()), H.shingles(edited.lower())
        true = len(a & b) / len(a | b) if a | b else 1.0
        close.append(min(abs(true - r.e) for r in likes[d, edited]))
    assert Counter((r.doc_id, r.n_chars, r.edited_text) for r in got) == want
    assert max(close) < 0.25 and sum(close) / len(close) < 0.05
    assert all(0 <= r.e <= 1 and 0 <= r.n <= 1 and len(r._bins) in (0, fp.BINS) for r in got)
    assert fp.fingerprint_edits(docs.limit(0)).count() == 0
    single = fp.fingerprint_edits(docs.where("doc_id = 4").limit(1)).collect()
    assert len(single) == 1


def test_url_rules(spark):
    from scriptorium.llm import url_filter as U
    from scriptorium.llm.queries import URL_RULES
    urls = ["http://A.com/x", "https://www.example.com/en/1", "http://b.example.com/en/", "http://x.www.example.com/en/q?a=1#f", "http://example.com/en", "ftp://n.net/es/?x", "n.net/es/",
            "http://n.net/fr/1#t", "http://notexample.com/en/", "http://com", "http://org/a/b", None, "", "://", "http://h?x=/en/", "http://u.net:80/es/", "mailto:x://com/", "http://com/\nq"]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(0, urls[0], "r")], "page_id long, url string, rule string")
    got = U.judge_urls(df, URL_RULES, trees=2).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r.page_id]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
        host, tail = rest[:cut].translate(H.LOWER), rest[cut:]
        path = tail[:min([i for i, c in enumerate(tail) if c in "?#"] or [len(tail)])]
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits) if fits else (0, None, None)
        assert (r.host, r.path, r.rule) == (host, path, rule[1]) and r.verdict in ("allow", "block") and rule[2] in (None, r.verdict)
    assert U.judge_urls(df.limit(0), URL_RULES).count() == 0
    plain = U.judge_urls(df.where("page_id = 0"), URL_RULES).collect()
    assert {r.verdict for r in plain} == {"allow"}


def test_url_trees_learn(spark):
    from scriptorium.llm import url_filter as U
    rng = random.Random(1)
    rows = [(i, f"http://h{rng.randint(0, 9)}.{'bad' if i % 2 else 'good'}.org/{'9' * 30 if i % 2 else 'abc'}/{i}") for i in range(300)]
    rows += [(1000 + i, f"http://new{i}.org/{'8' * 29 if i % 2 else 'abd'}/{i}") for i in range(40)]
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [("block", "bad.org", "/"), ("allow", "good.org", "/")]).where("rule is null").collect()
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) >= 36


def test_url_sample_of_repeated_urls(spark):
    """URLs repeated by the hundreds are one weighted row each, and a rare label is in the sample."""
    from scriptorium.llm import url_filter as U
    urls = [f"http://u{i}.net/{i}" for i in range(60)]
    label = lambda u: float(int(u.rsplit("/", 1)[1]) % 2)
    frame = lambda us, lab: spark.createDataFrame([(u, lab(u), *[float(u.rsplit("/", 1)[1])] * len(U.FEATURES)) for u in us], ["_url", "_label", *U.FEATURES])
    got = U.sample_urls(frame(urls[:3] * 400 + urls[3:], label), 20).collect()
    assert len(got) == 20 and len({r.f_len for r in got}) == 20 and {r._label for r in got} == {0.0, 1.0}
    assert all(r._label == r.f_len % 2 and r._weight == (400 if r.f_len < 3 else 1) for r in got)
    for rare in (urls[0], urls[33]):
        got = U.sample_urls(frame(urls + [rare] * 2, lambda u, x=rare: float(u == x)), 6).collect()
        assert len({r.f_len for r in got}) == len(got) <= 6 and {r._label for r in got} == {0.0, 1.0}
        if [r for r in got if r._label == 1] and len(got) < 6:
            assert sum(r._weight for r in got) == pytest.approx(62)


def test_url_trees_on_repeated_urls(spark):
    """A few URLs repeated more often than the sample is large do not leave the trees with one class."""
    from scriptorium.llm import url_filter as U
    urls = [f"http://h{i}.{'bad' if i % 2 else 'good'}.org/{'9' * 30 if i % 2 else 'abc'}/{i}" for i in range(100)]
    first = min(urls, key=lambda u: spark.range(1).select(F.xxhash64(F.lit(u))).head()[0])
    rows = [(i, u) for i, u in enumerate(urls + [first] * 300)] + [(1000 + i, f"http://new{i}.org/{'8' * 29 if i % 2 else 'abd'}/{i}") for i in range(40)]
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [("block", "bad.org", "/"), ("allow", "good.org", "/")], sample_rows=100)
    got = got.where("rule is null").collect()
    assert len(got) == 40 and sum((r.verdict == "block") == bool(r.page_id % 2) for r in got) >= 36


def test_chat(spark):
    from scriptorium.llm import chat
    rng = random.Random(6)
    bits = ["\\", "</turn>", "##", "### ", "#", "\\e", "\\h", "a", "é", " ", ": ", "\n", "##+ ", "</turn>\n", "\\c"]
    rows = []
    for c in [*range(12), None]:
        for k in range(rng.randint(1, 30)):
            rows.append((c, k if c != 3 else 0, rng.choice(["user", "assistant", "a:b#", None]) if k else "system", "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))))
    rows += [(5, 0, "system", "dup"), (5, 0, "system", "dup"), (7, None, "user", None), (50, 1, "assistant", "w " * 3000)]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "conv_id long, turn long, role string, text string, pos int, window string").repartition(3)
    windows = chat.format_chats(df, budget=40, history=2)
    back = windows.select("conv_id", "window", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.masked_texts(F.col("formatted"), F.col("loss_mask")).alias("m"), "loss_mask").collect()
    by = defaultdict(list)
    for r in sorted(back, key=lambda r: r.window):
        by[r.conv_id].append(r)
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for cc, t, r, x in rows if cc == c))
        new = [(t.role, t.text) for w in by[c] for t in w.t if not t.again]
        assert new == [(r, x) for _, r, x in own]
        assert [x for w in by[c] for x in w.m] == [x for _, r, x in own if r == "assistant"]
        want = _windows([len(x.split()) + 4 for _, _, x in own], own[0][1] == "system", 40, 2, 1024)
        flat = [(r, x) for _, r, x in own]
        assert [[(t.again, t.role, t.text) for t in w.t] for w in by[c]] == [[(True, *flat[i]) for i in old] + [(False, *flat[i]) for i in new] for old, new in want]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_blocks(spark, monkeypatch):
    """Prefix sums over blocks of turns: windows end where a block of positions does, and no others change."""
    from scriptorium.llm import chat
    tokens = [k % 7 + 4 for k in range(200)]
    df = spark.createDataFrame([(1, k, "user", "w " * (k % 7)) for k in range(200)], "conv_id long, turn long, role string, text string")
    for block in (1024, 9):
        monkeypatch.setattr(chat, "BLOCK", block)
        got = [r.window - 1 for r in chat.format_chats(df, budget=30).orderBy("window").collect()]
        assert got == [new[0] for _, new in _windows(tokens, False, 30, 2, block)]


def _windows(tokens, system, budget, history, block):
    """(context positions, new positions) of every window of one conversation."""
    out, at = [], 0
    while at < len(tokens):
        used, context = tokens[at], []
        if system and at and used + tokens[0] <= budget:
            used, context = used + tokens[0], [0]
        back = []
        for h in range(at - 1, max(at - history, int(system)) - 1, -1):
            if used + tokens[h] > budget:
                break
            used, back = used + tokens[h], [h, *back]
        end = at + 1
        while end < len(tokens) and end % block and used + tokens[end] <= budget:
            used, end = used + tokens[end], end + 1
        out.append((context + back, list(range(at, end))))
        at = end
    return out


@pytest.mark.parametrize("history", [0, 2, 11])
def test_chat_budget(spark, monkeypatch, history):
    """All tokens of a window, repeated ones too, are within the budget, or its only turn is over it."""
    from scriptorium.llm import chat
    rng = random.Random(16)
    monkeypatch.setattr(chat, "BLOCK", 8)
    rows = [(c, k, "system" if c % 3 and not k else rng.choice(["user", "assistant"]), "w " * rng.choice([0, 1, 3, 9, 20, 27, 28, 29, 60]))
            for c in range(20) for k in range(rng.randint(1, 40))]
    rows += [(None, k, "user", f"w{k}") for k in range(5)] + [(99, None, "system", "w " * 40), (99, 1, "user", "w " * 9), (99, 2, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = defaultdict(list)
    out = chat.format_chats(df, budget=32, history=history)
    for r in sorted(out.withColumn("t", chat.read_back(F.col("formatted"))).withColumn("m", chat.masked_texts(F.col("formatted"), F.col("loss_mask"))).collect(), key=lambda r: r.window):
        got[r.conv_id].append(r)
        assert sum(len(t.text.split()) + 4 for t in r.t) <= 32 or len(r.t) == 1
        assert r.m == [t.text for t in r.t if not t.again and t.role == "assistant"]
    for c in {r[0] for r in rows}:
        own = [(r, x or "") for cc, _, r, x in rows if cc == c]
        want = _windows([len(x.split()) + 4 for _, x in own], own[0][0] == "system", 32, history, 8)
        assert [[(t.again, t.role, t.text) for t in w.t] for w in got[c]] == [[(True, *own[i]) for i in old] + [(False, *own[i]) for i in new] for old, new in want]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_toxicity_learns_pairs():
    """Labels that only a product of two terms explains."""
    import numpy as np

    from scriptorium.llm import toxicity as X
    rng = random.Random(8)
    rows, y = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = " ".join(["grumf"] * a + ["zolk"] * b + [f"w{rng.randrange(40)}" for _ in range(8)])
        rows.append(np.array(sorted({h for w in X.words(text) for h in X.word_terms(w)}), np.int64))
        y.append(int(a and b))
    y = np.array(y)
    all_terms = np.unique(np.concatenate(rows[:1000]))
    m = X.fit(all_terms, [np.searchsorted(all_terms, r) for r in rows[:1000]], y[:1000], np.ones(1000))
    place = {int(h): i for i, h in enumerate(m.terms)}
    z = np.array([m.raw(np.array([place[int(h)] for h in r if int(h) in place], np.int64)) for r in rows[1000:]])
    assert ((z > 0) == (y[1000:] == 1)).mean() > 0.97 and np.abs(m.v).max() > 0.1


def test_toxicity_rows(spark, docs):
    from scriptorium.llm import toxicity as X
    bad = [(i, f"plain words here {'idiot' if i % 3 == 0 else f'w{i % 7}x'} number {i % 11}") for i in range(300)]
    df = H.frame(spark, bad + [(None, "idiot"), (900, None), (901, ""), (902, "idiot " * 30_000), (0, bad[0][1])])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(5, None), (None, 1), (0, 1), (7, 4)], "doc_id long, toxic int")
    got = X.score(df, X.train(df, labels)).collect()
    assert len(got) == 305 and got[0].asDict().keys() >= set(df.columns)
    by = {r.doc_id: r.toxicity for r in got}
    assert all((by[i] >= 0.3) == (i % 3 == 0) for i in range(200, 300)) and by[900] == by[901] < 0.5 < by[902] and by[None] > 0.5
    assert X.score(df.limit(0), X.train(df, labels.limit(0))).count() == 0
    assert all(0 <= r.toxicity <= 1 for r in X.score(docs, X.train(df, labels.where("toxic = 1"))).collect())


def test_toxicity_repeated_ids(spark):
    """A chosen id that repeats in documents reaches the driver as one row, the same one in any order."""
    import numpy as np

    from scriptorium.llm import toxicity as X
    rows = [(i, f"words {i % 5} {'idiot' if i % 2 else 'fine'}") for i in range(40)]
    rows += [(3, f"copy {k % 7}") for k in range(500)] + [(4, None)] * 50 + [(5, rows[5][1])] * 50
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(900, 1)], "doc_id long, toxic int")
    def take(r, n):
        sample, counts = X.sample_labelled(H.frame(spark, r), labels, n, "doc_id", "text", "toxic")
        got = sorted(sample.collect())
        return [x["_terms"] for x in got], np.array([x["_y"] for x in got]), counts
    terms, y, counts = take(rows, 10)
    assert len(terms) == len(y) == 20 and sum(counts.values()) == 41
    terms, y, counts = take(rows, 100)
    assert len(terms) == 40 and (y == np.arange(40) % 2).all() and sum(counts.values()) == 41 and not len(terms[4])
    again = take(rows[::-1], 100)
    assert terms == again[0]


def test_toxicity_terms_and_score(spark):
    """Terms by chi-square against plain Python; the score against the double sum over pairs."""
    import numpy as np

    from scriptorium.llm import toxicity as X
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["grumf", "zolk", "plim", "dar", f"u{rng.randrange(30)}x"]) for _ in range(rng.randint(0, 6)))) for i in range(300)]
    lab = {i: int("grumf" in t and rng.random() < 0.7 or rng.random() < 0.1) for i, t in rows}
    sample, counts = X.sample_labelled(H.frame(spark, rows), spark.createDataFrame(list(lab.items()), "doc_id long, toxic int"), 60, "doc_id", "text", "toxic")
    got = sample.collect()
    n = {c: sum(r["_y"] == c for r in got) for c in (0, 1)}
    per = {c: counts[c] / n[c] for c in n}
    want = {}
    for t in {t for r in got for t in r["_terms"]}:
        c = [sum(t in r["_terms"] and r["_y"] == k for r in got) for k in (0, 1)]
        a, b, pos, neg = c[1] * per[1], c[0] * per[0], n[1] * per[1], n[0] * per[0]
        chi = (n[0] + n[1]) / (pos + neg) * (pos + neg) * (a * neg - b * pos) ** 2 / (pos * neg * (a + b) * max(pos + neg - a - b, 1))
        if sum(c) >= 3 and chi >= 0.5:
            want[t] = chi
    assert X.telling_terms(sample, per, n, 1000, 3, 0.5).tolist() == sorted(want)
    assert X.telling_terms(sample, per, n, 4, 3, 0.5).tolist() == sorted(sorted(want, key=lambda t: (-want[t], t))[:4])
    gen = np.random.default_rng(1)
    m = X.Model(np.arange(9), 0.3, gen.normal(size=9), gen.normal(size=(9, 4)))
    for idx in ([], [3], [0, 2, 5, 8]):
        plain = m.bias + sum(m.w[i] for i in idx) + sum(float(m.v[i] @ m.v[j]) for i in idx for j in idx if i < j)
        assert abs(m.raw(np.array(idx, np.int64)) - plain) < 1e-9


def test_toxicity_words_in_pieces(monkeypatch):
    from scriptorium.llm import toxicity as X
    text = "One two,three x² 42 été " + "y" * 50 + " end9tail"
    whole = X.words(text)
    for size in (1, 2, 7):
        monkeypatch.setattr(X, "PIECE", size)
        assert X.words(text) == whole


def test_toxicity_held_out(spark):
    """Labels of the rows held out are predicted from the others, on a given table."""
    from scriptorium.llm import queries as q
    sf = "/root/testdata/sf0.1"
    got = q.QUERIES["op10_toxicity"](spark, sf)
    rows = got.join(q.table(spark, sf, "labels").where("toxic is not null"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    hit = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert right > 0.96 and hit > 0.8, (right, hit)


def test_pieces_match_the_library(spark):
    import sentencepiece

    from scriptorium.llm import pieces as P
    lib = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rng = random.Random(1)
    texts = [None, "", " ", "\n", " \n", "▁▁a ▁b", "  Hello   world\n\n x 　é🤗", "    " * 20 + "x", "a" * 5000, "日本語テスト" * 50, "<s>x</s>", " " * 300, "\x00", "x" + " " * 37 + "y"]
    texts += ["".join(rng.choice(["a", "b", " ", "  ", "\n", "é", "the", "▁", "🤗", "1", "ing", " t", "\t", "Ω"]) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    texts += [t for _, t in ROWS]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, other int").repartition(3)
    for r in P.decode_ids(P.encode_texts(df)).collect():
        t = texts[r.doc_id] or ""
        assert r.ids == lib.encode(t) and r.decoded == t.replace("▁", " ")
    assert P.decode_ids(P.encode_texts(df.limit(0))).count() == 0
    nothing = spark.createDataFrame([(None,)], T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    assert P.decode_ids(nothing).head().decoded is None


def test_components(spark):
    from scriptorium.llm.common import Scratch, components
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(500, k) for k in range(501, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            hi, lo = max(find(a), find(b)), min(find(a), find(b))
            root[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in root}
