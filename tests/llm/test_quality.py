"""Quality rules against SQL and plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb

from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"


def base(t: str | None) -> tuple:
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {i + j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside),
            len(w) < 50 or 100 * len(inside) > 50 * len(w))


def test_base_counts(spark):
    """Nulls, empty, blank, very long and repeated rows, clashing columns."""
    from scriptorium.llm.quality import quality_rules
    rows = H.corpus() + [(800, "a b c a b c a b"), (801, "x x x x"), (802, "x x x"), (803, "l\nl\n \n\nl\r\n|| <>"), (804, "a\x0bb\x0cc\xa0d 日 #"), (805, "w x y " * 9000)]
    docs = H.frame(spark, rows).withColumnRenamed("key", "n_repeat").withColumnRenamed("source", "_row").withColumnRenamed("_id", "_words")
    got = quality_rules(docs, carry=[docs["doc_id"], docs["text"].alias("said")])
    assert Counter(tuple(r)[:8] for r in got.collect()) == Counter((d, t, *base(t)) for d, t in rows)
    whole = quality_rules(docs)
    assert whole.columns[:len(docs.columns)] == docs.columns and whole.count() == len(rows)
    assert quality_rules(docs.limit(0)).count() == 0


def test_divergence(spark):
    from pyspark.sql import functions as F

    from scriptorium.llm.quality import divergence
    cases = [([1, 2, 3], [1, 2, 3]), ([1, 0], [0, 5]), ([4, 1, 0, 7], [1, 9, 2, 0]), ([0, 0], [1, 1])]
    df = spark.createDataFrame(cases, "p array<long>, q array<long>")
    for (p, q), got in zip(cases, [r[0] for r in df.select(divergence(F.col("p"), F.col("q"))).collect()], strict=True):
        if not sum(p):
            assert got is None
            continue
        x, y = [v / sum(p) for v in p], [v / sum(q) for v in q]
        want = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(x, y, strict=True)) / 2
        assert math.isclose(got, want, abs_tol=1e-12)


def test_verdicts(spark):
    """Text unlike its language goes, short text and small languages get no verdict, clean text stays."""
    from scriptorium.llm.quality import quality_rules
    import random
    rng = random.Random(1)
    vocab = ["the", "of", "and", "to", "in"] * 8 + ["".join(rng.choices("abcdefgh", k=6)) for _ in range(200)]
    clean = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    rows = [(i, clean(rng.randint(60, 300)), "en") for i in range(60)]
    rows += [(100, clean(200).upper(), "en"), (101, " ".join(w + "$$$" for w in clean(200).split()), "en"), (102, " ".join(f"qzx{i}" for i in range(300)), "en"),
             (103, "THE END $$$", "en"), (104, clean(200).upper(), "rare"), (105, clean(200).upper(), None), (106, "?!. " * 200, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert all(got[i].kept for i in range(60))
    assert not any(got[i].kept or got[i].base_failed for i in (100, 101, 102))
    assert got[103].base_failed and got[103].char_distance is None
    assert got[104].kept and got[104].char_distance is None and got[105].kept
    assert got[106].word_distance > 0.3 and not got[106].kept


def test_oracle_and_plan(spark):
    from scriptorium.llm import queries as q
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    rel = con.execute(q.ORACLE["op11_quality_rules"])
    cols = [d[0] for d in rel.description]
    got = q.QUERIES["op11_quality_rules"](spark, SF)
    assert Counter(tuple(r) for r in got.select(cols).collect()) == Counter(rel.fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))
