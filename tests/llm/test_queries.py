"""The registered queries against their SQL, and the pipeline against its stages by hand."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_pii", "op6_mixing", "op9_chat_format"])
def test_oracle(spark, name):
    from scriptorium.llm import queries as q
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(q.ORACLE[name])
    cols = [d[0] for d in rel.description]
    got = q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(tuple(r) for r in got.select(cols).collect()) == Counter(rel.fetchall())


@pytest.mark.parametrize("name", ["op3_pii", "op6_mixing", "op7_fingerprint", "op9_chat_format"])
def test_native_plans(spark, name):
    from scriptorium.llm import queries as q
    plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_near_and_repeats_on_documents(spark):
    from scriptorium.llm import queries as q
    rows = [tuple(r) for r in q.table(spark, SF, "documents").select("doc_id", "text").collect()]
    near = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in q.QUERIES["op2_near_dedup"](spark, SF).collect()}
    assert near == {d: (len(H.shingles(t)), c, d == c) for (d, t), c in zip(rows, H.near_components(rows), strict=True)}
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in q.QUERIES["op4_substring_dedup"](spark, SF).collect()}
    want = H.without_repeats([(t or "").encode() for _, t in rows])
    assert cut == {d: (n, gone, spans, H.sha(kept)) for (d, _), (n, gone, spans, kept) in zip(rows, want, strict=True)}


def test_remaining_queries(spark):
    from scriptorium.llm import queries as q
    docs, pages = q.table(spark, SF, "documents").count(), q.table(spark, SF, "pages").count()
    five = q.QUERIES["op5_sentencepiece"](spark, SF).collect()
    assert len(five) == docs and all(r.round_trip for r in five)
    assert q.QUERIES["op8_url_filter"](spark, SF).count() == pages
    seven = q.QUERIES["op7_fingerprint"](spark, SF).collect()
    assert len(seven) == docs and all(0 <= r.near_edited <= 1 for r in seven)


def test_pipeline(spark):
    """Each stage on its own input; exact and near stages against brute force."""
    import sentencepiece

    import corpus_pipeline as C
    from scriptorium.llm import pieces
    from scriptorium.llm.common import Scratch
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in C.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()] if seen[-1:] != ["sentencepiece"] else []
        after = scratch.cut(stage(spark, docs, SF), name)
        if name != "sentencepiece":
            assert after.columns == docs.columns
            got = Counter(tuple(r) for r in after.select("doc_id", "text").collect())
        if name == "toxicity":
            assert not got - Counter(before) and len(before) > sum(got.values()) > 0.8 * len(before)
        if name == "exact_dedup":
            last = {}
            for d, t in before:
                last[t or ""] = max(d, last.get(t or "", d))
            assert got == Counter((d, t) for d, t in before if last[t or ""] == d)
        if name == "near_dedup":
            assert got == Counter(x for x, c in zip(before, H.near_components(before), strict=True) if x[0] == c)
        if name == "mixing":
            assert set(got) <= set(before) and max(got.values()) <= 4
        if name == "sentencepiece":
            lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            text = dict(before)
            rows = after.collect()
            assert len(rows) == len(before) and all(r.ids == lib.encode(text[r.doc_id] or "") and r.round_trip for r in rows)
        docs = after
        seen.append(name)
    assert Counter(r.doc_id for r in C.run(spark, SF).collect()) == Counter(r.doc_id for r in docs.collect())
