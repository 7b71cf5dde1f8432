"""The pipeline's stages on hostile tables: nulls, repeats, empty tables, extra columns with clashing names."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from tests.llm import helpers as H

EXTRA = ["_toxicity", "toxicity", "_id", "_key", "_doc", "_own", "_text", "ids", "decoded", "kept", "text_key", "n_tokens", "epoch", "domain", "_row", "a.b"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA)


@pytest.fixture(scope="module")
def rows():
    out = []
    for k, (d, t) in enumerate(H.corpus()):
        t = f"{t} idiot idiot" if k % 11 == 0 and t else t
        out.append((d, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else f"src{k % 3}", *[f"{c}{k % 2}" for c in EXTRA]))
    return out


def test_stages(spark, rows, tmp_path):
    import corpus_pipeline as C
    from scriptorium.llm.common import Scratch
    spark.createDataFrame([(d, int("idiot" in (t or ""))) for d, t, *_ in rows if d is not None], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scratch, docs = Scratch(spark, "test"), spark.createDataFrame(rows, SCHEMA)
    for name, stage in C.STAGES:
        before = [tuple(r) for r in docs.collect()]
        after = scratch.cut(stage(spark, docs, str(tmp_path)), name)
        got = [tuple(r) for r in after.collect()]
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and empty.columns == after.columns
        if name != "sentencepiece":
            assert after.columns == docs.columns and set(got) <= set(before)
        if name == "toxicity":
            assert Counter(got) <= Counter(before) and {r[:2] for r in before} - {r[:2] for r in got} <= {r[:2] for r in rows if "idiot" in (r[1] or "")}
            assert {(r[1] or "") for r in got} >= {"", "one", "a b c d"}
        if name == "exact_dedup":
            last = {}
            for r in before:
                last[r[1] or ""] = max(r[0] or -1, last.get(r[1] or "", -1))
            assert Counter((r[0] or -1, r[1] or "") for r in got) == Counter((d, t) for t, d in last.items())
        if name == "near_dedup":
            own = [(r[0], r[1]) for r in before]
            assert Counter(r[:2] for r in got) == Counter(x for x, c in zip(own, H.near_components(own), strict=True) if x[0] == c)
        if name == "mixing":
            assert max(Counter(got).values()) <= 4
        if name == "sentencepiece":
            assert sorted((r[0] or -1) for r in got) == sorted((r[0] or -1) for r in before) and all(r[3] for r in got)
        docs = after


def test_run_leaves_one_table(spark, rows, tmp_path):
    """``run`` keeps the last stage's input only; a table without rows goes through."""
    import corpus_pipeline as C
    from scriptorium.llm.common import shared_dir
    for name, part in (("full", rows), ("empty", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(r[0], 0) for r in part if r[0] is not None], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
        top = f"{shared_dir(spark).removeprefix('file://')}/llm"
        held = set(os.listdir(top)) if os.path.exists(top) else set()
        got = C.run(spark, at)
        assert (got.count() > 20) == bool(part)
        left = [f"{d}/{x}" for d in set(os.listdir(top)) - held for x in os.listdir(f"{top}/{d}")]
        assert len([x for x in left if not x.rsplit("/", 1)[1].startswith(".")]) == 1, left
