"""Text primitives and strict JSON actions: native expressions vs the Python rule."""

import json
import random
import urllib.parse

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.actions import parse_action, parse_action_text, with_action
from scriptorium.functions.chat import alternate_roles, render

ALPHABET = list("ab Z9 \t\n\r\x0b\x0c  é字ß-_.~/*+%\"'") + ["Query: "]


def _rand_strings(n, seed=7):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_strip_letters_prefix_multiline_vs_python(spark):
    vals = _rand_strings(300)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s string")
    out = df.select("i", tx.py_strip(F.col("s")).alias("st"), tx.letter_count(F.col("s")).alias("lc"),
                    tx.remove_prefix(F.col("s"), "Query: ").alias("rp"), tx.prefix(F.col("s"), 5).alias("p5"),
                    tx.is_empty_or_multiline(F.col("s")).alias("em")).collect()
    for r in out:
        s = vals[r["i"]]
        assert r["st"] == s.strip(), repr(s)
        assert r["lc"] == sum(c.isalpha() for c in s), repr(s)
        assert r["rp"] == s.removeprefix("Query: ")
        assert r["p5"] == s[:5]
        assert r["em"] == (len(s) == 0 or "\n" in s)


def test_url_quote_matches_urllib(spark):
    vals = ["a b/c~d*e+f", "é 字", "x%y&z=1", "plain"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(tx.url_quote(F.col("s"))).collect()]
    assert got == [urllib.parse.quote(v) for v in vals]


def test_latex_subset_and_citation(spark):
    df = spark.createDataFrame([(r"Deep \emph{Residual} Learning with $\alpha$ {Nets}",)], "t string")
    assert df.select(tx.latex_to_text(F.col("t"))).first()[0] == "Deep Residual Learning with Nets"


def test_embedding_content_null_and_empty(spark):
    df = spark.createDataFrame([("T", None), ("T", ""), ("T", "abs")], "title string, abstract string")
    got = [r[0] for r in df.select(tx.embedding_content(F.col("title"), F.col("abstract"))).collect()]
    assert got == ["T", "T", "T abs"]


CASES = [
    ('{"reason": "r", "action": {"name": "search_relevance", "query": "a b"}}', True, True, "a b"),
    ('{"reason": "r", "action": {"name": "x", "query": "a"}} tail', False, False, None),
    ("{'reason': 'r', 'action': {'name': 'x', 'query': 'a'}}", False, False, None),
    ('{"action": {"name": "x", "query": "a"}}', True, False, "a"),
    ('{"reason": null, "action": {"name": "x", "query": "a"}}', True, True, "a"),
    ('{"reason": "r", "action": {"name": "x", "query": 12}}', True, True, None),
    ('{"reason": "r", "action": ["query"]}', True, False, None),
    ('[1, 2]', True, False, None),
    ('{"reason": NaN, "reason": "dup", "action": {"name": "x", "query": "q"}}', True, True, "q"),
    (None, False, False, None),
]


def test_parse_action_golden():
    for text, parsed, keys, query in CASES:
        a = parse_action_text(text)
        assert a["parsed"] is parsed, text
        assert a["search_keys"] is keys, text
        assert a["query"] == query, text


def test_parse_action_udf_matches_python(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, s string")
    rows = df.select("i", parse_action(F.col("s")).alias("a")).collect()
    for r in rows:
        assert r["a"].asDict() == parse_action_text(CASES[r["i"]][0])


HARD = ['{"a":1}] foo', '{"a":1}} foo', '{"a":1},2', '{"a":1},"k2":3', '1}{', '1] , [2', "", " ", "null", '"x"', "NaN", "-Infinity", '{"a":NaN}', "tru", "[1", "-", "{}", "nan", "NaN tail", " Infinity ", "7" * 5000, '{"a": ' + "7" * 5000 + "}", '"a" b',
        '{"reason": 1.50, "action": {"name": null, "query": null, "paper_id": "7"}}', '{"reason": {"b": [1, true]}, "action": {"name": "x", "query": "\\u00e9"}}',
        '{"reason": true, "action": {"name": "x", "query": "q", "paper_id": 7}}', '{"action": {"query": "a", "query": "b", "name": "n"}, "reason": ""}',
        '{"a": 12345678901234567890123456789012345678901234567890}', '{"a": 1e400}', '{"a": 01}', '{"a": "x\ty"}', '{"a":1}//c', '\ufeff{"a":1}', '{"a":1,}',
        '{"action": "query name paper_id", "reason": "r"}', '{"action": [{"query": 1}], "reason": "r"}', '{"reason":"x\0y"}', '{"k": {"action": {"query": "q"}}}',
        ' \n{"reason": "é日", "action": {"name": "search", "query": "q\\n"}}\t', '\x0b{"a": 1}', '{"action": {"query": "\\ud83d\\ude00", "name": "n"}, "reason": "r"}',
        "[" * 900 + "]" * 900, '{"reason": "r", "action": {"name": "n", "query": "' + "w " * 50_000 + '"}}']


def test_native_parse_equals_python(spark):
    texts = [c[0] for c in CASES] + HARD
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    rows = with_action(df, "s", "a").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["a"].asDict() == parse_action_text(texts[r["i"]]), texts[r["i"]][:80]


def test_plain_responses_need_no_python(spark):
    plain = ['{"reason": "r", "action": {"name": "search_relevance", "query": "a b"}}', "I would search for it.", None, '{"reason": null}']
    df = spark.createDataFrame([(t,) for t in plain], "s string")
    got = with_action(df, "s", "a")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 4
    tail = with_action(df.union(spark.createDataFrame([(plain[0] + " tail",)], "s string")), "s", "a")
    assert "Python" in tail._jdf.queryExecution().executedPlan().toString() and tail.where("a.parsed").count() == 2


def test_numeric_paper_id_is_not_a_string():
    a = parse_action_text(json.dumps({"reason": "r", "action": {"name": "select_paper", "paper_id": 12}}))
    assert a["select_keys"] and a["paper_id"] is None


def test_chat_roles_and_render(spark):
    df = spark.createDataFrame([(["hi", "hello", "q"],)], "m array<string>")
    msgs = df.select(alternate_roles(F.col("m")).alias("x")).first()["x"]
    assert [m["role"] for m in msgs] == ["system", "user", "assistant", "user"]
    text = df.select(render(alternate_roles(F.col("m"), None))).first()[0]
    assert text == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nq<|end|>\n"
