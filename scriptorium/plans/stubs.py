"""Deterministic model stand-ins used by the registered queries and tests.

No model weights exist here; each stub is a small rule over its input that
the DuckDB oracle can restate, so the model-call path (Arrow batches into a
Python worker and back) is exercised and still checkable.
"""

from __future__ import annotations

import hashlib
import json

STUB_DIM = 64


def make_verdict_model():
    """Attribution verdict: ' YES' when the user message length is not a multiple of 3."""
    def predict(batch):
        out = []
        for messages in batch:
            user = next(m["content"] for m in messages if m["role"] == "user")
            out.append(" YES, attributable" if len(user) % 3 else " NO, not attributable")
        return out
    return predict


def make_letter_embedder():
    """Text -> 64-wide vector of letter counts: slot j counts chr(97 + j % 26)."""
    def predict(batch):
        out = []
        for text in batch:
            t = text or ""
            out.append([float(t.count(chr(97 + j % 26))) for j in range(STUB_DIM)])
        return out
    return predict


def make_query_writer():
    """Chat model turn 1: ``Query: `` + the excerpt's first three words;
    turn 2 (three messages): the first line of the title list."""
    def predict(batch):
        out = []
        for messages in batch:
            if isinstance(messages, str):
                messages = [{"role": "user", "content": messages}]
            turns = [m for m in messages if m["role"] != "system"]
            if len(turns) == 1:
                body = turns[0]["content"]
                start = body.index("EXCERPT START\n") + len("EXCERPT START\n")
                excerpt = body[start:body.rindex("\nEXCERPT END")]
                out.append("Query: " + " ".join(excerpt.split(" ")[:3]))
            else:
                out.append(turns[-1]["content"].split("\n")[0])
        return out
    return predict


def response_case(key: str, seed: str = "resp") -> int:
    """Which branch of the scoring ladder a stub response exercises (0..7)."""
    h = hashlib.md5(f"{seed}|{key}".encode()).hexdigest()
    return "0123456789abcdef".index(h[0]) % 8


def _first_words(s: str, n: int) -> str:
    return " ".join(s.split(" ")[:n])


def make_query_responder():
    """Query-writing model (M6) over struct(key, title, excerpt, prompt): the
    response exercises one branch of the R1 ladder chosen by ``response_case``."""
    def predict(batch):
        out = []
        for row in batch:
            t2 = _first_words(row["title"], 2)
            case = response_case(row["key"])
            if case in (0, 1, 2):
                name = "search_citation_count" if case == 1 else "search_relevance"
                q = _first_words(row["excerpt"], 3) if case == 2 else t2
                out.append(json.dumps({"reason": "title words", "action": {"name": name, "query": q}}))
            elif case == 3:
                out.append(json.dumps({"reason": "x", "action": {"name": "search_relevance", "query": t2}}) + " ok")
            elif case == 4:
                out.append(json.dumps({"action": {"name": "search_relevance", "query": t2}}))
            elif case == 5:
                out.append(json.dumps({"reason": "digits", "action": {"name": "search_relevance", "query": "1 2"}}))
            elif case == 6:
                out.append(json.dumps({"reason": "two lines",
                                       "action": {"name": "search_relevance", "query": "  " + t2 + "\nmore"}}))
            else:
                out.append(json.dumps({"reason": None, "action": {"name": "lookup", "query": "  " + t2 + "  "}}))
        return out
    return predict


def make_selection_responder():
    """Selection model (M6) over struct(key, target): response and baseline
    response exercise the R3 / R4 branches."""
    def predict(batch):
        out = []
        for row in batch:
            tid = row["target"]
            case = response_case(row["key"], "sel")
            ok = {"reason": "best match", "action": {"name": "select_paper", "paper_id": tid}}
            if case in (0, 7):
                r = json.dumps(ok)
            elif case == 1:
                r = json.dumps({"reason": "close", "action": {"name": "select_paper", "paper_id": tid + "x"}})
            elif case == 2:
                r = json.dumps({"reason": "number", "action": {"name": "select_paper", "paper_id": int(tid)}})
            elif case == 3:
                r = "{'reason': 'single quotes', 'action': {'name': 'select_paper', 'paper_id': '" + tid + "'}}"
            elif case == 4:
                r = json.dumps({"action": {"name": "select_paper", "paper_id": tid}})
            elif case == 5:
                r = json.dumps({"reason": "search", "action": {"name": "search_relevance", "paper_id": tid}})
            else:
                r = json.dumps({"reason": None, "action": {"name": "select_paper", "paper_id": tid}})
            ref_case = response_case(row["key"], "ref") % 3
            if ref_case == 0:
                ref = json.dumps({"action": {"name": "whatever", "paper_id": tid}})
            elif ref_case == 1:
                ref = json.dumps({"reason": "r", "action": {"name": "select_paper", "paper_id": "0" + tid}})
            else:
                ref = "not json"
            out.append(json.dumps([r, ref]))
        return out
    return predict
