"""Model actions as JSON: strict parsing (X7) and building.

The contract is that of Python's ``json.loads``: which keys are reachable and the *type* of each value.  ``from_json``
is too lenient for it (single quotes, trailing text, numbers read as strings); a VARIANT keeps types, and a text is
one JSON value exactly if it parses both as the one element of an array and as a value in an object.  What remains
undecided that way, repeated keys, NaN, a reason that is no string (its ``str()`` is wanted) or halves of surrogate
pairs, is parsed in Python, and only if a batch holds such rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTION_TYPE = T.StructType([
    T.StructField("parsed", T.BooleanType()),          # json.loads succeeded
    T.StructField("search_keys", T.BooleanType()),     # action.query, action.name, reason reachable
    T.StructField("select_keys", T.BooleanType()),     # action.paper_id, action.name, reason reachable
    T.StructField("paper_id_key", T.BooleanType()),    # action.paper_id reachable
    T.StructField("query", T.StringType()),            # action.query when a string
    T.StructField("query_is_str", T.BooleanType()),
    T.StructField("name", T.StringType()),             # action.name when a string
    T.StructField("paper_id", T.StringType()),         # action.paper_id when a string
    T.StructField("reason", T.StringType()),           # str(reason); '' for null, as a CSV writer gives
])


def _get(obj, *path):
    """Key access like ``obj[a][b]``: only dicts are indexable by a key."""
    for k in path:
        if not isinstance(obj, dict) or k not in obj:
            raise KeyError(k)
        obj = obj[k]
    return obj


def _reachable(obj, *path) -> bool:
    try:
        _get(obj, *path)
        return True
    except KeyError:
        return False


def parse_action_text(s: str | None) -> dict:
    out = dict(parsed=False, search_keys=False, select_keys=False, paper_id_key=False, query=None,
               query_is_str=False, name=None, paper_id=None, reason=None)
    if s is None:
        return out
    try:
        obj = json.loads(s)
    except (ValueError, TypeError, RecursionError):
        return out
    out["parsed"] = True
    has_name = _reachable(obj, "action", "name")
    has_reason = _reachable(obj, "reason")
    has_query = _reachable(obj, "action", "query")
    has_pid = _reachable(obj, "action", "paper_id")
    out["search_keys"] = has_query and has_name and has_reason
    out["select_keys"] = has_pid and has_name and has_reason
    out["paper_id_key"] = has_pid
    if has_query:
        q = _get(obj, "action", "query")
        out["query_is_str"] = isinstance(q, str)
        out["query"] = q if isinstance(q, str) else None
    if has_name:
        n = _get(obj, "action", "name")
        out["name"] = n if isinstance(n, str) else None
    if has_pid:
        p = _get(obj, "action", "paper_id")
        out["paper_id"] = p if isinstance(p, str) else None
    if has_reason:
        r = _get(obj, "reason")
        out["reason"] = "" if r is None else (r if isinstance(r, str) else str(r))
    return out


@F.pandas_udf(ACTION_TYPE)
def parse_action(s: pd.Series) -> pd.DataFrame:
    """Strict JSON action parse (X7), vectorised over Arrow batches."""
    return pd.DataFrame([parse_action_text(v) for v in s.tolist()], columns=ACTION_TYPE.fieldNames())


#: How a text begins that could be JSON to Python but not to a VARIANT, and the bare values that are.
_JSON_START = r"^[ \t\n\r]*[{\[]"
_BARE = r"^[ \t\n\r]*(NaN|-?Infinity)[ \t\n\r]*$"
_HALF_PAIR = r"\\u[dD][89a-fA-F]"
#: Digits of a whole number beyond which Python refuses it.
_MAX_DIGITS = 4300


def _native(v: Column, sound: Column) -> Column:
    """``ACTION_TYPE`` from the VARIANT of ``{"k": text}``."""
    def at(path: str) -> Column:
        return F.when(sound, F.try_variant_get(v, f"$.k.{path}", "variant"))

    def text(path: str) -> Column:
        return F.when(is_text(path), F.try_variant_get(v, f"$.k.{path}", "string"))

    def is_text(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(at(path)) == "STRING", F.lit(False))
    query, name, paper, reason = (at(p).isNotNull() for p in ("action.query", "action.name", "action.paper_id", "reason"))
    return F.struct(sound.alias("parsed"), (query & name & reason).alias("search_keys"), (paper & name & reason).alias("select_keys"),
                    paper.alias("paper_id_key"), text("action.query").alias("query"), is_text("action.query").alias("query_is_str"),
                    text("action.name").alias("name"), text("action.paper_id").alias("paper_id"),
                    F.when(is_text("reason"), text("reason")).when(reason, F.lit("")).alias("reason"))


def with_action(df: DataFrame, response: str, out: str) -> DataFrame:
    """``df`` with ``out``: the strict parse of ``response``.

    ``df`` must be cheap to read again (a checkpoint): one pass looks for rows that need Python, and without any the
    plan has no Python in it.  Else, and on a stream, every batch goes through it, with those rows' texts alone: a filter
    would parse each response again for every use of the parse in its condition."""
    s, v, ok, ask = F.col(response), f"_{out}_v", f"_{out}_ok", f"_{out}_ask"
    rows = df.withColumn(v, F.try_parse_json(F.concat(F.lit('{"k":'), s, F.lit("}"))))
    alone = F.size(F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))).try_cast("array<variant>")) == 1
    rows = rows.withColumn(ok, F.coalesce((F.col(v).isNotNull() & alone) | s.rlike(_BARE), F.lit(False)))
    reason = F.schema_of_variant(F.try_variant_get(v, "$.k.reason", "variant"))
    long = (F.length(s) > _MAX_DIGITS) & s.rlike(f"[0-9]{{{_MAX_DIGITS}}}")
    undecided = F.when(F.col(ok), ~F.coalesce(reason.isin("STRING", "VOID"), F.lit(True)) | s.rlike(_HALF_PAIR) | long).otherwise(s.rlike(_JSON_START))
    rows = rows.withColumn(ask, F.coalesce(undecided, F.lit(False)))
    native, extra = _native(F.col(v), F.col(ok)), [v, ok, ask]
    if not df.isStreaming and rows.where(F.col(ask)).isEmpty():
        return rows.withColumn(out, native).drop(*extra)
    asked = parse_action(F.when(F.col(ask), s))
    return rows.withColumn(out, F.when(F.col(ask), asked).otherwise(native)).drop(*extra)


def format_action(query: Column, action: Column, reason: Column) -> Column:
    """``{"reason": r, "action": {"name": a, "query": q}}`` (X8); key order kept."""
    return F.to_json(F.struct(reason.alias("reason"),
                              F.struct(action.alias("name"), query.alias("query")).alias("action")))


def format_select(paper_id: Column, reason: Column) -> Column:
    """``{"reason": r, "action": {"name": "select_paper", "paper_id": id}}``."""
    return F.to_json(F.struct(reason.alias("reason"),
                              F.struct(F.lit("select_paper").alias("name"), paper_id.alias("paper_id")).alias("action")))
