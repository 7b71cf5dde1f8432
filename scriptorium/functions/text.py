"""String Column builders.

All are native Spark expressions: they stay inside whole-stage codegen.
``substring``/``length`` count code points, as Python slices do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace set, as a Java regex class: \s plus the Unicode spaces.
_WS = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f]"


def remove_prefix(c: Column, prefix: str) -> Column:
    """``s.removeprefix(prefix)``: once, case-sensitive."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def prefix(c: Column, n: int | None) -> Column:
    """``s[:n]`` in code points (X2); the whole text for None."""
    return c if n is None else F.substring(c, 1, n)


def py_strip(c: Column) -> Column:
    """``str.strip()`` - Spark ``trim`` only removes spaces."""
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def letter_count(c: Column) -> Column:
    """Number of Unicode letters, ``sum(ch.isalpha())``."""
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def is_empty_or_multiline(c: Column) -> Column:
    """``len(q) == 0 or '\\n' in q``."""
    return (F.length(c) == 0) | F.contains(c, F.lit("\n"))


def url_quote(c: Column) -> Column:
    """``urllib.parse.quote(s)`` (X6): form-encoding, then the differences."""
    e = F.url_encode(c)
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("%2F"), F.lit("/"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    return F.replace(e, F.lit("*"), F.lit("%2A"))


def embedding_content(title: Column, abstract: Column) -> Column:
    """Title, plus a space and the abstract when that is non-empty."""
    return F.concat(title, F.when(F.coalesce(F.length(abstract), F.lit(0)) > 0,
                                  F.concat(F.lit(" "), abstract)).otherwise(F.lit("")))


def latex_to_text(c: Column) -> Column:
    """Plain-text subset of LaTeX markup (X18): commands keep their argument,
    braces and math dollars go, runs of spaces collapse."""
    s = F.regexp_replace(c, r"\\[a-zA-Z]+\*?\s*\{([^{}]*)\}", "$1")
    s = F.regexp_replace(s, r"\\([%&$#_{}])", "$1")
    s = F.regexp_replace(s, r"\\[a-zA-Z]+\*?", "")
    s = F.regexp_replace(s, r"[{}$]", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def citation_string(title: Column, authors: Column, published: Column,
                    short_id: Column, entry_id: Column) -> Column:
    """``"{authors}. ({year}). {title}. arXiv:{id}. Retrieved from {url}"``."""
    names = F.array_join(F.transform(authors, lambda a: a["name"]), ", ")
    return F.concat(names, F.lit(". ("), F.year(published).cast("string"), F.lit("). "),
                    title, F.lit(". arXiv:"), short_id, F.lit(". Retrieved from "), entry_id)


def record_id(*parts: Column | str) -> Column:
    """``#``-joined identifier."""
    return F.concat_ws("#", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def terms(c: Column) -> Column:
    """Search terms: ASCII alphanumeric runs, lower-cased, empties dropped."""
    return F.filter(F.transform(F.split(c, "[^A-Za-z0-9]+"), lambda t: F.lower(t)),
                    lambda t: F.length(t) > 0)


def run_stamp(fmt: str = "yyyyMMdd_HHmmss", at: Column | None = None) -> Column:
    """Date stamp (X14) of ``at``, now if not given, e.g. ``MM-dd-yyyy`` for index names; paths take a run id argument."""
    return F.date_format(F.current_timestamp() if at is None else at, fmt)
