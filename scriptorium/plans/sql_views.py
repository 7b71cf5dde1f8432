"""DuckDB definitions of the derived tables, for the oracle SQL.

Each entry is one CTE body over the pre-registered given tables; ``with_views``
prepends the ones a statement needs.  They restate ``sources.tables`` in SQL.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "papers": """
        SELECT CAST(doc_id AS VARCHAR) AS paperId, doc_id AS seq,
               split_part(text, chr(10), 1) AS title,
               CASE WHEN instr(text, chr(10)) > 0 THEN substring(text, instr(text, chr(10)) + 1) END AS abstract,
               CAST(2015 + doc_id % 10 AS INTEGER) AS year,
               CAST((doc_id * 7919) % 200 AS INTEGER) AS citationCount,
               lang AS fieldOfStudy
        FROM documents""",
    "citations": """
        SELECT doc_id AS seq, CAST(doc_id // 8 AS VARCHAR) AS citedPaperId,
               CAST(doc_id AS VARCHAR) AS citingPaperId,
               split_part(text, chr(10), 1) AS citingTitle,
               list_filter(string_split(text, chr(10)), lambda x: length(x) > 0) AS contexts
        FROM documents""",
    "eval_set": """
        SELECT item_id, text AS excerpt,
               CASE WHEN item_id % 2 = 1 THEN 'train' ELSE 'test' END AS split,
               CAST(2016 + item_id % 5 AS INTEGER) AS year
        FROM benchmark""",
    "gold": """
        SELECT g.item_id, g.paperId, p.title, g.query, g.excerpt, g.reason
        FROM (SELECT b.item_id, CAST(min(d.doc_id) AS VARCHAR) AS paperId,
                     array_to_string(string_split(b.text, ' ')[1:3], ' ') AS query,
                     b.text AS excerpt, 'r' || CAST(b.item_id AS VARCHAR) AS reason
              FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0
              GROUP BY b.item_id, b.text) g
        JOIN papers p ON p.paperId = g.paperId""",
}

# dependency order
_ORDER = ["papers", "citations", "eval_set", "gold"]
_DEPS = {"gold": ["papers"]}


def with_views(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH v1 AS (...), v2 AS (...) <body>`` for the named views and extras."""
    need: set[str] = set()

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        need.add(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _ORDER if n in need]
    ctes += [f"{n} AS ({sql})" for n, sql in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body


def sql_str(s: str) -> str:
    """A DuckDB string expression for ``s`` (quotes doubled, newlines as chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")"


META_JSON = """CAST(CASE WHEN abstract IS NULL
     THEN to_json(struct_pack(paperId := paperId, title := title, year := year, citationCount := citationCount))
     ELSE to_json(struct_pack(paperId := paperId, title := title, year := year, citationCount := citationCount,
                              abstract := abstract)) END AS VARCHAR)"""
