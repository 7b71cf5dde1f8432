"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept,
       sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)"""

# kind, pattern, context words, score in percent, bonus-free acceptance test over match m (digits dg)
_PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "mail|contact|write to", 90, "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "ip|host|server|address|login", 60,
     "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS INTEGER), 0) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "card|visa|master|payment|credit", 70,
     "length(dg) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda i: "
     "CASE WHEN (length(dg) - i) % 2 = 1 THEN CASE WHEN CAST(substring(dg, i, 1) AS INTEGER) > 4 "
     "THEN 2 * CAST(substring(dg, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substring(dg, i, 1) AS INTEGER) END "
     "ELSE CAST(substring(dg, i, 1) AS INTEGER) END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "phone|tel|call|mobile|fax", 60, "length(dg) BETWEEN 9 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}\b", "iban|bank|account|transfer", 80,
     "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substring(replace(m, ' ', ''), 5) || substring(replace(m, ' ', ''), 1, 4), ''), "
     "lambda c: CAST(CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))), "
     "lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "ssn|social security", 30, "true"),
]


def _pii_kind(k: int, kind: str, pattern: str, words: str, score: int, test: str) -> str:
    total = f"least(100, {score} + CASE WHEN regexp_matches(lower(right(gap, 40)), '{words}') THEN 20 ELSE 0 END)"
    keep = "" if kind in ("email", "ip", "card", "phone") else f" AND {total} >= 50"
    return f"""
SELECT doc_id, {k} AS ord, '{kind}' AS kind, s, s + length(m) AS e, {total} AS score FROM (
  SELECT doc_id, m, gap, regexp_replace(m, '[^0-9]', '', 'g') AS dg,
         CAST(sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS s
  FROM (SELECT doc_id, rid, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i
        FROM (SELECT doc_id, rid, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d)
        WHERE len(ms) > 0)
  WINDOW w AS (PARTITION BY rid ORDER BY i))
WHERE {test}{keep}"""


OP3 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_pii_kind(k, *x) for k, x in enumerate(_PII))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
             count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
             coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (ord < 4), '') AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) AS spans,
             string_agg(CAST(score AS VARCHAR), ',' ORDER BY ord, s) AS scores
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (doc_id)"""


def _fill(rel: str, family: str, name: str) -> str:
    """Water-filling of one level over rel(family..., name, cap, w, budget)."""
    return f"""
SELECT *, CASE WHEN fl THEN cap ELSE coalesce(lft * w // nullif(opn, 0), 0) END AS alloc FROM (
  SELECT *, budget - sum(CASE WHEN fl THEN cap ELSE 0 END) OVER (PARTITION BY {family}) AS lft,
         sum(CASE WHEN fl THEN 0 ELSE w END) OVER (PARTITION BY {family}) AS opn
  FROM (SELECT *, w > 0 AND cap * sum(w) OVER (PARTITION BY {family} ORDER BY cap / nullif(w, 0), {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
               <= (budget - coalesce(sum(cap) OVER (PARTITION BY {family} ORDER BY cap / nullif(w, 0), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS fl
        FROM {rel}))"""


def op6(weights: dict, epochs: int) -> str:
    def weight(cols):
        cases = ""
        for path, w in reversed(list(weights.items())):
            path = (path,) if isinstance(path, str) else path
            if len(path) == len(cols):
                cases += " WHEN " + " AND ".join("true" if v == "*" else f"{c} = '{v}'" for c, v in zip(cols, path, strict=True)) + f" THEN {w}"
        return f"CASE{cases} ELSE 1 END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  CASE WHEN right(source, 1) BETWEEN '0' AND '4' THEN 'web' WHEN right(source, 1) BETWEEN '5' AND '7' THEN 'reference' ELSE 'forum' END AS domain,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
s0 AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS have, CAST(sum(n_tokens) * {epochs} AS BIGINT) AS cap, {weight(["domain", "lang", "source"])} AS w
       FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
l0 AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, {weight(["domain", "lang"])} AS w FROM s0 GROUP BY ALL),
d0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {weight(["domain"])} AS w, 0 AS root, (SELECT CAST(sum(have) AS BIGINT) FROM s0) AS budget FROM l0 GROUP BY ALL),
d1 AS ({_fill("d0", "root", "domain")}),
l1 AS (SELECT l0.*, d1.alloc AS budget FROM l0 JOIN d1 USING (domain)),
l2 AS ({_fill("l1", "domain", "lang")}),
s1 AS (SELECT s0.*, l2.alloc AS budget FROM s0 JOIN l2 USING (domain, lang)),
s2 AS ({_fill("s1", "domain, lang", "source")}),
p AS (SELECT domain, lang, source, CAST(alloc // have AS BIGINT) AS f, alloc % have AS rest FROM s2),
k AS (SELECT d.*, f, rest, md5('mix|' || f || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM d JOIN p USING (domain, lang, source)),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest AS part FROM k)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, f + CASE WHEN part THEN 1 ELSE 0 END)) AS BIGINT) AS epoch FROM c"""


def op9(budget: int, history: int, block: int) -> str:
    esc = lambda c: f"replace(replace(replace({c}, '\\', '\\\\'), '</turn>', '\\e'), '##', '\\h')"
    back = " + ".join(f"CASE WHEN pos > {j} AND NOT (pos = {j + 1} AND sys IS NOT NULL) AND cum - c{j} + own <= {budget} THEN 1 ELSE 0 END" for j in range(1, history + 1))
    held = " ".join(f"WHEN {j} THEN cum - c{j}" for j in range(1, history + 1))
    return f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
k AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 4 AS tok,
             4 + length(replace({esc("role")}, ':', '\\c')) + 2 + length({esc("text")}) + 8 AS chars,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
c AS (SELECT *, sum(tok) OVER w - tok AS cum, sum(chars) OVER w AS upto, max(CASE WHEN pos = 1 AND role = 'system' THEN tok END) OVER (PARTITION BY conv_id) AS sys,
             max(CASE WHEN pos = 1 THEN chars END) OVER (PARTITION BY conv_id) AS sys_chars
      FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, {", ".join(f"lag(cum, {j}) OVER w AS c{j}" for j in range(1, history + 1))}, pos > 1 AND coalesce(sys + tok <= {budget}, false) AS lead,
             tok + CASE WHEN pos > 1 AND coalesce(sys + tok <= {budget}, false) THEN sys ELSE 0 END AS own FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
b AS (SELECT *, {back} AS back FROM l),
o AS (SELECT *, own + CASE back {held} ELSE 0 END AS held FROM b),
r AS (SELECT conv_id, pos, pos AS win, held AS used FROM o WHERE pos = 1
      UNION ALL SELECT o.conv_id, o.pos, CASE WHEN fresh THEN o.pos ELSE win END, CASE WHEN fresh THEN held ELSE used + tok END
      FROM (SELECT o.*, r.win, r.used, (o.pos - 1) % {block} = 0 OR r.used + o.tok > {budget} AS fresh
            FROM r JOIN o ON o.pos = r.pos + 1 AND o.conv_id IS NOT DISTINCT FROM r.conv_id) AS o),
s AS (SELECT conv_id, win, max(pos) AS last FROM r GROUP BY ALL),
z AS (SELECT s.conv_id, sum(e.upto - f.upto + f.chars + CASE WHEN o.lead THEN o.sys_chars ELSE 0 END) AS chars
      FROM s JOIN o ON o.pos = s.win AND o.conv_id IS NOT DISTINCT FROM s.conv_id
             JOIN o AS e ON e.pos = s.last AND e.conv_id IS NOT DISTINCT FROM s.conv_id
             JOIN o AS f ON f.pos = s.win - o.back AND f.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY s.conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss FROM k GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(z.chars AS BIGINT) AS formatted_chars
FROM g JOIN z ON g.conv_id IS NOT DISTINCT FROM z.conv_id"""


OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 10"""


def _divergence(p: str, q: str) -> str:
    """Jensen-Shannon divergence of two lists of counts."""
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * ln({a} / (({a} + {b}) / 2)) ELSE 0 END"
    x, y = f"({p}[i] / list_sum({p}))", f"({q}[i] / list_sum({q}))"
    bits = f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({part(x, y)} + {part(y, x)}) / 2)) / ln(2)"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN greatest({bits}, 0) END"


def op11(common: int, word_chars: int) -> str:
    classes = [r"[a-z]", r"[\x20\x09-\x0D]", r"[A-Z]", r"[.,;:!?''\"()-]", r"[0-9]", r"[^\x00-\x7F]"]
    counts = ", ".join(f"length(regexp_replace(t, '[^' || substring('{c}', 2), '', 'g'))" for c in classes[:5])
    counts += f", length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g'))"
    return f"""
WITH d0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
d AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [{counts}] AS c5,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d0),
e AS (SELECT *, list_append(c5, length(t) - list_sum(c5)) AS c FROM d),
v AS (SELECT lang, CASE WHEN length(x) <= {word_chars} AND NOT contains(x, ',') THEN x END AS x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM e) GROUP BY ALL),
r AS (SELECT lang, list(x ORDER BY n DESC, x) AS top, list(n ORDER BY n DESC, x) AS ns FROM (
        SELECT * FROM v WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) <= {common}) GROUP BY lang),
a AS (SELECT lang, sum(n) AS total FROM v GROUP BY lang HAVING sum(n) >= 2000),
k AS (SELECT lang, list(s ORDER BY i) AS chars FROM (SELECT lang, i, sum(c[i]) AS s FROM e, range(1, 8) AS z(i) GROUP BY lang, i) GROUP BY lang),
ref AS (SELECT lang, top, list_append(ns, total - list_sum(ns)) AS words, chars FROM r JOIN a USING (lang) JOIN k USING (lang)),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM e)),
rep AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1), range(3) AS z(j) GROUP BY rid),
h AS (SELECT e.*, len(w) AS nw, coalesce(n_repeat_words, 0) AS nr, top, words, chars,
             list_transform(top, lambda x: len(list_filter(w, lambda y: y = x))) AS f FROM e LEFT JOIN rep USING (rid) LEFT JOIN ref USING (lang)),
j AS (SELECT *, list_append(f, nw - list_sum(f)) AS p FROM h),
m AS (SELECT *, CASE WHEN nw >= 50 THEN {_divergence("c", "chars")} END AS cd, CASE WHEN nw >= 50 THEN {_divergence("p", "words")} END AS wd,
             nw < 50 OR 100 * nr > 50 * nw AS base_failed FROM j)
SELECT doc_id, nw AS n_words, CAST(length(t) - c[2] AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, nr AS n_repeat_words, base_failed, round(sqrt(cd), 5) AS char_distance,
       round(sqrt(wd), 5) AS word_distance,
       NOT (base_failed OR coalesce(cd > 0.25 * 0.25 + 7 / (4 * nw), false) OR coalesce(wd > 0.22 * 0.22 + len(p) / (4 * nw), false)) AS kept
FROM m"""
