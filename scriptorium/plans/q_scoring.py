"""Registered queries: response scoring, gold logs, selection, supervised text.

Model responses come from deterministic stub models (``plans.stubs``) that
pick a ladder branch from md5(key); the oracle SQL restates the branch rule
and computes the expected reward without parsing JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import chat
from scriptorium.functions.actions import format_action, format_select
from scriptorium.functions.draws import draw_key, uniform_int
from scriptorium.operators import corpus as co
from scriptorium.operators import prompts as pr
from scriptorium.operators import ranking as rk
from scriptorium.operators import scoring as sc
from scriptorium.operators import search as se
from scriptorium.operators.batching import minibatches
from scriptorium.operators.models import generate
from scriptorium.operators.sampling import draw_candidates
from scriptorium.plans import stubs
from scriptorium.plans.q_excerpts import _EX_CTES, _SHORT_SQL, SEED, short_training_rows
from scriptorium.plans.q_search import LISTING_BLOCK_SQL, RANKED_CTES, SEARCH_CTES, paper_index, ranked_gold
from scriptorium.plans import jobs
from scriptorium.plans.registry import register
from scriptorium.plans.sql_views import sql_str, with_views
from scriptorium.sources import tables as tb

_H = "'0123456789abcdef'"


def _case_sql(salt: str, key: str) -> str:
    return f"((instr({_H}, substring(md5('{salt}|' || {key}), 1, 1)) - 1) % 8)"


def _hex4_sql(h: str) -> str:
    return " + ".join(f"(instr({_H}, substring({h}, {i}, 1)) - 1) * {m}"
                      for i, m in ((1, 4096), (2, 256), (3, 16), (4, 1)))


def _coin_sql(salt: str, key: str) -> str:
    return f"((instr({_H}, substring(md5('{SEED}|{salt}|' || {key}), 1, 1)) - 1) % 2 = 1)"


# --------------------------------------------------------------------------- query reward

def training_responses(spark, sf_dir):
    """C8 input: short training rows, their query prompt (Q5) and stub responses (M6)."""
    s = short_training_rows(spark, sf_dir).select(
        F.col("cited.paperId").alias("paperId"), F.col("cited.title").alias("title"), "excerpt", "seq", "pos")
    key = F.concat_ws("|", F.col("seq").cast("string"), F.col("pos").cast("string"))
    s = s.withColumn("key", key).withColumn("prompt", pr.query_prompt(F.col("excerpt"), pr.action_menu(SEED, key)))
    s = tb.spread(s)                      # models run on all cores
    model_in = F.struct("key", "title", "excerpt", "prompt")
    return s.withColumn("response", generate(model_in, stubs.make_query_responder))


def scored_queries(spark, sf_dir, *carry):
    """The rewards, with the columns ``carry`` of the responses: the scoring keeps (checkpoints) its rows."""
    idx = paper_index(spark, sf_dir)
    rows = training_responses(spark, sf_dir).select("key", "paperId", "seq", "pos", "response", *carry)
    return jobs.score_query_responses(rows, idx, key="key")


_STRIP = "regexp_replace({q}, '^\\s+|\\s+$', '', 'g')"
_REWARD_CTES = f"""
s AS ({_SHORT_SQL}),
r AS (SELECT s.*, CAST(seq AS VARCHAR) || '|' || CAST(pos AS VARCHAR) AS key,
             {_case_sql('resp', "CAST(seq AS VARCHAR) || '|' || CAST(pos AS VARCHAR)")} AS c,
             array_to_string(string_split(cited_title, ' ')[1:2], ' ') AS t2,
             array_to_string(string_split(excerpt, ' ')[1:3], ' ') AS e3 FROM s),
rq AS (SELECT *, CASE WHEN c IN (0, 1, 3, 4) THEN t2 WHEN c = 2 THEN e3 WHEN c = 5 THEN '1 2'
                      WHEN c = 6 THEN '  ' || t2 || chr(10) || 'more' ELSE '  ' || t2 || '  ' END AS rawq FROM r),
sq AS (SELECT *, {_STRIP.format(q='rawq')} AS q FROM rq),
pre AS (SELECT *, CASE WHEN c IN (3, 4) THEN -1.0
                       WHEN length(q) = 0 OR contains(q, chr(10)) THEN -0.3
                       WHEN length(regexp_replace(q, '[^\\p{{L}}]', '', 'g')) < 2 THEN -0.3 END AS pre_reward,
               CASE WHEN c = 1 THEN true ELSE false END AS bycit,
               CASE WHEN c = 7 THEN '' WHEN c = 5 THEN 'digits' WHEN c = 6 THEN 'two lines'
                    WHEN c = 3 THEN 'x' WHEN c = 4 THEN NULL ELSE 'title words' END AS reason
        FROM sq),
qsrc AS (SELECT key AS qid, q AS query FROM pre WHERE pre_reward IS NULL),"""

_REWARD_BODY = """,
page AS (SELECT * FROM rel WHERE pos <= 100),
cit AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY citationCount DESC, pos) AS cpos FROM page),
scored AS (
  SELECT p.*, coalesce(t.total, 0) AS total,
         CASE WHEN p.bycit THEN c.cpos ELSE c.pos END AS rank
  FROM pre p LEFT JOIN tot t ON t.qid = p.key
       LEFT JOIN cit c ON c.qid = p.key AND c.paperId = p.cited_paperId),
rewarded AS (
  SELECT *, round(coalesce(pre_reward, CASE WHEN total = 0 THEN 0.1
                                            WHEN rank IS NOT NULL THEN 10.0 / sqrt(rank) + 1.0 / total
                                            ELSE 1.0 / ln(total + 1) + 0.3 END), 6) AS reward,
         pre_reward IS NULL AND rank IS NOT NULL AS found
  FROM scored)
"""


def _reward_sql(body: str) -> str:
    head = with_views(["papers", "citations"], "").rstrip("\n") + "," + _EX_CTES + "," + _REWARD_CTES
    return head + SEARCH_CTES + _REWARD_BODY + body


@register("query_reward", _reward_sql("SELECT seq, pos, CAST(reward AS DOUBLE) AS reward FROM rewarded"))
def query_reward(spark, sf_dir):
    """Parse, validate, search, reward."""
    return scored_queries(spark, sf_dir).select("seq", "pos", F.col("reward").cast("double"))


@register("gold_queries", _reward_sql("""
SELECT cited_paperId AS paperId, cited_title AS title, q AS query, excerpt, reason, seq, pos
FROM rewarded WHERE found"""))
def gold_queries(spark, sf_dir):
    """Queries that found their target, as the gold CSV rows."""
    s = scored_queries(spark, sf_dir, "title", "excerpt")
    return s.where("found").select("paperId", "title", "query", "excerpt", "reason", "seq", "pos")


@register("batch_reward_sums", _reward_sql(f"""
, nb AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || key), seq, pos) AS rn FROM rewarded),
bt AS (SELECT (rn - 1) // 4 AS batch_id, reward FROM nb)
SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) AS n, round(sum(reward), 6) AS total_reward
FROM bt GROUP BY batch_id""").replace("FROM scored)\n\n, nb AS", "FROM scored),\nnb AS"))
def batch_reward_sums(spark, sf_dir):
    """Seeded minibatches of 4 (the short last one too), reward sum per batch."""
    s = scored_queries(spark, sf_dir).select("seq", "pos", "reward", draw_key(SEED, F.col("key")).alias("draw"))
    b = minibatches(s, 4, "draw", ["seq", "pos"])
    return sc.batch_sums(b).select("batch_id", "n", F.col("total_reward").cast("double"))


@register("query_prompt_menu", with_views(["papers", "citations"], "").rstrip("\n") + "," + _EX_CTES + f""",
s AS ({_SHORT_SQL}),
k AS (SELECT s.*, CAST(seq AS VARCHAR) || '|' || CAST(pos AS VARCHAR) AS key FROM s),
f AS (SELECT *, {_coin_sql('count', 'key')} OR NOT {_coin_sql('relevance', 'key')} AS show_count,
             {_coin_sql('relevance', 'key')} AS show_rel FROM k)
SELECT seq, pos,
       {sql_str(pr.QUERY_PROMPT_HEAD)} || excerpt || {sql_str(pr.QUERY_PROMPT_TAIL)} || {sql_str(pr.MENU_HEAD)}
       || CASE WHEN show_count THEN {sql_str(pr.MENU_RELEVANCE)} ELSE '' END
       || CASE WHEN show_rel THEN {sql_str(pr.MENU_CITATION)} ELSE '' END AS prompt
FROM f""")
def query_prompt_menu(spark, sf_dir):
    """Q5: query-writing prompt with the seeded (crossed) action menu."""
    s = short_training_rows(spark, sf_dir)
    key = F.concat_ws("|", F.col("seq").cast("string"), F.col("pos").cast("string"))
    return s.select("seq", "pos", pr.query_prompt(F.col("excerpt"), pr.action_menu(SEED, key)).alias("prompt"))


# --------------------------------------------------------------------------- selection

def selection_rows(spark, sf_dir, k=None, ranked=None):
    """C10 (F7 F8 W8 Q6 Q7): the target and k-1 drawn others, in drawn order, with the prompt."""
    return jobs.selection_prompts(ranked_gold(spark, sf_dir) if ranked is None else ranked, seed=SEED, k=k)


_SEL_CTES = """,
sel AS (SELECT * FROM ranked WHERE (relevance_rank <= 10 OR citation_rank <= 10) AND relevance_rank >= 0),
kk AS (SELECT sel.*, {kexpr} AS k FROM sel),
oth AS (SELECT c.qid AS item_id, c.paperId,
               row_number() OVER (PARTITION BY c.qid ORDER BY md5('""" + SEED + """|o|' || CAST(c.qid AS VARCHAR) || '|' || c.paperId)) AS o
        FROM cit c JOIN kk ON kk.item_id = c.qid WHERE c.paperId <> kk.paperId),
picked AS (SELECT item_id, paperId FROM kk
           UNION ALL SELECT o.item_id, o.paperId FROM oth o JOIN kk ON kk.item_id = o.item_id WHERE o.o <= kk.k - 1),
cand AS (SELECT p.item_id, p.paperId, c.title, c.abstract, c.citationCount,
                row_number() OVER (PARTITION BY p.item_id
                                   ORDER BY md5('""" + SEED + """|s|' || CAST(p.item_id AS VARCHAR) || '|' || p.paperId)) AS spos
         FROM picked p JOIN cit c ON c.qid = p.item_id AND c.paperId = p.paperId)"""

_K_DRAW = "2 + (" + _hex4_sql(f"md5('{SEED}|k|' || CAST(sel.item_id AS VARCHAR))") + ") % 4"
_GOLD_Q = "SELECT item_id AS qid, query FROM gold"


def _sel_sql(body: str, kexpr: str = _K_DRAW) -> str:
    head = with_views(["papers", "gold"], "").rstrip("\n") + f",\nqsrc AS ({_GOLD_Q}),"
    return head + SEARCH_CTES + "\n" + RANKED_CTES + _SEL_CTES.replace("{kexpr}", kexpr) + body


@register("selection_candidates", _sel_sql("""
SELECT kk.item_id, CAST(kk.k AS INTEGER) AS k, string_agg(cand.paperId, ',' ORDER BY cand.spos) AS candidates,
       max(CASE WHEN cand.paperId = kk.paperId THEN cand.spos END) AS target_pos
FROM kk JOIN cand ON cand.item_id = kk.item_id GROUP BY kk.item_id, kk.k"""))
def selection_candidates(spark, sf_dir):
    """K in 2..5, target plus k-1 drawn others, drawn order."""
    s = selection_rows(spark, sf_dir)
    ids = F.transform("candidates", lambda c: c["paperId"])
    return s.select("item_id", "k", F.array_join(ids, ",").alias("candidates"),
                    F.array_position(ids, F.col("paperId")).alias("target_pos"))


def _sel_prompt(listing: str = "listing") -> str:
    return (f"{sql_str(pr.SELECT_PROMPT_HEAD)} || {listing} || {sql_str(pr.SELECT_PROMPT_MID)} || kk.excerpt || "
            f"{sql_str(pr.SELECT_PROMPT_FORMAT)} || {sql_str(pr.SELECT_INSTRUCTION)} || {sql_str(pr.SELECT_PROMPT_TAIL)}")


_LISTING = f"(SELECT string_agg({LISTING_BLOCK_SQL}, '' ORDER BY spos) FROM cand WHERE cand.item_id = kk.item_id)"


@register("selection_prompt", _sel_sql(f"SELECT kk.item_id, {_sel_prompt(_LISTING)} AS prompt FROM kk"))
def selection_prompt(spark, sf_dir):
    """The selection prompt over the drawn candidates."""
    return selection_rows(spark, sf_dir).select("item_id", "prompt")


def selection_responses(spark, sf_dir, ranked=None):
    """Selection prompts with the stub models' answers."""
    s = selection_rows(spark, sf_dir, ranked=ranked)
    model_in = F.struct(F.col("item_id").cast("string").alias("key"), F.col("paperId").alias("target"), "prompt")
    pair = F.from_json(generate(model_in, stubs.make_selection_responder), T.ArrayType(T.StringType()))
    return s.withColumn("_pair", pair).withColumn("response", F.col("_pair")[0]) \
        .withColumn("ref_response", F.col("_pair")[1]).drop("_pair")


def scored_selections(spark, sf_dir, ranked=None):
    """The responses scored, without the results and prompts they came from: the scoring keeps (checkpoints) its rows."""
    rows = selection_responses(spark, sf_dir, ranked).select("item_id", "paperId", "title", "excerpt", "response", "ref_response")
    return jobs.score_selections(rows)


_SEL_REWARD = f""",
sr AS (SELECT kk.*, {_case_sql('sel', 'CAST(kk.item_id AS VARCHAR)')} AS c,
              {_case_sql('ref', 'CAST(kk.item_id AS VARCHAR)')} % 3 AS rc FROM kk),
srw AS (SELECT *, CAST(CASE WHEN c IN (0, 6, 7) THEN 2 WHEN c IN (1, 2) THEN -1 ELSE -2 END AS INTEGER) AS reward,
               CASE WHEN c = 6 THEN '' WHEN c IN (0, 7) THEN 'best match' END AS sel_reason FROM sr)"""


@register("selection_reward", _sel_sql(_SEL_REWARD + """
SELECT item_id, reward,
       CASE WHEN reward = 2 THEN CASE rc WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' ELSE 'invalid' END END
         AS ref_status
FROM srw"""))
def selection_reward(spark, sf_dir):
    """+2 / -1 / -2 and the baseline's status for right answers."""
    return scored_selections(spark, sf_dir).select("item_id", "reward", "ref_status")


def gold_selections(spark, sf_dir, ranked=None):
    """K4 rows, with the item id as the arrival ``seq``."""
    s = scored_selections(spark, sf_dir, ranked)
    return sc.gold_selection_rows(s, seq="item_id")


_GOLD_SEL = """,
gsel AS (SELECT paperId, max_by(sel_reason, item_id) AS reason, max(item_id) AS gold_seq
         FROM srw WHERE reward = 2 GROUP BY paperId)"""


@register("gold_last_wins_lookup", _sel_sql(_SEL_REWARD + _GOLD_SEL + """
SELECT r.item_id, r.paperId, g.reason, g.gold_seq FROM ranked r JOIN gsel g ON g.paperId = r.paperId"""))
def gold_last_wins_lookup(spark, sf_dir):
    """Ranked rows of gold-selected papers with the last gold row's reason."""
    g = co.last_wins(gold_selections(spark, sf_dir)).select("paperId", "reason", F.col("seq").alias("gold_seq"))
    r = ranked_gold(spark, sf_dir).select("item_id", "paperId")
    return r.join(g, "paperId").select("item_id", "paperId", "reason", "gold_seq")


def _render_sql(user: str, assistant: str) -> str:
    return (f"'<|user|>' || chr(10) || {user} || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) || "
            f"{assistant} || '<|end|>' || chr(10)")


_SFT_SEL = """,
kk AS (SELECT r.*, 5 AS k, g.reason AS gold_reason FROM ranked r JOIN gsel g ON g.paperId = r.paperId
       WHERE r.relevance_rank >= 0),
oth AS (SELECT c.qid AS item_id, c.paperId,
               row_number() OVER (PARTITION BY c.qid ORDER BY md5('""" + SEED + """|o|' || CAST(c.qid AS VARCHAR) || '|' || c.paperId)) AS o
        FROM cit c JOIN kk ON kk.item_id = c.qid WHERE c.paperId <> kk.paperId),
picked AS (SELECT item_id, paperId FROM kk
           UNION ALL SELECT o.item_id, o.paperId FROM oth o JOIN kk ON kk.item_id = o.item_id WHERE o.o <= kk.k - 1),
cand AS (SELECT p.item_id, p.paperId, c.title, c.abstract, c.citationCount,
                row_number() OVER (PARTITION BY p.item_id
                                   ORDER BY md5('""" + SEED + """|s|' || CAST(p.item_id AS VARCHAR) || '|' || p.paperId)) AS spos
         FROM picked p JOIN cit c ON c.qid = p.item_id AND c.paperId = p.paperId)"""


def _sft_sel_sql() -> str:
    # gold selections come from the selection scoring, then a fresh k=5 draw
    base = _sel_sql(_SEL_REWARD + _GOLD_SEL)
    renamed = (_SFT_SEL.replace("kk", "k5").replace("oth AS", "oth5 AS").replace("FROM oth o", "FROM oth5 o")
               .replace("picked AS", "picked5 AS").replace("FROM picked p", "FROM picked5 p")
               .replace("cand AS", "cand5 AS"))
    user = (f"{sql_str(pr.ALPACA_HEAD)} || {sql_str(pr.SFT_INSTRUCTIONS)} || {sql_str(pr.ALPACA_INPUT)} || "
            f"{sql_str(pr.SFT_SELECT_INPUT_HEAD)} || "
            f"(SELECT string_agg({LISTING_BLOCK_SQL}, '' ORDER BY spos) FROM cand5 WHERE cand5.item_id = k5.item_id)"
            f" || {sql_str(pr.SFT_SELECT_INPUT_TAIL)}")
    asst = (f"{sql_str(pr.OUTPUT_PREFIX)} || to_json(struct_pack(reason := k5.gold_reason, "
            "action := struct_pack(name := 'select_paper', paper_id := k5.paperId)))")
    return base + renamed + f"\nSELECT k5.item_id, {_render_sql(user, asst)} AS text FROM k5"


@register("supervised_selection", _sft_sel_sql())
def supervised_selection(spark, sf_dir):
    """Selection training text, k = 5."""
    ranked = ranked_gold(spark, sf_dir)          # one search for the selections and the text
    text = jobs.supervised_selection_text(ranked, gold_selections(spark, sf_dir, ranked), seed=SEED, key="item_id")
    return text.select("item_id", "text")


@register("supervised_query", (lambda: (
    with_views(["papers", "gold"], "").rstrip("\n") + f",\nqsrc AS ({_GOLD_Q})," + SEARCH_CTES + "\n"
    + RANKED_CTES + f"""
SELECT item_id, {_render_sql(
        f"{sql_str(pr.ALPACA_HEAD)} || {sql_str(pr.SFT_INSTRUCTIONS)} || {sql_str(pr.ALPACA_INPUT)} || excerpt",
        f"{sql_str(pr.OUTPUT_PREFIX)} || to_json(struct_pack(reason := reason, action := struct_pack("
        "name := CASE WHEN relevance_rank < citation_rank THEN 'search_relevance' ELSE 'search_citation_count' END, "
        "query := query)))")} AS text
FROM ranked"""))())
def supervised_query(spark, sf_dir):
    """Query training text; the 2-slot template drops ``reason``."""
    return jobs.supervised_query_text(ranked_gold(spark, sf_dir)).select("item_id", "text")
