"""Seeded candidate draws.

All array-level: the candidates of one query never leave its row, so there
is no shuffle, and the draw is a pure function of (seed, key, paperId).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.draws import draw_key
from scriptorium.operators.ranking import others, target


def order_by_draw(items: Column, seed, salt: str, key: Column) -> Column:
    keyed = F.transform(items, lambda r: F.struct(draw_key(seed, salt, key, r["paperId"]).alias("h"), r.alias("r")))
    return F.transform(F.sort_array(keyed), lambda x: x["r"])


def draw_candidates(results: Column, paper_id: Column, k: Column, seed, key: Column) -> Column:
    """Target plus k-1 drawn others, in a drawn order.

    ``results`` must contain the target (apply F8 first)."""
    rest = F.slice(order_by_draw(others(results, paper_id), seed, "o", key), 1, k - 1)
    picked = F.concat(F.array(target(results, paper_id)), rest)
    return order_by_draw(picked, seed, "s", key)
