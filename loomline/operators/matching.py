"""Matching titled sections of two documents, and the best partner by text.

A section (id, level, title, number, path) finds its partner by number and title, number path, end of path, number or title.  Every rule
with a score implies an equal number, number path, canonical title, last path element or a shared title token, so candidates come
from equi joins on these keys and no pair without one is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import joins

#: Rows up to which the smaller side of a comparison of all pairs is broadcast; beyond, pairs are spread by blocks.
BROADCAST_ROWS = 10_000


def _prepared(df: DataFrame) -> DataFrame:
    rows = df.select("id", "level", "title", "number", "path")
    return rows.withColumns({
        "canon": X.canonical_text(F.col("title")),
        "segments": F.transform("path", X.canonical_segment),
        "numbers": X.number_path(F.col("path")),
        "tokens": F.array_distinct(X.material_tokens(F.col("title"))),
    })


def _keys() -> Column:
    one = lambda kind, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(kind), value))
    keys = [one("n", F.col("number")), one("p", F.array_join("numbers", "/")), one("c", F.col("canon")), one("s", F.when(F.size("segments") > 0, F.element_at("segments", -1)))]
    return F.array_distinct(F.concat(F.array_compact(F.array(*keys)), F.transform("tokens", lambda t: F.concat(F.lit("t"), t))))


def _rule(a: str, b: str) -> Column:
    """(score, method) of the first rule that holds; null if none does."""
    l, r = lambda c: F.col(f"{a}.{c}"), lambda c: F.col(f"{b}.{c}")  # noqa: E731, E741
    same_number = (l("number") == r("number")) & (l("number") != "")
    overlap = F.when((F.size(l("tokens")) > 0) & (F.size(r("tokens")) > 0), F.size(F.array_intersect(l("tokens"), r("tokens"))) / F.greatest(F.size(l("tokens")), F.size(r("tokens")))).otherwise(0.0)
    gap = F.abs(l("level") - r("level"))
    scored = lambda s, m: F.struct(s.cast("double").alias("score"), F.lit(m).alias("method"))
    return (
        F.when(same_number & (l("canon") == r("canon")), scored(F.lit(1.0), "number_and_title"))
        .when(same_number & F.contains(l("number"), F.lit(".")), scored(F.lit(0.9), "number"))
        .when(same_number & (overlap >= 0.6), scored(F.lit(0.86), "short_number_with_title_overlap"))
        .when((F.size(l("numbers")) > 0) & (l("numbers") == r("numbers")), scored(F.lit(0.96), "number_path"))
        .when(X.path_ends_with(r("segments"), l("segments")), scored(F.lit(0.92), "path_suffix"))
        .when(l("canon") == r("canon"), scored(F.greatest(F.round(0.82 - gap * 0.03, 4), F.lit(0.72)), "title"))
        .when(overlap >= 0.8, scored(F.lit(0.76), "title_overlap"))
    )


def match_sections(left: DataFrame, right: DataFrame, material: str, least: float = 0.72, delta: float = 0.01) -> DataFrame:
    """id, partner, method, score, candidates, status of every left section.

    Best partner by score, then level, then id; ambiguous if another is within ``delta``.  Without one, right sections below the parent path
    that have material of their own (``material`` > 0) stand in together as FALLBACK:first..last, score 0.68; else unmatched.
    """
    l, r = _prepared(left), _prepared(right)  # noqa: E741
    keyed = lambda df, name: df.select(F.col("id").alias(name), F.explode(_keys()).alias("key"))
    pairs = keyed(l, "lid").join(keyed(r, "rid"), "key").select("lid", "rid").distinct()
    pairs = pairs.join(l.alias("l"), F.col("lid") == F.col("l.id")).join(r.alias("r"), F.col("rid") == F.col("r.id")).select("lid", "rid", F.col("r.level").alias("rlevel"), _rule("l", "r").alias("m"))
    pairs = pairs.select("lid", "rid", "rlevel", "m.method", F.col("m.score").alias("score")).where("score is not null")
    best = joins.best_match(pairs, "lid", "rid", "score", F.col("rlevel"), F.col("rid"), least=least, delta=delta)
    best = best.join(pairs.select("lid", "rid", "method"), ["lid", "rid"])
    rest = l.join(best, l["id"] == best["lid"], "left_anti").where((F.size("segments") > 1) & (F.length("canon") > 1))
    parents = rest.select("id", F.slice("segments", F.lit(1), F.size("segments") - 1).alias("parent"))
    inner = r.join(right.where(F.col(material) > 0).select("id"), "id").select(F.col("id").alias("rid"), F.col("level").alias("rlevel"), "segments")
    below = joins.under_prefix(inner, parents, "segments", "parent").where(F.size("segments") > F.size("parent"))
    order = F.struct("rlevel", "rid")
    fallback = below.groupBy("id").agg(F.min(order).alias("a"), F.max(order).alias("z"), F.count("*").alias("candidates"))
    fallback = fallback.select("id", F.concat(F.lit("FALLBACK:"), "a.rid", F.lit(".."), "z.rid").alias("partner"), F.lit("parent_subtree").alias("method"), F.lit(0.68).alias("score"), "candidates", F.lit("fallback").alias("status"))
    found = best.select(F.col("lid").alias("id"), F.col("rid").cast("string").alias("partner"), "method", "score", "candidates", "status").unionByName(fallback)
    out = left.select("id").join(found, "id", "left")
    return out.select("id", "partner", "method", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"), F.coalesce("status", F.lit("unmatched")).alias("status"))


def best_by_text(left: DataFrame, right: DataFrame, least: float = 0.48) -> DataFrame:
    """left_id, right_id, score: for each left (left_id, left_title) the right row (right_id, title, path_text, depth, pos) of the highest score.

    The score is that of the title, or 0.96 of that of the path, plus 0.08 at depth 1; the earliest row wins ties.  All pairs are compared,
    as the score has no key; the right side is broadcast only up to BROADCAST_ROWS rows.
    """
    right = F.broadcast(right) if right.count() <= BROADCAST_ROWS else right
    title = F.col("left_title")
    score = F.greatest(X.text_match_score(title, F.col("title")), X.text_match_score(title, F.col("path_text")) * 0.96) + F.when(F.col("depth") == 1, 0.08).otherwise(0.0)
    scored = left.crossJoin(right).select("left_id", "right_id", "pos", F.round(score, 6).alias("score"))
    best = scored.groupBy("left_id").agg(F.max_by(F.struct("right_id", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("left_id", F.col("b.right_id").alias("right_id"), F.col("b.score").alias("score")).where(F.col("score") >= least)
