"""Rules as data: ordered first match, decisions, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(text: Column, rules: list[tuple[str, list[str]]], otherwise: str | None = None) -> Column:
    """Label of the first rule one of whose words is in the text."""
    out = None
    for label, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def rule_table_match(df: DataFrame, id_: str, words: Column, rules: DataFrame) -> DataFrame:
    """First matching rule by a join: ``rules`` (rule_order, label, word) against the words of a row. For rule sets too long for an expression."""
    spread = df.select(id_, F.explode(F.array_distinct(words)).alias("word"))
    hit = spread.join(F.broadcast(rules) if rules.count() <= 10_000 else rules, "word")
    return hit.groupBy(id_).agg(F.min_by("label", "rule_order").alias("label"))


def all_matches(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Labels of all rules that match, in order."""
    marks = []
    for label, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        marks.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*marks))


def intent_score(text: Column, intents: list[dict], asked: Column, most: float = 1.2) -> Column:
    """Sum over the asked intents of min(0.9, 0.35 + 0.12 hits); zero as soon as one of them lacks its required or all its match words."""
    total, failed = F.lit(0.0), F.lit(False)
    for intent in intents:
        on = F.array_contains(asked, intent["name"])
        hits = sum((F.contains(text, F.lit(w)).cast("int") for w in intent["match"]), F.lit(0))
        need = F.lit(False)
        for w in intent.get("required", []):
            need = need | F.contains(text, F.lit(w))
        fails = (hits == 0) | (~need if intent.get("required") else F.lit(False))
        failed = failed | (on & fails)
        total = total + F.when(on, F.least(F.lit(0.9), 0.35 + hits * 0.12)).otherwise(0.0)
    return F.when(failed, F.lit(0.0)).otherwise(F.least(F.lit(most), total))


def staging_decision(exact: Column, internal: Column, risk: Column, near: Column, review: Column, confidence: Column, binary_ok: Column, least: float = 0.58) -> Column:
    """What to do with a new asset: the first rule that applies."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(exact), "duplicate_existing")
        .when(yes(internal), "internal_duplicate")
        .when(yes(risk == "high"), "project_specific_manual_review")
        .when(yes(near), "suspected_duplicate_existing")
        .when(yes(review), "manual_review")
        .when(F.coalesce(confidence, F.lit(0.0)) < least, "manual_review")
        .when(~yes(binary_ok), "manual_review")
        .otherwise("candidate_reuse")
    )


def group_decision(member: Column) -> Column:
    """Aggregate: the most cautious decision among the members."""
    any_ = lambda *names: F.bool_or(member.isin(*names))
    return (
        F.when(any_("duplicate_existing", "internal_duplicate"), "duplicate")
        .when(any_("project_specific_manual_review", "manual_review", "suspected_duplicate_existing"), "manual_review")
        .otherwise("candidate_reuse")
    )


def historical_status(status: Column, ended: Column) -> Column:
    """Pending or running work that has ended was interrupted."""
    return F.when(status.isin("pending", "running") & ended.isNotNull(), "interrupted").otherwise(status)


def readiness_score(sources: Column, ready: Column, items: Column, confirmed: Column, risky: Column) -> Column:
    """0 to 100 from the counts of a library's sources."""
    any_ = sources > 0
    score = F.when(any_, 30).otherwise(0) + F.when(F.coalesce(items, F.lit(0)) > 0, 25).otherwise(0)
    score = score + F.when(any_ & (ready == sources), 20).when(ready > 0, 10).otherwise(0)
    score = score + F.when(any_ & (confirmed == sources), 15).when(confirmed > 0, 7).otherwise(0)
    return F.least(F.lit(100), score + F.when(any_ & (risky == 0), 10).otherwise(0))


def readiness_level(score: Column, sources: Column, risky: Column, failed: Column, pending: Column) -> Column:
    return (
        F.when(sources == 0, "empty").when((risky > 0) | (failed > 0), "risk").when(pending > 0, "review").when(score >= 85, "ready").otherwise("building")
    )


def penalty_score(coverage: Column, paragraphs: Column, high: Column, medium: Column, tables: Column, reviews: Column) -> Column:
    """Review score of a chapter from 0 to 100."""
    score = 100 - F.greatest(F.lit(0.0), 1 - coverage) * 30 - F.greatest(F.lit(0), 4 - paragraphs) * 3 - high * 12 - medium * 5
    score = score + F.when(tables >= 2, 3).otherwise(0) + F.when(reviews > 0, 2).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(score))).cast("int")
