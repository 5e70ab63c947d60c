"""Retrieval plans: BM25 with rerank, and material search with path, tokens, phrases and intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieve, rules


def bm25_search(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, doc_text: Column, query_text: Column, k: int) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents, scores rounded to four places, ties to the smaller id."""
    scored = retrieve.bm25(docs, queries, doc_id, query_id, X.query_tokens(doc_text), X.query_tokens(query_text))
    scored = scored.select(query_id, doc_id, F.round("bm25", 4).alias("score")).where("score > 0")
    return retrieve.top_k(scored, [query_id], k, F.desc("score"), F.col(doc_id))


def material_search(slices: DataFrame, query: str, path_key: str | None, intents: list[dict], k: int) -> DataFrame:
    """The k best slices (id, search_text, section_key, table_count, image_count, quality) for one query: id, score, reasons.

    A slice needs a reason: its path, a shared token, a shared phrase or all asked intents; with intents asked, one that lacks them is out.
    """
    q, text = F.lit(query), F.col("search_text")
    asked = X.canonical_text(q)
    names = F.array_compact(F.array(*(F.when(rules.first_match(asked, [(i["name"], i["triggers"])]).isNotNull(), F.lit(i["name"])) for i in intents))) if intents else F.array().cast("array<string>")
    want = F.array_distinct(X.material_tokens(q))
    key = F.lit(path_key or "")
    own = F.col("section_key")
    related = (own != "") & (F.endswith(own, key) | F.endswith(key, own) | F.startswith(own, F.concat(key, F.lit(" > "))))
    rows = slices.withColumns({
        "path_match": F.when(key == "", "none").when(own == key, "exact").when(related, "related").otherwise("none"),
        "overlap": F.size(F.array_intersect(want, X.material_tokens(text))) / F.greatest(F.size(want), F.lit(1)),
        "phrases": X.phrase_overlap(q, text),
        "intent": rules.intent_score(X.canonical_text(text), intents, names) if intents else F.lit(0.0),
    })
    if intents:
        rows = rows.where((F.size(names) == 0) | (F.col("intent") > 0))
    reasons = F.array_compact(F.array(
        F.when(F.col("path_match") != "none", F.concat(F.lit("path_"), F.col("path_match"))),
        F.when(F.col("intent") > 0, F.lit("intent")),
        F.when(F.col("overlap") > 0, F.lit("tokens")),
        F.when(F.col("phrases") > 0, F.lit("phrases")),
    ))
    score = retrieve.material_score(F.col("path_match"), F.col("overlap"), F.col("phrases"), F.col("intent"), F.col("table_count"), F.col("image_count"), F.col("quality"))
    rows = rows.select("id", F.round(score, 4).alias("score"), reasons.alias("reasons")).where((F.size("reasons") > 0) & (F.col("score") > 0))
    return rows.orderBy(F.desc("score"), "id").limit(k)
