"""Ranking: BM25, keyword counts, additive scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, doc_tokens: Column, tokens: Column, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, bm25 of every document that shares a token; repeated query tokens count again.

    Documents are tokenised once: each gives its length, under no token, and the counts of the tokens that queries ask for. That table is
    written, and the number of documents, their mean length and the documents of each token are read from it.
    """
    spark = docs.sparkSession
    asked = queries.select(query_id, F.explode(tokens).alias("token")).groupBy(query_id, "token").agg(F.count("*").alias("__times"))
    none = F.lit("")  # tokens are never empty
    wanted = asked.select("token").distinct().unionByName(spark.range(1).select(none.alias("token")))
    # The array is bound once in a lambda: a length projected beside the explode would tokenise the text again for every token.
    counted = F.transform(F.array(doc_tokens), lambda t: F.transform(F.concat(F.array(none), t), lambda x: F.struct((F.size(t)).alias("__len"), x.alias("token"))))[0]
    tf = docs.select(doc_id, F.explode(counted).alias("x")).select(doc_id, "x.__len", "x.token").join(wanted, "token", "left_semi")
    tf.groupBy(doc_id, "__len", "token").agg(F.count("*").alias("__tf")).write.parquet(path := scratch(spark, "term-counts"))
    tf = spark.read.parquet(path)
    # rows that are there several times are counted together under one id
    totals = tf.where(F.col("token") == none).agg(F.sum("__tf").alias("__n"), (F.sum(F.col("__len") * F.col("__tf")) / F.sum("__tf")).alias("__avg"))
    tf = tf.where(F.col("token") != none)
    df = tf.groupBy("token").agg(F.count("*").alias("__df"))
    hits = tf.join(df, "token").join(F.broadcast(totals)).join(asked, "token")  # totals: one row
    idf = F.log(1 + (F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5))
    size = k1 * (1 - b + b * F.greatest(F.col("__len"), F.lit(1)) / F.coalesce(F.nullif("__avg", F.lit(0.0)), F.lit(1.0)))
    part = F.col("__times") * idf * F.col("__tf") * (k1 + 1) / (F.col("__tf") + size)
    return hits.groupBy(query_id, doc_id).agg(F.sum(part).alias("bm25"))


def top_k(df: DataFrame, by: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes by a partial top-k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def material_score(path: Column, overlap: Column, phrases: Column, intent: Column, tables: Column, images: Column, quality: Column) -> Column:
    """Additive score of a material: path 3 or 1.6, shares of tokens and phrases, intent, tables and images up to five each, quality."""
    score = F.when(path == "exact", 3.0).when(path == "related", 1.6).otherwise(0.0) + overlap + phrases + intent
    score = score + F.least(tables, F.lit(5)) * 0.03 + F.least(images, F.lit(5)) * 0.02
    return score + F.when(quality == "high", 0.25).when(quality == "review_required", -0.2).otherwise(0.0)


def with_minimum(df: DataFrame, by: list[str], k: int, least: int, has: Column, *order: Column) -> DataFrame:
    """The first k rows, and more rows that have what is wanted until ``least`` of them are there."""
    w = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w)).withColumn("__have", F.sum(has.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("rank") <= k) | (has & (F.col("__have") <= least))).drop("__have")


def with_group_members(df: DataFrame, by: list[str], order: list, k: int, grouped: Column) -> DataFrame:
    """The first k rows of each group, and every later row that belongs to a kept group of its own (``grouped``)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where((F.col("__n") <= k) | F.coalesce(grouped, F.lit(False))).drop("__n")


def rerank_bonus(type_: Column, intent: Column, weights: dict[str, dict[str, float]], intents: Column, tags: Column, title_tokens: Column, asked: Column, risk: Column, risky: tuple = (), evidence: tuple = ()) -> Column:
    """Additive bonus: type under intent, 1.2 for a stated intent, 0.5 for a tag, 0.7 for a title token, 0.6 for high risk and 0.4 for evidence where the intent calls for it."""
    bonus = F.lit(0.0)
    for i, by_type in weights.items():
        for t, w in by_type.items():
            bonus = bonus + F.when((intent == i) & (type_ == t), w).otherwise(0.0)
    share = lambda a: F.coalesce(F.arrays_overlap(a, asked), F.lit(False))
    bonus = bonus + F.when(F.coalesce(F.array_contains(intents, intent), F.lit(False)), 1.2).otherwise(0.0)
    bonus = bonus + F.when(share(tags), 0.5).otherwise(0.0) + F.when(share(title_tokens), 0.7).otherwise(0.0)
    bonus = bonus + F.when(intent.isin(*risky) & (risk == "high"), 0.6).otherwise(0.0)
    return bonus + F.when(intent.isin(*evidence) & (type_ == "rag_evidence"), 0.4).otherwise(0.0)


def fit_level(score: Column, rejected: Column, preferred: float = 70, candidate: float = 35) -> Column:
    """preferred, candidate or review_only."""
    return F.when(rejected, "review_only").when(score >= preferred, "preferred").when(score >= candidate, "candidate").otherwise("review_only")
