"""Retrieval for many outline nodes at once: one plan, not one search for each node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieve


def materials_by_node(nodes: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """node_id, rank, id, score: the k best slices of each node.

    ``nodes`` (node_id, query, path_key) meet ``slices`` (id, search_text, section_key, table_count, image_count, quality) on shared tokens and on
    section keys, so only pairs with a reason are formed; each shared token is one row, summed before pairs are scored.
    """
    asked = nodes.select("node_id", "path_key", F.array_distinct(X.material_tokens(F.col("query"))).alias("want")).withColumn("wanted", F.size("want"))
    tokens = slices.select("id", F.explode(F.array_distinct(X.material_tokens(F.col("search_text")))).alias("token"))
    shared = asked.select("node_id", F.explode("want").alias("token")).join(tokens, "token").groupBy("node_id", "id").agg(F.count("*").alias("shared"))
    # Related keys begin or end alike: every prefix and suffix of a slice's key meets the node's key, and the other way round.
    edges = lambda c: F.array_distinct(F.concat(*(F.transform(F.sequence(F.lit(1), F.size(F.split(c, " > "))), f) for f in (
        lambda n: F.array_join(F.slice(F.split(c, " > "), F.lit(1), n), " > "), lambda n: F.array_join(F.slice(F.split(c, " > "), -n, n), " > ")))))
    own = slices.where("section_key <> ''").select("id", F.col("section_key").alias("own"))
    keyed = asked.where("coalesce(path_key, '') <> ''").select("node_id", "path_key")
    down = own.select("id", "own", F.explode(edges(F.col("own"))).alias("path_key")).join(keyed, "path_key").select("node_id", "id", "own", "path_key")
    up = keyed.select("node_id", "path_key", F.explode(F.transform(edges(F.col("path_key")), lambda x: x)).alias("own")).where(F.endswith("path_key", F.col("own"))).join(own, "own").select("node_id", "id", "own", "path_key")
    paths = down.unionByName(up).groupBy("node_id", "id").agg(F.max((F.col("own") == F.col("path_key")).cast("int")).alias("exact"))
    pairs = shared.join(paths, ["node_id", "id"], "full").join(asked.select("node_id", "wanted"), "node_id").join(slices, "id")
    path = F.when(F.col("exact") == 1, "exact").when(F.col("exact") == 0, "related").otherwise("none")
    overlap = F.coalesce(F.col("shared") / F.greatest("wanted", F.lit(1)), F.lit(0.0))
    score = retrieve.material_score(path, overlap, F.lit(0.0), F.lit(0.0), F.col("table_count"), F.col("image_count"), F.col("quality"))
    scored = pairs.select("node_id", "id", F.round(score, 4).alias("score")).where("score > 0")
    return retrieve.top_k(scored, ["node_id"], k, F.desc("score"), F.col("id"))
