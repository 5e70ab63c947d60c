"""Trees as (node, parent) tables, walked level by level: joins, not recursion on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(nodes: DataFrame, node: str, parent: str, title: str, depth: int) -> DataFrame:
    """node, depth (from 1) and path of titles of every node down to ``depth`` levels."""
    level = nodes.where(F.col(parent).isNull()).select(F.col(node), F.lit(1).alias("depth"), F.array(title).alias("path"))
    out = level
    for d in range(2, depth + 1):
        below = nodes.select(F.col(node).alias("__child"), F.col(parent).alias("__up"), F.col(title).alias("__title"))
        level = level.join(below, F.col(node) == F.col("__up")).select(F.col("__child").alias(node), F.lit(d).alias("depth"), F.concat("path", F.array("__title")).alias("path"))
        out = out.unionByName(level)
    return out


def closure(nodes: DataFrame, node: str, parent: str, depth: int) -> DataFrame:
    """(ancestor, node, distance) of every pair down to ``depth`` levels below, a node being its own ancestor at distance 0."""
    edges = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("__up"), F.col(node).alias("__down"))
    level = nodes.select(F.col(node).alias("ancestor"), F.col(node).alias("node"), F.lit(0).alias("distance"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(edges, F.col("node") == F.col("__up")).select("ancestor", F.col("__down").alias("node"), F.lit(d).alias("distance"))
        out = out.unionByName(level)
    return out


def subtree_sums(rows: DataFrame, path: str, *measures: str) -> DataFrame:
    """Sums over all rows whose path begins with a path: every prefix is emitted once and summed, one shuffle."""
    from .joins import prefixes

    spread = rows.select(F.explode(prefixes(F.col(path))).alias(path), *measures)
    return spread.groupBy(path).agg(*(F.sum(m).alias(f"subtree_{m}") for m in measures))


def trimmed(nodes: DataFrame, node: str, parent: str, order: str, per_parent: int, total: int) -> DataFrame:
    """Of the children of each parent the first ``per_parent``, and of these the first ``total`` under each grandparent group ``root``."""
    from pyspark.sql import Window

    first = nodes.withColumn("__n", F.row_number().over(Window.partitionBy(parent).orderBy(order, node))).where(F.col("__n") <= per_parent)
    running = F.row_number().over(Window.partitionBy("root").orderBy(parent, "__n"))
    return first.withColumn("__t", running).where(F.col("__t") <= total).drop("__n", "__t")
