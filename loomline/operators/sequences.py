"""Operators on ordered rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], order: list, breaks: Column, name: str = "island") -> DataFrame:
    """Number of the island of each row; ``breaks`` says whether a row begins a new one (null: it does)."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__new", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    return marked.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def previous(c: str | Column, by: list[str], order: list) -> Column:
    return F.lag(c, 1).over(Window.partitionBy(*by).orderBy(*order))


def heading_path(df: DataFrame, by: list[str], order: list, level: str, title: str, depth: int, name: str = "path") -> DataFrame:
    """Path of headings above and at each row: a heading of a level ends the deeper ones before it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    at = {k: F.last(F.when(F.col(level) == k, F.struct("__seq", title)), ignorenulls=True).over(w) for k in range(1, depth + 1)}
    df = df.withColumns({f"__h{k}": c for k, c in at.items()})
    parts = []
    for k in range(1, depth + 1):
        live = F.lit(True)
        for above in range(1, k):
            live = live & F.coalesce(F.col(f"__h{k}.__seq") > F.col(f"__h{above}.__seq"), F.col(f"__h{above}").isNull())
        parts.append(F.when(live, F.col(f"__h{k}.{title}")))
    return df.withColumn(name, F.array_compact(F.array(*parts))).drop("__seq", *(f"__h{k}" for k in range(1, depth + 1)))


def next_boundary(df: DataFrame, by: list[str], at: str, boundary: Column, name: str = "end_at") -> DataFrame:
    """Last position before the next boundary row, or the last position of the group."""
    w = Window.partitionBy(*by).orderBy(at)
    later = F.min(F.when(boundary, F.col(at))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(later - 1, F.max(at).over(Window.partitionBy(*by))))


def latest(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """Last row of each group; one pass with partial aggregation."""
    from .joins import last_per_key

    return last_per_key(df, by, *order)


def round_robin(df: DataFrame, group: str, group_order: list, order: list, limit: int) -> DataFrame:
    """One row of each group in turn until ``limit`` rows; column turn is the place in the group."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)
    return ranked.orderBy("turn", *group_order).limit(limit)


def running_penalty(df: DataFrame, by: list[str], key: str, order: list, score: str, penalty: float, name: str = "adjusted") -> DataFrame:
    """Score less ``penalty`` for every earlier row of the group with the same key."""
    w = Window.partitionBy(*by, key).orderBy(*order)
    return df.withColumn(name, F.col(score) - penalty * (F.row_number().over(w) - 1))


def outline_spans(df: DataFrame, by: list[str], at: str, level: str, page: str, last: str) -> DataFrame:
    """Parent (position of the nearest earlier row of a smaller level), end page and number of descendants of each row.

    The end is the page before the next row whose level is not deeper, at least the own page; else ``last``.  A stack for each
    group, so one pass over its rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in df.columns) + f", parent {kinds[at]}, end_page {kinds[page]}, descendants int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, kind="stable").reset_index(drop=True)
        levels, pages, places = pdf[level].tolist(), pdf[page].tolist(), pdf[at].tolist()
        parents, ends, below, stack = [None] * len(pdf), pdf[last].tolist(), [len(pdf) - i - 1 for i in range(len(pdf))], []
        for i, depth in enumerate(levels):
            while stack and levels[stack[-1]] >= depth:
                j = stack.pop()
                ends[j], below[j] = max(pages[j], pages[i] - 1), i - j - 1
            parents[i] = places[stack[-1]] if stack else None
            stack.append(i)
        return pdf.assign(parent=pd.array(parents, dtype="Int64"), end_page=ends, descendants=below)

    return df.groupBy(*by).applyInPandas(run, schema)
