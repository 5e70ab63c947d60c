"""Aggregations: counts, histograms, having rules, zero-filled dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def top_values(df: DataFrame, by: list[str], value: str, at: str, k: int) -> DataFrame:
    """The k most frequent values of each group; ties to the value seen first (smallest ``at``)."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(at).alias("first_at"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "first_at", value)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def duration_stats(c: Column) -> list[Column]:
    """sum, avg, exact median, min and max, two decimals, zero for no rows."""
    parts = {"sum_seconds": F.sum(c), "avg_seconds": F.avg(c), "median_seconds": F.median(c), "min_seconds": F.min(c), "max_seconds": F.max(c)}
    return [F.coalesce(F.round(x, 2), F.lit(0.0)).alias(n) for n, x in parts.items()]


def zero_filled(dimension: DataFrame, facts: DataFrame, key: str, *measures: Column) -> DataFrame:
    """Every row of the dimension with the measures of its facts, zero where there are none."""
    sums = facts.groupBy(key).agg(*measures)
    names = [c for c in sums.columns if c != key]
    return dimension.join(sums, key, "left").select(*dimension.columns, *(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names))


def repeated_values(df: DataFrame, value: str, *more: Column, least: int = 2) -> DataFrame:
    """Values that occur at least ``least`` times, with their count n."""
    return df.groupBy(value).agg(F.count("*").alias("n"), *more).where(F.col("n") >= least)


def spread_within(df: DataFrame, by: list[str], at: str, most: int, least: int = 2) -> DataFrame:
    """Groups of at least ``least`` rows whose positions lie within ``most``."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return g.where((F.col("n") >= least) & (F.col("last_at") - F.col("first_at") <= most))


def incomplete_groups(df: DataFrame, by: list[str], member: str, expected: str) -> DataFrame:
    """Groups with fewer different members than expected."""
    g = df.groupBy(*by).agg(F.count_distinct(member).alias("members"), F.max(expected).alias("expected"))
    return g.where("members < expected")


def frequent_lines(lines: DataFrame, by: list[str], line: str, sampled: int, most: int = 50) -> DataFrame:
    """Lines seen on at least max(3, min(8, sampled / 4)) sampled pages."""
    need = max(3, min(8, sampled // 4))
    return lines.groupBy(*by, line).agg(F.count("*").alias("n")).where(F.col("n") >= need).orderBy(F.desc("n"), *by, line).limit(most)
