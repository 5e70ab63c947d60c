"""Data quality: rules that emit issues, and gates on their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(df: DataFrame, id_: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(id, severity, type) for each rule whose condition holds: one pass over the rows, not one for each rule."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(t).alias("type"))) for s, t, c in rules)))
    return df.select(id_, F.explode(found).alias("i")).select(id_, "i.severity", "i.type")


def gate(found: DataFrame) -> DataFrame:
    """Counts by severity and the verdict: blocked, warning or passed; advisory issues do not count."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    out = found.agg(n("blocking").alias("blocking"), n("warning").alias("warning"), n("advisory").alias("advisory"))
    return out.withColumn("verdict", F.when(F.col("blocking") > 0, "blocked").when(F.col("warning") > 0, "warning").otherwise("passed"))


def unmatched(left: DataFrame, right: DataFrame, on: list[str], severity: str, type_: str, id_: str) -> DataFrame:
    """An issue for each left row without a right one."""
    return left.join(right, on, "left_anti").select(F.col(id_), F.lit(severity).alias("severity"), F.lit(type_).alias("type"))


def terms_found(text: Column, terms: Column) -> Column:
    """Sorted different terms that the text contains."""
    return F.sort_array(F.array_distinct(F.filter(terms, lambda t: (t != "") & F.contains(text, t))))
