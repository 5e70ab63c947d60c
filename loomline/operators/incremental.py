"""Resumable work: what to do again, state folded from events, merges into a library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resume_decision(work: DataFrame, state: DataFrame, on: str, version: str, force: bool = False, retry_failed: bool = True) -> DataFrame:
    """``work`` (key, package_hash, cache_key) against ``state`` (key, schema_version, package_hash, cache_key, status): action and reason.

    The first rule that applies: forced, no state, other version, other input, other settings, completed, failed and not to be retried.
    """
    s = state.select(on, *(F.col(c).alias(f"__{c}") for c in ("schema_version", "package_hash", "cache_key", "status")), F.lit(True).alias("__there"))
    j = work.join(s, on, "left")
    other_cache = F.coalesce(F.col("__cache_key"), F.lit("")) != ""
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("__there").isNull(), "no state")
        .when(~F.col("__schema_version").eqNullSafe(F.lit(version)), "version")
        .when(~F.col("__package_hash").eqNullSafe(F.col("package_hash")), "input changed")
        .when(other_cache & ~F.col("__cache_key").eqNullSafe(F.col("cache_key")), "settings changed")
        .when(F.col("__status") == "completed", "completed")
        .when((F.col("__status") == "failed") & F.lit(not retry_failed), "failed before")
        .otherwise("unfinished")
    )
    j = j.withColumn("reason", reason)
    return j.select(*work.columns, F.when(F.col("reason").isin("completed", "failed before"), "skip").otherwise("generate").alias("action"), "reason")


def cache_misses(work: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return work.join(cache.select(key), key, "left_anti")


def last_event_fold(events: DataFrame, key: str, order: list[str], overwrite: list[str], sticky: list[str]) -> DataFrame:
    """State of each key: ``overwrite`` columns as the last event has them, nulls included; ``sticky`` ones as last set."""
    o = F.struct(*order)
    aggs = [F.max_by(F.struct(*overwrite), o).alias("__last")]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in sticky]
    out = events.groupBy(key).agg(*aggs)
    return out.select(key, *(F.col(f"__last.{c}").alias(c) for c in overwrite), *sticky)


def newest_active(jobs: DataFrame, by: list[str], status: str, *order: Column) -> DataFrame:
    """The newest pending or running row of each group: a submit that finds one starts nothing new."""
    from .joins import last_per_key

    return last_per_key(jobs.where(F.col(status).isin("pending", "running")), by, *order)


def promote(library: DataFrame, incoming: DataFrame, id_: str, natural_key: str, order: str) -> DataFrame:
    """Append incoming rows whose natural key is new, the first of each key, with ids counted on from the largest.

    Ids are the offset of a row's hash bucket plus its place there, so no task numbers all rows.
    """
    new = incoming.join(library.select(natural_key), natural_key, "left_anti")
    from .joins import one_per_key

    new = one_per_key(new, [natural_key], F.col(order)).withColumn("__part", F.pmod(F.xxhash64(natural_key), F.lit(256)))
    sizes = new.groupBy("__part").count()
    before = sizes.withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count")).drop("count")  # 256 rows at most
    start = library.agg(F.coalesce(F.max(id_), F.lit(0)).alias("__start"))  # one row
    place = F.row_number().over(Window.partitionBy("__part").orderBy(natural_key))
    new = new.withColumn("__place", place).join(F.broadcast(before), "__part").join(F.broadcast(start))
    new = new.withColumn(id_, (F.col("__start") + F.col("__before") + F.col("__place")).cast(library.schema[id_].dataType))
    return library.unionByName(new.select(*library.columns))
