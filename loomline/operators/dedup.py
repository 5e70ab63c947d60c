"""Keep-first, merge and greedy de-duplication."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import one_per_key


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return one_per_key(df, keys, *order)


def union_keep_first(frames: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Rows of all frames, the first of each key; earlier frames come first, then ``order``."""
    out = None
    for n, df in enumerate(frames):
        part = df.withColumn("__frame", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return one_per_key(out, keys, F.col("__frame"), F.col(order)).drop("__frame")


def merge_rows(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Replace or append by key."""
    return target.join(changes, keys, "left_anti").unionByName(changes)


def cascade_delete(gone: DataFrame, key: str, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every child table without the rows of the deleted keys."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in children.items()}


def overlay(base: Column, override: Column) -> Column:
    """Map overlay in which a key that is present wins even if its value is null."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k)), override)


def greedy_by_keys(df: DataFrame, by: list[str], order: list[str], keys: str) -> DataFrame:
    """Keep a row if none of its keys (an array) is among those of the rows kept before it in its group.

    Whether a row stays depends on what stayed before, so each group is walked once in order.
    """
    schema = df.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        seen: set = set()
        stay = []
        for row_keys in pdf[keys]:
            mine = {k for k in row_keys if k} if row_keys is not None else set()
            stay.append(not mine & seen)
            if stay[-1]:
                seen |= mine
        return pdf[stay]

    return df.groupBy(*by).applyInPandas(run, schema)


def replace_over_represented(df: DataFrame, by: list[str], order: str, theme: str, chosen: str, most: int, at_most_new: int) -> DataFrame:
    """From the end of the chosen rows, those of themes with more than ``most`` give way to rows of missing themes.

    ``chosen`` is a boolean column; up to ``at_most_new`` rows of each missing theme enter, in order.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        taken = pdf[chosen].tolist()
        themes = pdf[theme].tolist()
        counts: dict = {}
        for t, c in zip(themes, taken):
            counts[t] = counts.get(t, 0) + c
        missing = {t for t, n in counts.items() if not n}
        entering: dict = {}
        incoming = []
        for i, t in enumerate(themes):
            if t in missing and entering.get(t, 0) < at_most_new:
                entering[t] = entering.get(t, 0) + 1
                incoming.append(i)
        for i in incoming:
            leave = next((j for j in range(len(pdf) - 1, -1, -1) if taken[j] and themes[j] not in missing and counts[themes[j]] > most), None)
            if leave is None:
                break
            taken[leave], taken[i] = False, True
            counts[themes[leave]] -= 1
        return pdf.assign(**{chosen: taken})

    return df.groupBy(*by).applyInPandas(run, df.schema)


def place_greedily(df: DataFrame, by: list[str], item: str, slot: str, score: str, order: str, penalty: float) -> DataFrame:
    """For each item in order the slot of the highest score, less ``penalty`` for every item the slot already has; ties to the smaller slot."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, item, slot]) + ", placed_score double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load: dict = {}
        out = []
        for _, rows in pdf.sort_values([order, item, slot], kind="stable").groupby([order, item], sort=True):
            best = max(zip(rows[score] - penalty * rows[slot].map(lambda s: load.get(s, 0)), -rows.index.to_series().rank(), rows.index))
            row = rows.loc[best[2]]
            load[row[slot]] = load.get(row[slot], 0) + 1
            out.append({**{c: row[c] for c in [*by, item, slot]}, "placed_score": float(best[0])})
        return pd.DataFrame(out, columns=[*by, item, slot, "placed_score"])

    return df.groupBy(*by).applyInPandas(run, schema)
