"""Runs queries and their SQL side by side: python tests/oracle.py FOLDER [NAME ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomline.sources.tables import NAMES


def duck(folder: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for n in NAMES:
        path = Path(folder, f"{n}.parquet")
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return c


def plain(rows) -> list[tuple]:
    return sorted((tuple(None if x is None else float(x) if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: tuple(map(repr, r)))


def compare(spark, con, folder: str, name: str, f, sql: str) -> str:
    """Empty if the query and its SQL give the same columns and rows."""
    df = f(spark, folder)
    names = sorted(df.columns)
    rel = con.sql(sql)
    if names != sorted(rel.columns):
        return f"columns {df.columns} and {rel.columns}"
    ours = plain(tuple(r[c] for c in names) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    theirs = plain(tuple(r[i] for i in at) for r in rel.fetchall())
    if ours != theirs:
        differ = [(a, b) for a, b in zip(ours, theirs) if a != b]
        return f"{len(ours)} and {len(theirs)} rows; first differences {differ[:2]}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    folder, chosen = sys.argv[1], sys.argv[2:]
    con, queries = duck(folder), entry.queries()
    for name, sql in entry.oracle_sql().items():
        if chosen and name not in chosen:
            continue
        began = time.time()
        try:
            problem = compare(spark, con, folder, name, queries[name], sql)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if not problem else "BAD ", name, round(time.time() - began, 1), problem, flush=True)
