"""Tables of a data folder, paged scans, append and overwrite sinks, tolerant JSON."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def filtered(df: DataFrame, **equal) -> DataFrame:
    """Rows equal in every given column; arguments that are None ask nothing."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df


def page(df: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def point_lookup(df: DataFrame, column: str, value, ignore_case: bool = False) -> DataFrame:
    c = F.col(column)
    return df.where(F.lower(c) == F.lower(F.lit(value)) if ignore_case else c == F.lit(value)).limit(1)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Objects of a JSON-lines folder; blank, broken and non-object lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a file, such as templates or state files; unreadable files give no rows, missing fields are null."""
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED")
    return read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).json(path)


def append(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(by or [])).format(kind).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``; where it is unset, as in tests, a local one)."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_loomline_scratch", None)
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = sc._loomline_scratch = "file://" + tempfile.mkdtemp(prefix="loomline-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
