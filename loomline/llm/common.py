"""What the operators of this subpackage share: reading tables and settling intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (the folder may be in any store)."""
    # Python workers on this machine find the package too; a cluster has it installed or gets it with --py-files.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (tests, one machine) a local folder stands in for it.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(spark.sparkContext, "_loomline_shared"):
        spark.sparkContext._loomline_shared = "file://" + tempfile.mkdtemp(prefix="loomline-")
    return spark.sparkContext._loomline_shared


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: whatever follows reads the table, also after executors are lost,
    and several readers do not repeat the work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame) -> int:
    """Size of the input of ``df`` (a column ``text`` and others), for the choice of partitions: as its plan states it, or else measured."""
    stated = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return stated if stated < 1 << 60 else df.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0


def plain_names(df: DataFrame, *read: str):
    """``df`` with its columns, but for those that are ``read``, under names that nothing else uses, and a function that gives a result its names back."""
    own = {c: f"own_{uuid.uuid4().hex}_{i}" for i, c in enumerate(df.columns) if c.lower() not in read}
    back = {v: k for k, v in own.items()}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    renamed = df.select(*(quoted(c).alias(own.get(c, c)) for c in df.columns))
    return renamed, lambda out: out.select(*(quoted(c).alias(back.get(c, c)) for c in out.columns))


def slices(batches, rows: int = 256):
    """Arrow batches of a few rows, so that little of a batch is there as Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def let(value, body):
    """``body(value)`` with ``value`` computed once: a lambda variable is not inlined again."""
    return F.transform(F.array(value), body)[0]
