"""From raw documents to shards: quality, near duplicates, benchmark passages, source mix, sharding.

Every stage reads what its predecessor wrote, drops, repeats or labels rows as its operator decides, and keeps the columns of the
documents; the last adds the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm.common import settle, table
from loomline.llm.decontaminate import keep_clean
from loomline.llm.mixture import mixed_documents
from loomline.llm.quality_cnn import keep_good
from loomline.llm.sharding import sharded
from loomline.llm.simhash import keep_one

SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Null texts are judged as empty ones; equal texts are accepted or go together; without labels everything stays; an empty table
    gives an empty one; columns of any name stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that share a similarity of 0.8 or more of their 5-word shingles with one that stays and has a smaller doc_id; rows without one are last.

    Texts equal but for case and white space are one; null, empty and blank texts are equal; of repeated rows one stays; an empty table gives an empty
    one; columns of any name stay.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and empty texts are clean; repeated rows stay or go together; an empty table gives an empty one; columns of any name stay.
    """
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut to its budget.

    Null sources are one source; null, empty and blank texts have no words and appear once for each complete epoch; repeated rows are taken one
    after the other; an empty table gives an empty one; columns of any name stay.
    """
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, a last column; equal texts, null ones and empty ones among them, share one.

    An empty table gives an empty one; columns of any name stay, but an input column ``shard`` is named ``input_shard``.
    """
    return sharded(docs, SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("sharding", sharding),
]

#: Hashes, a trained network and sampling are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
