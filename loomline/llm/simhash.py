"""Near duplicates by SimHash and an inverted index over byte positions.

A fingerprint has eight positional bytes.  Two that differ in at most two bits share at least six of them.  Single positional bytes
would list a 256th of all fingerprints each, so an index entry is a combination of four: the bytes form four blocks of two, two
differing bits leave at least two blocks whole, and each pair of blocks with its value is a list.  Within a list the shared positional
bytes of a pair are tallied, pairs with six or more are kept, and their bits compared.  Fingerprints stand for all
their copies, so that a list has each text once.

Lists longer than ``DENSE`` are not paired: their members are listed by the fingerprints one bit away, which two members
share exactly if they differ in at most two bits, and each such list (33 members at most) links to its smallest.  Links are complete either way.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, slices, table
from .components import component_roots
from .fingerprints import shared_bytes
from .similar import keep_one  # noqa: F401  documents at a similarity that fingerprints reach in part

SHINGLE, SEED, DISTANCE = 3, 42, 2
DENSE = 64
#: Shingles of a text whose bits are counted at once.
CHUNK = 1 << 17

SCHEMA = "doc_id long, fp long"


def fingerprint(text: str) -> int:
    """SimHash over XXH64 of the word shingles, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: A-Z and the white space of ASCII alone
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    last = ends[k - 1 :].tolist()
    first = [0, *(ends[: len(words) - k] + 1).tolist()]
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(first), CHUNK):
        hashes = np.array([xxh64_intdigest(line[i:j], SEED) for i, j in zip(first[a : a + CHUNK], last[a : a + CHUNK])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(first)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row; one pass, no shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            got = [fingerprint(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of ``nodes`` (fp) that connect all within the distance."""
    block = [F.shiftrightunsigned("fp", 48 - 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
    pairs_of_blocks = list(combinations(range(4), 2))
    entries = [F.struct(F.lit(n).alias("pair"), (block[i] * 65536 + block[j]).alias("value")) for n, (i, j) in enumerate(pairs_of_blocks)]
    index = nodes.select("fp", F.explode(F.array(*entries)).alias("e")).select("fp", "e.pair", "e.value")
    sizes = index.groupBy("pair", "value").count().where("count > 1")
    index = settle(index.join(sizes, ["pair", "value"]), "postings")
    short, dense = index.where(F.col("count") <= DENSE), index.where(F.col("count") > DENSE)
    left, right = short.select("pair", "value", F.col("fp").alias("a")), short.select("pair", "value", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    shared = shared_bytes(F.col("a"), F.col("b"))
    pairs = left.join(right, ["pair", "value"]).where((F.col("a") < F.col("b")) & (shared >= 8 - DISTANCE) & (F.bit_count(differ) <= DISTANCE)).select("a", "b")
    free = F.array(*(F.array(*(F.lit(1 << x if x < 63 else -(1 << 63)) for x in range(64) if 3 - x // 16 not in blocks)) for blocks in pairs_of_blocks))
    near = F.transform(F.element_at(free, F.col("pair") + 1), lambda bit: F.col("fp").bitwiseXOR(bit))
    around = dense.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("v")).distinct()
    around = around.groupBy("v").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    stars = around.select("a", F.explode("members").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the component) and component_id of every row."""
    rows = settle(fingerprints(docs), "fingerprints")
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = component_roots(links(nodes))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(nodes.join(names, "root").select("fp", "root", "component_id"), "fingerprint-components")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id; one row for each row of ``docs``.

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows are in one component; a
    null doc_id is in its component but never names it, unless no other is there; an empty table gives no rows.
    """
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
