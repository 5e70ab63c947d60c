"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; a unit vector's bucket is the signed axis
nearest to its rotation.  Each of ``TABLES`` tables lists all vectors by bucket; a query looks into the ``PROBES`` nearest
axes of each table and ranks what it finds by exact distance on the original vectors.

Vectors and queries meet in groups of one bucket; a bucket of more than ``BLOCK`` vectors or ``QUERIES`` queries is dealt into blocks of either, each
pair of which is a group, so that no group grows with the data.  Queries that find fewer than the wanted number are
compared with all vectors of their length, in blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

#: Measured recall of the ten nearest: see README. 64-dimensional vectors without clusters need this many.
TABLES, PROBES = 20, 4
BLOCK, QUERIES = 4096, 4096
#: Queries that are compared with a block at a time.
ROWS = 512
SEED = 17
#: Buckets up to which their counts are broadcast: 2 * TABLES * dimension for each length of vectors.
BROADCAST_BUCKETS = 200_000


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, step = rows.shape[1], 1
    while step < n:
        x = rows.reshape(len(rows), n // (2 * step), 2, step)
        rows = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(rows), n)
        step *= 2
    return rows / np.sqrt(n)


def rotations(vectors: np.ndarray):
    """The unit vectors under each table's pseudo-rotation, one table after the other."""
    size = 1 << max(0, vectors.shape[1] - 1).bit_length()
    unit = np.zeros((len(vectors), size))
    unit[:, : vectors.shape[1]] = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    r = np.random.default_rng(SEED)
    for _ in range(TABLES):
        x = unit
        for _ in range(3):
            x = hadamard(x * r.choice([-1.0, 1.0], size))
        yield x


def buckets(vectors: np.ndarray, probes: int) -> np.ndarray:
    """(rows, TABLES * probes): number of each of the nearest signed axes, counted on through the tables."""
    out = []
    for t, x in enumerate(rotations(vectors)):
        signed = np.concatenate([x, -x], axis=1)
        n = signed.shape[1]
        k = min(probes, n)
        near = np.argsort(-signed, axis=1, kind="stable")[:, :k] if k > 1 else signed.argmax(axis=1)[:, None]
        out.append(near + t * n)
    return np.concatenate(out, axis=1).astype(np.int32)


def matrix(column) -> np.ndarray:
    """A list column of an Arrow table as rows of doubles."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def with_buckets(vectors: DataFrame, probes: int) -> DataFrame:
    """vec_id, embedding, size, bucket: a row for each bucket of each vector; vectors of different sizes have buckets of their own."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for n in np.unique(sizes):
                some = batch.take(pa.array(np.flatnonzero(sizes == n)))
                got = buckets(matrix(some.column("embedding")), probes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, got.shape[1]), pa.int32()), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([*some.select(["vec_id", "embedding", "size"]).columns, lists], names=["vec_id", "embedding", "size", "buckets"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    found = vectors.select("vec_id", "embedding", "size").mapInArrow(run, f"vec_id long, embedding {kind}, size int, buckets array<int>")
    return found.select("vec_id", "embedding", "size", F.explode("buckets").alias("bucket"))


def nearest_within(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each query within each group (size, bucket, block, part); rows with one vec_id count once, at their smallest distance."""

    def run(left, right):
        import pyarrow as pa

        q, x = matrix(left["embedding"]), matrix(right["embedding"])
        q_ids, x_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        out = [[], [], []]
        if len(q) and len(x):
            order = np.argsort(x_ids, kind="stable")
            x, x_ids = x[order], x_ids[order]
            squares = (x * x).sum(axis=1)
            first = np.flatnonzero(np.r_[True, x_ids[1:] != x_ids[:-1]])  # where each vec_id starts
            n = min(k, len(first))
            for a in range(0, len(q), ROWS):
                part = q[a : a + ROWS]
                near = squares - 2 * (part @ x.T)  # less the query's own square
                slack = 1e-9 * (squares.max() + (part * part).sum(axis=1))
                near[q_ids[a : a + ROWS, None] == x_ids] = np.inf
                each = near if len(first) == len(x) else np.minimum.reduceat(near, first, axis=1)
                most = np.partition(each, n - 1, axis=1)[:, n - 1]
                for i, (row, limit) in enumerate(zip(near, most + slack)):
                    c = np.flatnonzero((row <= limit) & (row < np.inf))
                    exact = np.sqrt(((x[c] - part[i]) ** 2).sum(axis=1))
                    best = np.argsort(exact, kind="stable")  # c ascends by vec_id, so ties go to the smaller
                    best = best[np.sort(np.unique(x_ids[c[best]], return_index=True)[1])[:k]]
                    out[0].append(np.full(len(best), q_ids[a + i]))
                    out[1].append(x_ids[c[best]])
                    out[2].append(exact[best])
        ints = [np.concatenate(o) if o else np.empty(0, np.int64) for o in out[:2]]
        return pa.table([pa.array(ints[0], pa.int64()), pa.array(ints[1], pa.int64()), pa.array(np.concatenate(out[2]) if out[2] else np.empty(0), pa.float64())], names=["query_id", "vec_id", "score"])

    keys = [c for c in ("size", "bucket", "block", "part") if c in queries.columns]
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def _blocks(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with block and part: a vector is in one block of its bucket and in all parts, a query in one part and in all blocks."""
    keys = ["size", "bucket"]
    blocks = vectors.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    parts = queries.groupBy(*keys).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    counts = settle(blocks.join(parts, keys), "bucket-blocks")  # of buckets that have both
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_BUCKETS else counts
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = vectors.join(counts, keys).withColumn("block", dealt("blocks")).withColumn("part", every("parts")).drop("blocks", "parts")
    queries = queries.join(counts, keys).withColumn("part", dealt("parts")).withColumn("block", every("blocks")).drop("blocks", "parts")
    return queries, vectors


def _best(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k)


def valid(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def search(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by Euclidean distance.

    Vectors that are null, zero or empty, or hold null or non-finite components take no part, nor do rows without vec_id.  Vectors of different lengths have
    no distance: a query finds those of its own length.  Rows with one vec_id count once, at their smallest distance, and never for a query
    of that vec_id.  Ties go to the smaller vec_id.  A table of fewer rows gives all of them; an empty one gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    rows = rows.withColumn("size", F.size("embedding"))
    queries = rows.where(is_query)
    found = settle(_best(nearest_within(*_blocks(with_buckets(queries, PROBES), with_buckets(rows, 1)), k), k), "neighbours")
    enough = found.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    lacking = settle(queries.join(enough, "vec_id", "left_anti"), "lacking")
    if lacking.limit(1).count():
        every = F.lit(0).alias("bucket")
        more = _best(nearest_within(*_blocks(lacking.select("*", every), rows.select("*", every)), k), k)
        found = found.join(lacking.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
