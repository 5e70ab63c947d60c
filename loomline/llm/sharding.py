"""Sharding by best-fit-decreasing bin packing.

Documents with equal texts form a group that stays together, and every group is packed.  Groups, largest first, enter the bin with the
tightest remaining capacity, found in a balanced tree; the capacity is the smallest for which the given number of bins is enough.

Groups of one size are interchangeable: after one of them the tightest bin is the tightest still, so that a size with its count is packed in one step for each bin
that it fills.  What the driver packs is therefore a table of sizes, which has a bound (``size_class``), and not of groups.  Of each size,
the groups with the smallest digests enter the bin that was filled first, and so on; only the digests at which one bin ends and the next begins are
looked up, and rows find their shard by size and digest, without a shuffle.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import plain_names, settle, table

#: Sizes below are classes of their own; above, a class is 1/FINE of its power of two wide, its groups counted as the largest size in it.
EXACT, FINE = 1 << 15, 1 << 10
#: Groups of a size that are put in order together.
RANKED = 1 << 14
#: Groups of several rows (24 bytes each) up to which their list is broadcast; beyond, rows are joined by shuffle.
BROADCAST_GROUPS = 300_000


class FreeSpace:
    """Bins ordered by (remaining capacity, bin): a treap with fixed pseudo-random priorities."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _split(node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = FreeSpace._split(node[2], key)
            return node, right
        left, node[1] = FreeSpace._split(node[1], key)
        return left, node

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = FreeSpace._merge(a[2], b)
            return a
        b[1] = FreeSpace._merge(a, b[1])
        return b

    def add(self, room: int, bin_: int) -> None:
        left, right = self._split(self.root, (room, bin_))
        node = [(room, bin_), None, None, zlib.crc32(f"{room}:{bin_}".encode())]
        self.root = self._merge(self._merge(left, node), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room that holds ``size``."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[1] is not None:
            node = node[1]
        first, right = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, right)
        return first[0]


def pack_sizes(counts: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[list[tuple[int, int]]] | None:
    """For each (size, count), largest size first: how many of them enter which bin, in order. None if more than ``most`` bins are needed.

    An item larger than ``capacity`` gets a bin of its own.
    """
    out, used, free = [], 0, FreeSpace()
    for size, count in counts:
        runs = []
        while count:
            found = free.take(size)
            if found is None:
                if used == most:
                    return None
                found, used = (max(capacity, size), used), used + 1
            n = min(count, found[0] // size) if size else count
            runs.append((found[1], n))
            free.add(found[0] - n * size, found[1])
            count -= n
        out.append(runs)
    return out


def pack_counts(counts: list[tuple[int, int]], n_bins: int) -> list[list[tuple[int, int]]]:
    """``pack_sizes`` at the smallest capacity that ``n_bins`` bins allow (searched by halving)."""
    low = max([-(-sum(s * n for s, n in counts) // n_bins), *(s for s, _ in counts), 1]) if counts else 1
    best = pack_sizes(counts, low, n_bins)
    if best is not None:
        return best
    high = 2 * low  # enough: any two bins then hold more than ``low`` together
    while high - low > max(1, low // 2000):
        mid = (low + high) // 2
        found = pack_sizes(counts, mid, n_bins)
        low, high, best = (low, mid, found) if found is not None else (mid, high, best)
    return best if best is not None else pack_sizes(counts, high, n_bins)


def _by_item(sizes: list[int], packed) -> list[int] | None:
    """Bin of each item; of equal items the first enters the bin that was filled first."""
    if packed is None:
        return None
    bins = [0] * len(sizes)
    order = iter(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)))
    for runs in packed:
        for bin_, n in runs:
            for _ in range(n):
                bins[next(order)] = bin_
    return bins


def _counts(sizes: list[int]) -> list[tuple[int, int]]:
    return sorted(Counter(sizes).items(), reverse=True)


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each item; an item larger than ``capacity`` gets a bin of its own. None if more than ``most`` bins are needed."""
    return _by_item(sizes, pack_sizes(_counts(sizes), capacity, most))


def pack(sizes: list[int], n_bins: int) -> list[int]:
    """Best fit decreasing at the smallest capacity that ``n_bins`` bins allow."""
    return _by_item(sizes, pack_counts(_counts(sizes), n_bins))


def size_class(size: Column) -> Column:
    """The size that a group counts as: its own below EXACT, at most 1/FINE more above.

    There are EXACT + FINE * log2(largest / EXACT) classes at most: 80,000 up to an exabyte.
    """
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) - 10)).cast("long")
    return F.when(size < EXACT, size).otherwise(F.ceil(size / step) * step).cast("long")


def with_group(docs: DataFrame) -> DataFrame:
    """``docs`` with the digest of the text (``__group`` and ``__more``, 128 bits; null as empty) and the size of the row (``__size``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = lambda at: F.conv(F.substring(F.md5(text), at, 16), 16, -10).cast("long")
    return docs.withColumns({"__group": half(1), "__more": half(17), "__size": F.octet_length(text).cast("long") + 8})


def boundaries(groups: DataFrame, ends: DataFrame) -> DataFrame:
    """class, shard and the largest digest (group, more) of each run of ``ends`` (class, shard, last: the place of its last group, from 0).

    Places within a class are by digest; a class of many groups is counted in ranges of the digest first.
    """
    sizes = groups.groupBy("class").agg(F.ceil(F.count("*") / RANKED).alias("ranges"))
    wanted = F.broadcast(ends.select("class").distinct())  # a row for each class at most
    rows = groups.join(wanted, "class", "left_semi").join(F.broadcast(sizes.join(wanted, "class", "left_semi")), "class")
    share = (F.col("group").cast("double") + 2.0**63) / 2.0**64
    rows = rows.withColumn("range", F.least(F.floor(share * F.col("ranges")), F.col("ranges") - 1))
    counts = rows.groupBy("class", "range").count()
    counts = counts.select("class", "range", (F.sum("count").over(Window.partitionBy("class").orderBy("range")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("class", "range").orderBy("group", "more")) - 1
    rows = rows.withColumn("place", place).join(counts, ["class", "range"]).withColumn("last", (F.col("place") + F.col("before")).cast("long"))
    return rows.join(F.broadcast(ends), ["class", "last"]).select("class", "shard", "group", "more")


def assign_shards(rows: DataFrame, n_shards: int, column: str = "shard") -> DataFrame:
    """``rows`` (with ``__group``, ``__more`` and ``__size``) and the shard of each; groups stay whole.

    The driver sees a row for each class of sizes, and for each bin that a class is dealt to. No row is shuffled but the partial sums of groups.
    """
    spark = rows.sparkSession
    groups = rows.groupBy(F.col("__group").alias("group"), F.col("__more").alias("more")).agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows"))
    groups = settle(groups.withColumn("class", size_class(F.col("bytes"))), "shard-groups")
    counts = [(r["class"], r["count"]) for r in groups.groupBy("class").count().orderBy(F.desc("class")).collect()]  # bounded as said in size_class
    packed = pack_counts(counts, n_shards)
    single = [(size, runs[0][0]) for (size, _), runs in zip(counts, packed) if len(runs) == 1]
    ends = [(size, shard, last - 1) for (size, _), runs in zip(counts, packed) if len(runs) > 1 for (shard, _), last in zip(runs, accumulate(n for _, n in runs))]
    found = [(size, shard, None, None) for size, shard in single]
    if ends:
        found += [tuple(r) for r in boundaries(groups, spark.createDataFrame(ends, "class long, shard int, last long")).collect()]
    # for each class its runs in order of digest; the largest digest of a run is its end
    runs = spark.createDataFrame(found, "class long, shard int, group long, more long")
    runs = runs.groupBy(F.col("class").alias("__class")).agg(F.sort_array(F.collect_list(F.struct("group", "more", "shard"))).alias("__runs"))
    # a row knows the size of its own text: the sizes of groups of several rows are listed
    repeated = groups.where("rows > 1").select(F.col("group").alias("__g"), F.col("more").alias("__m"), F.col("class").alias("__c"))
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_GROUPS else repeated
    out = rows.join(repeated, (F.col("__group") == F.col("__g")) & (F.col("__more") == F.col("__m")), "left")
    out = out.join(F.broadcast(runs), F.coalesce("__c", size_class(F.col("__size"))) == F.col("__class"))
    within = lambda r: r["group"].isNull() | (r["group"] > F.col("__group")) | ((r["group"] == F.col("__group")) & (r["more"] >= F.col("__more")))
    return out.select(*rows.columns, F.filter("__runs", within)[0]["shard"].alias(column))


def shard_documents(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row for each row of ``docs``.

    The law is ``bytes``: sizes near equal, as far as groups of equal texts allow (one that exceeds an equal share has a shard to
    itself).  Null texts count as empty; repeated rows get slots each; null doc_ids are allowed; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = with_group(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("text_crc32", F.crc32(F.encode(text, "UTF-8")))
    rows = assign_shards(settle(rows.drop("text"), "shard-rows"), n_shards)
    # slots by place in the table written here: counted in its partitions first
    rows = settle(rows.drop("__group", "__more"), "shard-assigned").withColumn("place", F.monotonically_increasing_id())
    rows = rows.withColumn("part", F.shiftright("place", 33))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("place")) - 1
    counts = rows.groupBy("shard", "part").count()
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    rows = rows.withColumn("slot", slot.cast("long")).join(before, ["shard", "part"])
    return rows.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, n_shards: int = 24, column: str = "shard") -> DataFrame:
    """The rows of ``docs``, with all their columns, and the shard of each (int, last).

    Null texts count as empty; equal texts share a shard; an empty table gives no rows.  A column of ``docs`` that has the name of the new one
    is kept as ``input_`` and its name.
    """
    named, back = plain_names(docs, "text")
    mark = f"shard_{uuid.uuid4().hex}"
    out = assign_shards(with_group(named), n_shards, mark).select(*named.columns, mark)
    out = back(out)
    names = [c.lower() for c in docs.columns]
    for c in docs.columns:
        if c.lower() == column.lower():
            new = f"input_{c}"
            while new.lower() in names:
                new = f"input_{new}"
            out = out.withColumnRenamed(c, new)
    return out.withColumnRenamed(mark, column)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
