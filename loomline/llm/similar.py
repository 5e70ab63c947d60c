"""Near duplicates at a stated similarity of word shingles, without loss.

SimHash fingerprints of 64 bits find most of the pairs with a Jaccard similarity of 0.8, but not all: such texts differ in up to a dozen bits, and may share no
positional byte.  So texts go by fingerprints first, through an inverted index on positional bytes, a tally of shared bytes and a verification, and an exact way, by
the same three steps on shingles, follows for the rest:

1.  Texts that are equal but for case and white space are one text.
2.  An index entry of a fingerprint is a combination of ``MATCH`` of its eight positional bytes.  A list links the texts in it to the first of those that are known to stay (which 3
    tells); pairs that share MATCH positional bytes, as all within 8 - MATCH bits do, are verified on the whole sets.  What the lists do not link is left to 3 and 4.
3.  Two sets with a similarity of t share at least t of either, so among the n - ceil(t n) + k first shingles of each, in any one order of all shingles, are k common
    ones.  These are its index entries, k being a twentieth of the shingles; shared entries are tallied for each pair, and pairs with fewer than k are dropped.  Shingles that are frequent in a sample of the texts come last in the order (which changes the size of
    lists and no result), so that a passage that many documents share makes no list unless it is most of them.
4.  A parity sketch of 2,048 bits has the parity of how many shingles fall on each bit.  Sets that differ in d shingles differ in at most d bits, so pairs with more
    differing bits than the similarity allows shingles are dropped.  What stays is verified on the whole sets.

The first document of a group stays: one goes if a document that stays is before it and similar.  Most of a large group goes at once, with the first of all
lists that it is in; pairs are formed only of what is left.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_names, settle, slices
from .fingerprints import majority_bits, positional_byte, shared_bytes

SHINGLE, SEED = 5, 42
#: Similarity, as a fraction.
PART, WHOLE = 4, 5
#: Positional bytes of a fingerprint in an index entry, and that a pair must share.
MATCH = 3
#: Share of its shingles by which an index entry list is longer than need be, and which pairs must then have in common: one in TALLY.
TALLY = 20
#: Parity bits; one of SAMPLE texts is counted for the order, and a shingle is frequent from OFTEN of these on.
BITS, SAMPLE, OFTEN = 2048, 16, 8
#: Frequent shingles that the order knows at most (8 bytes each); others keep their place.
FREQUENT = 500_000
#: Rounds in which documents go with the first of their lists before pairs are formed.
ROUNDS = 2
#: Nodes (16 bytes each) up to which their list is broadcast to the texts, and entries (8 bytes each) up to which theirs is to the postings; beyond, rows are shuffled to them.
BROADCAST_NODES, BROADCAST_ENTRIES = 250_000, 3_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and the white space of ASCII alone


def shingle_set(text: str | None) -> np.ndarray:
    """XXH64 of the different shingles of a text, ascending; a shorter text is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    k = min(SHINGLE, len(found))
    first = [0, *(ends[: len(found) - k] + 1).tolist()]
    return np.unique(np.array([xxh64_intdigest(line[i:j], SEED) for i, j in zip(first, ends[k - 1 :].tolist())], dtype=np.uint64))


def node(doc_id: Column, text: Column) -> Column:
    """Sixteen bytes that order documents by doc_id, those without one last, then by a hash of their text."""
    number = F.coalesce(doc_id.cast("long"), F.lit(2**63 - 1)).bitwiseXOR(F.lit(-(2**63)))
    return F.unhex(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (number, F.xxhash64(text.cast("string"))))))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``node``) without all but the first of the texts that are equal but for case and white space."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            d = b"".join(hashlib.blake2b(b" ".join(words(t)), digest_size=16).digest() for t in batch.column("text").to_pylist())
            d = np.frombuffer(d, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=["node", "d1", "d2"])

    rows = settle(docs.select("node", F.col("text").cast("string").alias("text")).mapInArrow(run, "node binary, d1 long, d2 long"), "text-digests")
    repeated = rows.groupBy("node").count().where("count > 1").limit(1).count()
    first = settle(rows.groupBy("d1", "d2").agg(F.min("node").alias("node")).select("node"), "first-texts")
    if repeated or first.count() > BROADCAST_NODES:
        out = docs.join(first.hint("merge"), "node", "left_semi")
        return settle(out.dropDuplicates(["node"]) if repeated else out, "distinct-texts")
    return docs.join(F.broadcast(first), "node", "left_semi")


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles of many texts of the sample, ascending."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))], names=["shingle"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "shingle long")
    often = some.groupBy("shingle").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "shingle").limit(FREQUENT).select("shingle").collect()
    return np.sort(np.array([r.shingle for r in often], dtype=np.int64).view(np.uint64))


def index(texts: DataFrame) -> DataFrame:
    """node, n (shingles), fp (fingerprint), entries and parity (longs) of every text that has words."""
    often = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))

    def run(batches):
        import pyarrow as pa

        last = often.value
        for batch in slices(batches):
            nodes, sizes, prints, entries, parity = [], [], [], [], []
            for k, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                s = shingle_set(text)
                if len(s):
                    late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                    entries.append(np.concatenate([s[~late], s[late]])[: len(s) + PART * len(s) // -WHOLE + guaranteed(len(s))].view(np.int64))
                    parity.append(np.packbits(np.bincount((s >> np.uint64(64 - (BITS - 1).bit_length())).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view("<i8"))
                    nodes.append(k)
                    sizes.append(len(s))
                    prints.append(majority_bits(s))
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((nodes, sizes, prints, entries, parity), kinds)], names=["node", "n", "fp", "entries", "parity"])

    return settle(texts.mapInArrow(run, "node binary, n int, fp long, entries array<long>, parity array<long>"), "shingle-index")


def guaranteed(n):
    """Index entries that a set of ``n`` shingles shares at least with any that is similar and not smaller."""
    return F.greatest(F.lit(1), F.floor(n / TALLY)) if isinstance(n, Column) else max(1, n // TALLY)


def sizes_fit(x: Column, y: Column) -> Column:
    """Whether sets of ``x`` and ``y`` shingles can have the wanted similarity."""
    return (x * WHOLE >= y * PART) & (y * WHOLE >= x * PART)


def may_be_similar(a: str, b: str, bits: int = BITS) -> Column:
    """What pairs of the wanted similarity have in common: sizes, and parities of ``bits`` bits, of the rows ``a`` and ``b``."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum(F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(bits // 64))
    return sizes_fit(x, y) & (differ * (WHOLE + PART) <= (x + y) * (WHOLE - PART))


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            sets = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    pairs = settle(pairs, "candidates")
    nodes = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidate-nodes")
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    sets = settle(texts.join(nodes, "node", "left_semi").mapInArrow(run, "node binary, shingles array<long>"), "candidate-sets")
    # the sets are large and the pairs small: sets of b meet their pairs first, without a shuffle where pairs are few
    few = F.broadcast(pairs) if pairs.count() <= BROADCAST_NODES else pairs
    found = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set")).join(few, "b")
    found = found.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set")), "a")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return settle(found.where(shared * WHOLE >= (F.size("a_set") + F.size("b_set") - shared) * PART).select("a", "b"), "similar-pairs")


def _of_several(postings: DataFrame) -> DataFrame:
    """Entries of lists that have several members."""
    brief = F.col("entry").bitwiseAND(F.lit((1 << 40) - 1))  # five bytes to shuffle; lists that share them stay, which does no harm
    several = settle(postings.groupBy(brief.alias("brief")).count().where("count > 1").select("brief"), "shared-entries")
    several = F.broadcast(several) if several.count() <= BROADCAST_ENTRIES else several
    return settle(postings.join(several, brief == F.col("brief"), "left_semi"), "postings")


def by_fingerprints(prints: DataFrame, stay: DataFrame, waiting: DataFrame) -> DataFrame:
    """Pairs (a, b) of a staying and a later waiting node (tables of ``node``) that share MATCH positional bytes of their fingerprints in ``prints`` (node, fp).

    A waiting node meets the first staying one of each of its lists, so that there are never more pairs than entries.
    """
    entry = lambda n, some: F.lit(n << 8 * MATCH) + sum(positional_byte("fp", i) * (1 << 8 * k) for k, i in enumerate(some))
    entries = F.explode(F.array(*(entry(n, some) for n, some in enumerate(combinations(range(8), MATCH))))).alias("entry")
    spread = lambda nodes: prints.join(nodes, "node", "left_semi").select("node", "fp", entries)
    firsts = settle(spread(stay).groupBy("entry").agg(F.min(F.struct("node", "fp")).alias("first")), "first-of-bytes")
    pairs = spread(waiting).join(firsts, "entry").where((F.col("first.node") < F.col("node")) & (shared_bytes(F.col("first.fp"), F.col("fp")) >= MATCH))
    return pairs.select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()


def first_ones(pairs: DataFrame) -> DataFrame:
    """Nodes that go: of ``pairs`` (a before b, similar) b goes if a stays."""
    gone = None
    while pairs.limit(1).count():
        stay = pairs.select(F.col("a").alias("node")).join(pairs.select(F.col("b").alias("node")), "node", "left_anti").distinct()
        now = settle(pairs.join(stay.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct(), "gone")
        for c in ("a", "b"):
            pairs = pairs.join(now.withColumnRenamed("node", c), c, "left_anti")
        pairs = settle(pairs, "similar-pairs")
        gone = now if gone is None else gone.unionByName(now)
    return gone


def similar_to_others(texts: DataFrame) -> list[DataFrame]:
    """Tables of the nodes of ``texts`` (node, text; each once) that go, because a text that stays is before them and similar; the first has those that go by fingerprints."""
    known = index(texts)
    light, gone = known.select("node", "n", "parity"), []
    postings = _of_several(known.select("node", "n", F.explode("entries").alias("entry")))
    with_parity = lambda c: light.select(F.col("node").alias(c), F.struct("n", "parity").alias(f"{c}_row"))
    for n in range(ROUNDS):
        if not postings.limit(1).count():
            return gone
        firsts = settle(postings.groupBy("entry").agg(F.min(F.struct("node", "n")).alias("first")), "first-of-lists")
        # a text with another first one in one of its lists is not yet known to stay
        behind = settle(postings.join(firsts, "entry").where("first.node <> node").select("node", "n", "first"), "behind-firsts")
        waiting = behind.select("node").distinct()
        stay = settle(firsts.select("first.node").distinct().join(waiting, "node", "left_anti"), "staying")
        if n == 0:
            pairs = by_fingerprints(known.select("node", "fp"), stay, waiting)
            pairs = pairs.join(with_parity("a"), "a").join(with_parity("b"), "b").where(may_be_similar("a_row", "b_row")).select("a", "b")
            gone.append(settle(similar(pairs, texts).select(F.col("b").alias("node")).distinct(), "gone-by-fingerprints"))
            behind, postings = (x.join(gone[0], "node", "left_anti") for x in (behind, postings))
        # what stays is first in all of its lists, so that the tally has all entries that it shares
        pairs = behind.where(sizes_fit(F.col("n"), F.col("first.n"))).groupBy(F.col("first.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("tally"), F.min(F.least("n", "first.n")).alias("least"))
        pairs = pairs.where(F.col("tally") >= guaranteed(F.col("least"))).select("a", "b")
        pairs = settle(pairs.join(stay.withColumnRenamed("node", "a"), "a", "left_semi"), "behind-staying")
        pairs = pairs.join(with_parity("a"), "a").join(with_parity("b"), "b").where(may_be_similar("a_row", "b_row")).select("a", "b")
        now = settle(similar(pairs, texts).select(F.col("b").alias("node")).distinct(), "gone")
        gone.append(now)
        postings = _of_several(postings.join(now.unionByName(stay), "node", "left_anti"))
    # the parities of a row's quarters, folded, are parities of a quarter of the bits: less to shuffle with each entry
    fold = F.array(*(F.col("parity")[i].bitwiseXOR(F.col("parity")[i + q]).bitwiseXOR(F.col("parity")[i + 2 * q]).bitwiseXOR(F.col("parity")[i + 3 * q]) for q in [BITS // 256] for i in range(q)))
    rows = postings.select("node", "entry").join(light.select("node", "n", fold.alias("parity")), "node")
    a, b = rows.alias("x"), rows.alias("y")
    pairs = a.join(b, (F.col("x.entry") == F.col("y.entry")) & (F.col("x.node") < F.col("y.node")) & may_be_similar("x", "y", BITS // 4))
    pairs = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("tally"), F.min(F.least("x.n", "y.n")).alias("least"))
    pairs = settle(pairs.where(F.col("tally") >= guaranteed(F.col("least"))).select("a", "b"), "pairs-of-lists")
    pairs = pairs.join(with_parity("a"), "a").join(with_parity("b"), "b").where(may_be_similar("a_row", "b_row")).select("a", "b")
    more = first_ones(similar(pairs, texts))
    return gone if more is None else [*gone, more]


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: a document goes if another that stays is before it and shares a similarity of at least 0.8 of 5-word shingles.

    Documents are in order of their doc_id, those without one last, then of a hash of their text.  Texts that are equal but for case and white space are one;
    null, empty and blank texts are equal; texts of fewer than five words are one shingle; of repeated rows one stays; columns of any name stay; an
    empty table gives an empty one.
    """
    docs, back = plain_names(docs, "doc_id", "text")
    columns = docs.columns
    docs = distinct_texts(docs.withColumn("node", node(F.col("doc_id"), F.col("text"))))
    for gone in similar_to_others(docs.select("node", F.col("text").cast("string").alias("text"))):
        docs = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone, "node", "left_anti")
    return back(docs.select(*columns))
