"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets the Efraimidis-Spirakis key ``-ln(u) / weight``, ``u`` being uniform in its doc_id, its text and the
seed; ascending keys give a sample weighted by document quality.  A source whose target exceeds its size first
gives complete epochs; the rest of its target is the prefix, in key order, whose words fill it, the last
document being taken in part.

The prefix sum does not sort a source in one task: keys fall into buckets whose sizes are summed first, and
only the bucket in which the budget ends is put in order.  Rows that are there several times share a key; where the budget ends
among them they are numbered, so that their words fill it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import plain_names, settle, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of their names, repeated.
SOURCE_WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and how often a source may be repeated.
SHARE, REPEATS = 1.5, 2
#: Buckets of keys within a source.
BUCKETS = 65536
#: Sources up to which their table is broadcast (some tens of bytes each).
BROADCAST_SOURCES = 50_000


def default_weight(size: Column, n_chars: Column) -> Column:
    """Quality weight of a document from 0.1 to 1: highest for words of six characters on average."""
    mean = (n_chars + 1) / (size + 1)
    return F.greatest(F.lit(0.1), 1 / (1 + F.abs(F.log(mean / 7.0))))


def size_and_key(seed: int, weight: Column | None = None) -> tuple[Column, Column]:
    """Words of a row, and its key (of a row with ``__size``); both depend on text and doc_id alone.

    ``weight`` is the quality of the document, above 0; without it ``default_weight`` stands in.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.md5(text)))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52))
    return size, -F.log(u) / (default_weight(F.col("__size"), F.length(text)) if weight is None else weight)


def sized(docs: DataFrame, seed: int, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, key and bucket of every row."""
    size, key = size_and_key(seed, weight)
    rows = docs.select("doc_id", "source", "text", *([] if weight is None else [weight.alias("__weight")]))
    key = key if weight is None else size_and_key(seed, F.col("__weight"))[1]
    rows = rows.withColumn("__size", size).withColumn("key", key)
    bucket = F.least(F.floor((1 - F.exp(-F.col("key") / 2)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("__size").alias("size"), "key", bucket.alias("bucket"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from one row for each source (source, source_size).

    Sources in ascending order of cap per weight: each takes its cap as long as its share of what is left exceeds it.
    The window over all sources runs in one task; it holds one row for each source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*map(F.lit, SOURCE_WEIGHTS))
    rows = sizes.withColumn("w", F.element_at(weights, ((rank - 1) % len(SOURCE_WEIGHTS) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * float(REPEATS))
    all_rows = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "all": F.sum("source_size").over(all_rows) * SHARE,
        "weights": F.sum("w").over(all_rows),
        "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    rows = rows.withColumn("capped", (F.col("all") - F.col("caps_before")) * F.col("w") / (F.col("weights") - F.col("w_before")) > F.col("cap"))
    left = F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(all_rows)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(all_rows)
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(left * F.col("w") / free).alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def plan_mix(rows: DataFrame) -> tuple[DataFrame, int]:
    """What the mix needs to know of each source: source_size, target, epochs, cut (key and size of the rows among which the budget ends), part (their words); and the number of sources."""
    buckets = settle(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = settle(source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))), "mix-targets")
    n = targets.count()
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    up_to = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket"))
    ends = buckets.withColumn("up_to", up_to).alias("b").join(_small(targets, n).alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    ends = ends.where((F.col("rest") > 0) & (F.col("up_to") >= F.col("rest")) & (F.col("up_to") - F.col("bucket_size") < F.col("rest")))
    ends = ends.select(F.col("b.source").alias("source"), "bucket", (F.col("rest") - F.col("up_to") + F.col("bucket_size")).alias("need"))
    last = rows.alias("r").join(_small(ends, n).alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("r.bucket") == F.col("e.bucket")))
    last = last.groupBy(F.col("r.source").alias("source"), "key", "size", "need").agg(F.sum("size").alias("tied"))
    last = last.withColumn("up_to", F.sum("tied").over(Window.partitionBy("source").orderBy("key", "size")))
    cuts = last.where((F.col("up_to") >= F.col("need")) & (F.col("up_to") - F.col("tied") < F.col("need")))
    cuts = cuts.select("source", F.col("key").alias("cut"), F.col("size").alias("cut_size"), (F.col("need") - F.col("up_to") + F.col("tied")).alias("part"))
    plan = targets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    return settle(plan.select(F.col("t.source").alias("source"), "source_size", "target", "epochs", "cut", "cut_size", "part"), "mix-plan"), n


def _place(key: str, size: str, prefix: str = "") -> Column:
    """Where a row stands: -1 before the cut, 0 among the rows of the cut, 1 after it or in a source that gives complete epochs only."""
    order = F.struct(F.col(key).alias("k"), F.col(size).alias("s"))
    cut = F.struct(F.col(f"{prefix}cut").alias("k"), F.col(f"{prefix}cut_size").alias("s"))
    return F.when(F.col(f"{prefix}cut").isNull() | (order > cut), 1).when(order < cut, -1).otherwise(0)


def with_once(rows: DataFrame, key: str, size: str, prefix: str, once: str) -> DataFrame:
    """``rows`` with the words that are taken of each besides the epochs.

    The rows of a cut are alike in key and size: they are numbered (within parts of the table first, as they may be many), the first ones
    are taken whole and the next in part.
    """
    at, zero, columns = _place(key, size, prefix), F.lit(0).cast("long"), rows.columns
    outside = rows.where(at != 0).withColumn(once, F.when(at < 0, F.col(size)).otherwise(zero))
    mark, place, nth, before = (f"{once}_{x}" for x in ("source", "place", "nth", "before"))
    cut = settle(rows.where(at == 0).withColumn(mark, F.col("source").cast("string")).withColumn(place, F.monotonically_increasing_id()), "mix-cuts")
    part = F.shiftright(F.col(place), 33)
    cut = cut.withColumn(nth, F.row_number().over(Window.partitionBy(mark, part).orderBy(place)) - 1).withColumn(place, part)
    counts = cut.groupBy(F.col(mark).alias("s"), F.col(place).alias("p")).count()
    counts = counts.select("s", "p", (F.sum("count").over(Window.partitionBy("s").orderBy("p")) - F.col("count")).alias(before))
    cut = cut.join(counts, F.col(mark).eqNullSafe(F.col("s")) & (F.col(place) == F.col("p")))
    room = F.col(f"{prefix}part") - (F.col(nth) + F.col(before)) * F.col(size)
    return outside.unionByName(cut.withColumn(once, F.greatest(zero, F.least(F.col(size), room))).select(*columns, once))


def mix_sources(docs: DataFrame, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, taken, one row for each row of ``docs``.

    Null texts have size 0; null sources form one source, the last; empty tables give no rows; rows that are there several times have
    one key and fill a budget one after the other; reruns agree, as keys depend on doc_id, text and seed alone.  Other columns are not read.
    """
    rows = settle(sized(docs, seed, weight), "mix-sizes")
    plan, n = plan_mix(rows)
    joined = rows.alias("r").join(_small(plan, n).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source"))
    joined = with_once(joined, "key", "size", "", "once")
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("once")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, the partial one cut to its first words.

    All columns stay, also those with names of this module's own; null, empty and repeated rows are treated as in ``mix_sources``.
    """
    docs, back = plain_names(docs, "doc_id", "source", "text")
    columns = docs.columns
    rows = settle(sized(docs, seed), "mix-sizes")
    plan, n = plan_mix(rows)
    size, key = size_and_key(seed)
    plan = plan.select(*(F.col(c).alias(f"__{c}") for c in ("source", "epochs", "cut", "cut_size", "part")))
    out = docs.withColumn("__size", size).withColumn("__key", key)
    out = out.join(_small(plan, n), F.col("source").cast("string").eqNullSafe(F.col("__source")))
    out = with_once(out, "__key", "__size", "__", "__once")
    pieces = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("__epochs").cast("int")), F.when(F.col("__once") > 0, F.array("__once")).otherwise(F.array().cast("array<long>")))
    out = out.withColumn("__piece", F.explode(pieces))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("__piece").cast("int")), " ")
    whole = (F.col("__piece") < 0) | (F.col("__piece") >= F.col("__size"))
    return back(out.withColumn("text", F.when(whole, F.col("text")).otherwise(cut)).select(*columns))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS h FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || h), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0::DOUBLE)
            / greatest(0.1::DOUBLE, 1 / (1 + abs(ln((n + 1)::DOUBLE / (size + 1)::DOUBLE / 7.0::DOUBLE)))) AS key
  FROM s
),
a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][((place - 1) % 3) + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM a),
b AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS whole, sum(w) OVER () AS weights, coalesce(sum(cap) OVER before, 0) AS caps_before, coalesce(sum(w) OVER before, 0) AS w_before
  FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
c AS (SELECT *, (whole - caps_before) * w / (weights - w_before) > cap AS capped FROM b),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE (whole - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END::DOUBLE AS target FROM c
),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.*, e.source_size, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.size, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM p
"""
