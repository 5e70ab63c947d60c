"""Benchmark decontamination by winnowing, in DataFrame operations alone.

A text is hashed as overlapping 5-grams of words; of every six neighbouring hashes the smallest is its fingerprint.  Two texts that
share ten words in a row share the fingerprint of that window, so joining fingerprints finds every shared window.  Each hit
names up to six places where a shared window may begin; the words there are compared with the windows of the items, and
what matches is extended to the words it covers.  Items of fewer than ten words are one window each; for each such length that
occurs, hashes of that many words are taken at every place (a window of one hash).  All lengths share one pass over the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, plain_names, settle, table

#: Words of a window, and words hashed together; WINDOW - GRAM + 1 hashes make a fingerprint.
WINDOW, GRAM = 10, 5
#: What stands between words, once lowered. Splitting there takes a quarter of the time of extracting the words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes, both counted, up to which fingerprints, windows or hits are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 32 << 20


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed; null as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def window_texts(words: Column, length: int) -> Column:
    """(start, text) of each run of ``length`` words."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= length, F.sequence(F.lit(0), F.size(w) - length)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice(w, i + 1, F.lit(length)), " ").alias("words")))

    return let(words, of)


def span_of(length: int) -> int:
    """Hashes of a window of ``length`` words."""
    return length - GRAM + 1 if length == WINDOW else 1


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def fingerprints(hashed: Column, length: int) -> Column:
    """Array of (length, start, value) for hashed words: the fingerprint of the windows that begin at ``start`` or up to WINDOW - GRAM places later.

    Neighbouring windows with one value are named once; in a longer run of one value every later window is named.
    """
    span = span_of(length)
    gram = length - span + 1

    def places(n: Column, of: int) -> Column:
        return F.when(n >= of, F.sequence(F.lit(0), n - of)).otherwise(F.array().cast("array<int>"))

    def least(g: Column) -> Column:
        if span == 1:
            return g
        return F.transform(places(F.size(g), span), lambda i: F.least(*(F.get(g, i + j) for j in range(span))))

    def entry(v: Column, i: Column) -> Column:
        return F.struct(F.lit(length).alias("length"), i.alias("start"), v.alias("value"))

    def named(m: Column) -> Column:
        if span == 1:
            return F.transform(m, entry)
        first = lambda v, i: (i == 0) | (v != F.get(m, i - 1)) | F.coalesce(v == F.get(m, i - span), F.lit(False))
        return F.transform(m, lambda v, i: F.when(first(v, i), entry(v, i)))

    grams = lambda h: F.transform(places(F.size(h), gram), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(gram))))
    return let(grams(hashed), lambda g: let(least(g), named))


def _small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df``, a settled table, marked for broadcast if its rows and their bytes are few."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def item_windows(items: DataFrame) -> DataFrame:
    """length, words, item of every window of every item."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    long = words.where(F.size("w") >= WINDOW).select("item", F.explode(window_texts(F.col("w"), WINDOW)).alias("x")).select(F.lit(WINDOW).alias("length"), "x.words", "item")
    short = words.where(F.size("w") < WINDOW).select(F.size("w").alias("length"), F.array_join("w", " ").alias("words"), "item")
    return long.unionByName(short).distinct()


def row_key() -> Column:
    """128 bits that tell rows with different contents apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), text)))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of the row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), row_key().alias("row"))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """row, doc_id, start, length, item of every window of an item that occurs in a document."""
    rows = _rows(docs)
    windows = settle(item_windows(items), "item-windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # ten at most
    if not lengths:
        return rows.sparkSession.createDataFrame([], "row binary, doc_id long, start int, length int, item string")

    def prints(words: Column, of: list[int]) -> Column:
        return let(word_hashes(words), lambda h: F.flatten(F.array(*(fingerprints(h, n) for n in of))))

    wanted = None
    for n in lengths:
        some = windows.where(F.col("length") == n).select(F.explode(prints(F.split("words", " "), [n])).alias("f")).select("f.length", "f.value")
        wanted = some if wanted is None else wanted.unionByName(some)
    wanted = settle(wanted.distinct(), "item-fingerprints")
    ours = rows.select("row", F.explode(prints(words_of(F.col("text")), lengths)).alias("f")).where("f is not null").select("row", "f.*")
    hits = ours.join(_small(wanted, F.lit(12)), ["length", "value"]).groupBy("row").agg(F.collect_set(F.struct("length", "start")).alias("starts"))
    hits = settle(hits, "hits")
    # a fingerprint stands for the windows that begin at its place or at one of the next
    later = lambda s: F.when(s["length"] == WINDOW, span_of(WINDOW) - 1).otherwise(0)
    windows_at = lambda s: F.transform(F.sequence(s["start"], s["start"] + later(s)), lambda i: F.struct(s["length"].alias("length"), i.alias("start")))
    begins = F.array_distinct(F.flatten(F.transform("starts", windows_at)))
    near = rows.join(_small(hits, F.size("starts") * 32 + 48), "row").select("row", "doc_id", words_of(F.col("text")).alias("w"), begins.alias("begins"))
    whole = lambda w: F.filter("begins", lambda s: s["start"] + s["length"] <= F.size(w))
    words_at = lambda w, s: F.array_join(F.slice(w, s["start"] + 1, s["length"]), " ")
    texts = let(F.col("w"), lambda w: F.transform(whole(w), lambda s: F.struct(s["length"].alias("length"), s["start"].alias("start"), words_at(w, s).alias("words"))))
    near = near.select("row", "doc_id", F.explode(texts).alias("x")).select("row", "doc_id", "x.*")
    known = _small(windows, F.octet_length("words") + F.octet_length(F.coalesce("item", F.lit(""))) + 16)
    return near.join(known, ["length", "words"]).select("row", "doc_id", "start", "length", "item")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row for each row of ``docs``.

    Null and empty texts have no words; repeated documents are judged each; repeated items count once for each item_id (null: as
    the empty string); a null doc_id is kept; without items nothing is hit; an empty table gives no rows.
    """
    spans = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "length")), lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    names = F.sort_array(F.collect_set(F.coalesce("item", F.lit(""))))
    hit = matches(docs, items).groupBy("row").agg(F.size(spans).alias("n_hit"), names.alias("names"))
    hit = settle(hit.select("row", "n_hit", F.size("names").alias("n_items"), F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256")), "contaminated")
    every = _rows(docs).select("row", "doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    every = every.join(hit, "row", "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", nothing).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns, whatever their names.

    Null and empty texts are clean; repeated rows stay or go together; without items everything stays; an empty table gives no rows.
    """
    named, back = plain_names(docs, "doc_id", "text")
    hit = settle(matches(docs, items).select(F.col("row").alias("__hit")).distinct(), "contaminated")
    return back(named.join(_small(hit, F.lit(16)), row_key() == F.col("__hit"), "left_anti"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, 10 AS n, array_to_string(w[i:i + 9], ' ') AS x FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
  UNION SELECT item, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 9
),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, x)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
