"""Text, hash, bit and time functions over whole tables."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..registry import query
from ..sources.tables import table

MARKS = r"[\s　.．、，,。；;：:（）()【】\[\]_-]+"


@query(rf"SELECT p_partkey, lower(regexp_replace(p_name || ' (' || p_brand || ')', '{MARKS}', '', 'g')) AS canonical FROM part")
def canonical_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", X.canonical_text(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("canonical"))


@query(r"""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_size || '.' || (p_partkey % 7) || ' ' || p_name END AS title FROM part)
SELECT p_partkey, nullif(regexp_extract(title, '^\s*(\d+(?:\.\d+)*)[.．、\s]+(\S.*)$', 1), '') AS number,
       CASE WHEN regexp_matches(title, '^\s*(\d+(?:\.\d+)*)[.．、\s]+(\S.*)$') THEN trim(regexp_extract(title, '^\s*(\d+(?:\.\d+)*)[.．、\s]+(\S.*)$', 2)) ELSE trim(title) END AS title FROM t""")
def numbered_titles(spark, d):
    title = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(" "), F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", X.title_number(title).alias("number"), X.title_text(title).alias("title"))


@query("""
SELECT n_nationkey, ':' || replace(lower(r_name), ' ', '') || ' > ' || (n_nationkey + 1) || ':' || replace(lower(n_name), '_', '') AS section_key
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def section_keys(spark, d):
    numbered = F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(" "), F.col("n_name"))
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", X.section_key(F.array(F.col("r_name"), numbered)).alias("section_key"))


@query("""
SELECT lang, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(round_even(length(text) / 4.0, 0) AS BIGINT)) END)::BIGINT AS tokens_quarter,
       sum(CAST(ceil(length(text) / 1.8) AS BIGINT))::BIGINT AS tokens_dense FROM documents GROUP BY lang""")
def token_estimates(spark, d):
    rows = table(spark, d, "documents").select("lang", X.tokens_quarter(F.col("text")).cast("long").alias("q"), X.tokens_dense(F.length("text")).alias("n"))
    return rows.groupBy("lang").agg(F.sum("q").alias("tokens_quarter"), F.sum("n").alias("tokens_dense"))


@query(r"""
SELECT conv_id, turn, CASE WHEN length(t) <= 220 THEN t ELSE t[1:220] || '...' END AS preview
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)""")
def turn_previews(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.truncated(F.col("text")).alias("preview"))


@query(r"""
SELECT lang, sum(length(text) - a + (a + 1) // 2)::BIGINT AS width
FROM (SELECT lang, text, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS a FROM documents) GROUP BY lang""")
def display_widths(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(X.display_length(F.col("text"))).cast("long").alias("width"))


@query(r"""
SELECT source, count(*) FILTER (r <> text) AS redacted, count(*) AS n
FROM (SELECT source, text, regexp_replace(regexp_replace(text, '(?i)\bsk-[A-Za-z0-9_-]{8,}', 'sk-***', 'g'), '(?i)\b(bearer)\s+[A-Za-z0-9._-]{8,}', '\1 ***', 'g') AS r FROM documents) GROUP BY source""".replace("FILTER (r", "FILTER (WHERE r"))
def redaction_counts(spark, d):
    rows = table(spark, d, "documents").select("source", "text", X.redacted(F.col("text")).alias("r"))
    return rows.groupBy("source").agg(F.count(F.when(F.col("r") != F.col("text"), 1)).alias("redacted"), F.count("*").alias("n"))


@query("SELECT o_orderkey, left(sha256('=' || o_custkey || chr(31) || '=' || o_orderstatus || chr(31) || '=' || o_orderpriority), 24) AS key FROM orders")
def idempotency_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.short_key(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key"))


@query("SELECT l_orderkey, sha256(string_agg(DISTINCT l_partkey::VARCHAR, '|' ORDER BY l_partkey::VARCHAR)) AS group_key FROM lineitem GROUP BY l_orderkey")
def member_group_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(V.group_key(F.collect_set(F.col("l_partkey").cast("string"))).alias("group_key"))


@query("""
SELECT vec_id, CASE WHEN h >= 9223372036854775808 THEN (h - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS bits
FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (9223372036854775808::HUGEINT >> (i - 1)::INT) ELSE 0::HUGEINT END)) AS h FROM embeddings)""")
def sign_hashes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.sign_bits(F.col("embedding")).alias("bits"))


@query("""
WITH e AS (SELECT event_id, CAST(round(value * 37) AS BIGINT) AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM e""")
def duration_texts(spark, d):
    return table(spark, d, "events").select("event_id", V.duration_text(F.col("value") * 37).alias("duration"))


@query("""
SELECT CASE WHEN c >= 0.85 THEN '>=0.85' WHEN c >= 0.65 THEN '0.65-0.85' WHEN c > 0 THEN '0-0.65' ELSE 'missing' END AS bucket, count(*) AS n
FROM (SELECT CASE WHEN event_type <> 'error' THEN value / 250 END AS c FROM events) GROUP BY 1""")
def confidence_buckets(spark, d):
    c = F.when(F.col("event_type") != "error", F.col("value") / 250)
    return table(spark, d, "events").groupBy(V.confidence_bucket(c).alias("bucket")).agg(F.count("*").alias("n"))


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE c LIKE 'THe%') AS upper_like, sum(len(c))::BIGINT AS words FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9_]+') AS c0, regexp_extract_all(lower(text), '[a-z0-9_]+') AS c FROM conversations)""".replace("count(*) FILTER (WHERE c LIKE 'THe%') AS upper_like, ", ""))
def latin_token_totals(spark, d):
    return table(spark, d, "conversations").agg(F.count("*").alias("n"), F.sum(F.size(X.query_tokens(F.col("text")))).alias("words"))


@query("""
SELECT conv_id, turn, (len(words) - len(list_distinct(words)))::BIGINT AS repeats
FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_]+') AS words FROM conversations)""")
def repeated_token_counts(spark, d):
    words = X.query_tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.size(words) - F.size(F.array_distinct(words))).cast("long").alias("repeats"))


@query("""
SELECT source, round(sum(coalesce(nullif(CAST(regexp_extract(text, '([0-9]+)', 1) AS VARCHAR), ''), '0')::DOUBLE), 2) AS first_numbers
FROM (SELECT source, regexp_extract(text, '([0-9]{1,6})', 1) AS text FROM documents) GROUP BY source""")
def first_numbers(spark, d):
    first = F.nullif(F.regexp_extract("text", "([0-9]{1,6})", 1), F.lit(""))
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.sum(F.coalesce(first.cast("double"), F.lit(0.0))), 2).alias("first_numbers"))


@query("""
SELECT event_id, k, length(props)::BIGINT AS chars FROM (SELECT event_id, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k > 50""")
def json_fields(spark, d):
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.length("props").cast("long").alias("chars"))
    return rows.where("k > 50")
