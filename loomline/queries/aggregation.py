"""Counts, histograms, statistics, having rules."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import aggregates as A
from ..registry import query
from ..sources.tables import table

MARKS = r"[\s　.．、，,。；;：:（）()【】\[\]_-]+"


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, d):
    return A.value_counts(table(spark, d, "events"), "event_type")


@query("""
SELECT event_type, round(sum(value), 2) AS sum_seconds, round(avg(value), 2) AS avg_seconds, round(median(value), 2) AS median_seconds, round(min(value), 2) AS min_seconds, round(max(value), 2) AS max_seconds
FROM events GROUP BY event_type""")
def duration_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*A.duration_stats(F.col("value")))


@query("""
SELECT CASE WHEN value <= 90 THEN '<=90s' WHEN value <= 180 THEN '90-180s' WHEN value <= 300 THEN '180-300s' ELSE '>300s' END AS bucket, count(*) AS n FROM events GROUP BY 1""")
def duration_buckets(spark, d):
    return table(spark, d, "events").groupBy(V.duration_bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


@query(rf"""
SELECT sha256(lower(regexp_replace(text, '{MARKS}', '', 'g'))) AS digest, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_hash_groups(spark, d):
    rows = table(spark, d, "documents").select(F.sha2(X.canonical_text(F.col("text")), 256).alias("digest"), "doc_id", "source")
    return A.repeated_values(rows, "digest", F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("sources"))


@query(rf"""
SELECT sha256(lower(regexp_replace(text, '{MARKS}', '', 'g'))) AS digest, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def cross_source_duplicates(spark, d):
    rows = table(spark, d, "documents").select(F.sha2(X.canonical_text(F.col("text")), 256).alias("digest"), "source").distinct()
    return A.repeated_values(rows, "digest", F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources")).drop("n")


@query("""
SELECT user_id, event_type, n, first_at, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_at, event_type) AS rank FROM (
 SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY 1, 2)) WHERE rank <= 2""")
def most_common_types(spark, d):
    return A.top_values(table(spark, d, "events"), ["user_id"], "event_type", "event_id", 2).withColumn("rank", F.col("rank").cast("long"))


@query("""
SELECT l_partkey, l_suppkey, count(*) AS n, min(l_linenumber) AS first_at, max(l_linenumber) AS last_at FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2 AND max(l_linenumber) - min(l_linenumber) <= 3""")
def suite_candidates(spark, d):
    return A.spread_within(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_linenumber", 3)


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS members, max(l_linenumber) AS expected FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) < max(l_linenumber)")
def split_groups(spark, d):
    return A.incomplete_groups(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_linenumber")


@query("""
WITH dim AS (SELECT unnest(['ECONOMY', 'STANDARD', 'PROMO', 'LARGE', 'NONE']) AS p_type)
SELECT dim.p_type, coalesce(n, 0) AS n, coalesce(quantity, 0) AS quantity FROM dim LEFT JOIN (SELECT p_type, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) f ON f.p_type = dim.p_type""")
def zero_filled_domains(spark, d):
    dim = spark.createDataFrame([(t,) for t in ("ECONOMY", "STANDARD", "PROMO", "LARGE", "NONE")], "p_type string")
    facts = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return A.zero_filled(dim, facts, "p_type", F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""
SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE s = 'succeeded') AS succeeded, count(*) FILTER (WHERE s <> 'succeeded') AS failed, count(*) FILTER (WHERE s = 'timeout') AS timeouts,
 sum(k)::BIGINT AS units, count(DISTINCT event_type) AS types, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_time
FROM (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'timeout' ELSE 'succeeded' END AS s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY user_id""")
def audit_job_summary(spark, d):
    s = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "timeout").otherwise("succeeded")
    e = table(spark, d, "events").withColumn("s", s).withColumn("k", F.from_json("props", "k bigint")["k"])
    at = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    return e.groupBy("user_id").agg(
        F.count("*").alias("calls"), A.count_if(F.col("s") == "succeeded").alias("succeeded"), A.count_if(F.col("s") != "succeeded").alias("failed"), A.count_if(F.col("s") == "timeout").alias("timeouts"),
        F.sum("k").alias("units"), F.count_distinct("event_type").alias("types"), at(F.min("ts"), "first_time"), at(F.max("ts"), "last_time"),
    )


@query("""
SELECT o_custkey, count(*) AS runs, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, round(sum(o_totalprice), 2) AS active, (max(epoch(o_orderdate)) - min(epoch(o_orderdate)))::BIGINT AS span,
 arg_max(o_orderkey, CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate)::BIGINT * 10000000 + o_orderkey END) AS latest_success FROM orders GROUP BY o_custkey""")
def job_history(spark, d):
    o = table(spark, d, "orders").withColumn("t", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    done = F.col("o_orderstatus") == "F"
    return o.groupBy("o_custkey").agg(
        F.count("*").alias("runs"), A.count_if(done).alias("succeeded"), F.round(F.sum("o_totalprice"), 2).alias("active"), (F.max("t") - F.min("t")).alias("span"),
        F.max_by("o_orderkey", F.when(done, F.col("t") * 10000000 + F.col("o_orderkey"))).alias("latest_success"),
    )


@query("""
SELECT coalesce(n_name, '*') AS n_name, coalesce(c_mktsegment, '*') AS c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)""")
def rollup_totals(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = j.rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return out.select(F.coalesce("n_name", F.lit("*")).alias("n_name"), F.coalesce("c_mktsegment", F.lit("*")).alias("c_mktsegment"), "n", "balance")


@query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag")
def status_pivot(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return out.select("l_returnflag", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("F", "O")))


@query("""
SELECT source, count(*) AS documents, count(*) FILTER (WHERE quality = 0) AS poor, count(*) FILTER (WHERE toxic = 1) AS toxic, printf('%.2f%%', count(*) FILTER (WHERE quality IS NOT NULL) * 100.0 / count(*)) AS labelled
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def source_summary(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("documents"), A.count_if(F.col("quality") == 0).alias("poor"), A.count_if(F.col("toxic") == 1).alias("toxic"), V.percent_text(F.count("quality"), F.count("*")).alias("labelled"))


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    price = F.col("l_extendedprice")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line_md5, n FROM (SELECT md5(line) AS line_md5, count(*) AS n FROM l WHERE length(line) > 0 GROUP BY 1) WHERE n >= 8 ORDER BY n DESC, line_md5 LIMIT 50""")
def frequent_lines(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0)
    return A.frequent_lines(lines.select(F.md5("line").alias("line_md5")), [], "line_md5", sampled=1000)


@query("""
SELECT user_id, max(n) AS most, arg_max(event_type, n * 100 - ascii(event_type)) AS largest, round(max(n) * 1.0 / sum(n), 4) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def largest_share(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return g.groupBy("user_id").agg(F.max("n").alias("most"), F.max_by("event_type", F.col("n") * 100 - F.ascii("event_type")).alias("largest"), F.round(F.max("n") / F.sum("n"), 4).alias("share"))
