"""Trees and incremental work."""

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..operators import trees
from ..registry import query
from ..sources.tables import table


def _nodes(spark, d):
    top = table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    mid = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")), F.concat(F.lit("R"), F.col("n_regionkey")), F.col("n_name"))
    low = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")), F.concat(F.lit("N"), F.col("s_nationkey")), F.col("s_name"))
    return top.union(mid).union(low)


@query("""
SELECT 'R' || r_regionkey AS node, 1 AS depth, r_name AS path FROM region UNION ALL SELECT 'N' || n_nationkey, 2, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'S' || s_suppkey, 3, r_name || ' > ' || n_name || ' > ' || s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def flattened_tree(spark, d):
    return trees.flatten(_nodes(spark, d), "node", "parent", "title", 3).withColumn("path", F.array_join("path", " > "))


@query("""
SELECT 'R' || r_regionkey AS ancestor, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) + (SELECT count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS below FROM region
UNION ALL SELECT 'N' || n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) FROM nation UNION ALL SELECT 'S' || s_suppkey, 0 FROM supplier""")
def descendant_counts(spark, d):
    pairs = trees.closure(_nodes(spark, d), "node", "parent", 2)
    return pairs.groupBy("ancestor").agg(F.count(F.when(F.col("distance") > 0, 1)).alias("below"))


@query("""
WITH c AS (SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT r_name AS path, sum(n)::BIGINT AS customers, round(sum(b), 1) AS balance FROM c GROUP BY 1 UNION ALL SELECT r_name || ' > ' || n_name, n, round(b, 1) FROM c""")
def subtree_sums(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("b")).select(F.array("r_name", "n_name").alias("path"), "n", "b")
    out = trees.subtree_sums(leaves, "path", "n", "b")
    return out.select(F.array_join("path", " > ").alias("path"), F.col("subtree_n").alias("customers"), F.round("subtree_b", 1).alias("balance"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'generate' WHEN o_orderkey % 11 = 3 THEN 'generate' WHEN o_orderkey % 7 = 2 THEN 'generate' WHEN o_orderkey % 13 = 4 THEN 'generate' WHEN o_orderstatus IN ('F', 'O') THEN 'skip' ELSE 'generate' END AS action,
 CASE WHEN o_orderkey % 6 = 5 THEN 'no state' WHEN o_orderkey % 11 = 3 THEN 'version' WHEN o_orderkey % 7 = 2 THEN 'input changed' WHEN o_orderkey % 13 = 4 THEN 'settings changed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'failed before' ELSE 'unfinished' END AS reason FROM orders""")
def resume_decisions(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    work = o.select("o_orderkey", F.md5("o_orderpriority").alias("package_hash"), F.lit("c1").alias("cache_key"))
    state = o.where("o_orderkey % 6 <> 5").select(
        "o_orderkey", F.when(k % 11 == 3, "v0").otherwise("v1").alias("schema_version"), F.when(k % 7 == 2, "old").otherwise(F.md5("o_orderpriority")).alias("package_hash"),
        F.when(k % 13 == 4, "c0").otherwise("c1").alias("cache_key"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running").alias("status"),
    )
    return I.resume_decision(work, state, "o_orderkey", "v1", retry_failed=False).select("o_orderkey", "action", "reason")


@query("SELECT count(*) AS misses, min(o_orderkey) AS first_miss FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def cache_misses(spark, d):
    cache = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.cache_misses(table(spark, d, "orders").select("o_orderkey"), cache, "o_orderkey").agg(F.count("*").alias("misses"), F.min("o_orderkey").alias("first_miss"))


@query("""
SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) FILTER (WHERE event_type = 'signup') AS started, arg_max(CASE WHEN event_id % 3 > 0 THEN 'm' || event_id ELSE '-' END, event_id) AS message FROM events GROUP BY 1""")
def job_progress_fold(spark, d):
    e = table(spark, d, "events")
    rows = e.select("user_id", "event_id", F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("m"), F.col("event_id"))).alias("message"), F.when(F.col("event_type") == "signup", F.col("event_id")).alias("started"))
    out = I.last_event_fold(rows, "user_id", ["event_id"], ["status", "message"], ["started"])
    return out.select("user_id", "status", "started", F.coalesce("message", F.lit("-")).alias("message"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def active_jobs(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded").alias("status"))
    return I.newest_active(o, ["o_custkey"], "status", F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("""
WITH l AS (SELECT doc_id, md5(text) AS k FROM documents WHERE doc_id % 4 > 0), n AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE doc_id % 4 = 0 AND md5(text) NOT IN (SELECT k FROM l))
SELECT (SELECT count(*) FROM l) + count(*) AS rows, (SELECT max(doc_id) FROM l) + count(*) AS last_id, (SELECT count(DISTINCT doc_id) FROM l) + count(*) AS ids FROM n""")
def promoted_library(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("k"))
    out = I.promote(docs.where("doc_id % 4 > 0"), docs.where("doc_id % 4 = 0"), "doc_id", "k", "doc_id")
    return out.agg(F.count("*").alias("rows"), F.max("doc_id").alias("last_id"), F.count_distinct("doc_id").alias("ids"))
