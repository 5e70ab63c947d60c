"""Ordered rows: islands, boundaries, paths, latest, turns, schedules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieve, sequences as Q
from ..registry import query
from ..sources import documents as D
from ..sources.tables import table


@query("""
WITH x AS (SELECT *, CASE WHEN role = lag(role) OVER w AND turn = lag(turn) OVER w + 1 THEN 0 ELSE 1 END AS b FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
y AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM x)
SELECT conv_id, island::BIGINT AS island, min(role) AS role, count(*) AS turns, min(turn) AS first_turn, sum(length(text))::BIGINT AS chars FROM y GROUP BY 1, 2""")
def merged_turns(spark, d):
    c = table(spark, d, "conversations")
    by, order = ["conv_id"], ["turn"]
    new = (F.col("role") != Q.previous("role", by, order)) | (F.col("turn") != Q.previous("turn", by, order) + 1)
    rows = Q.islands(c, by, order, new)
    return rows.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("chars"))


@query("""
WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM x)
SELECT user_id, island::BIGINT AS island, count(*) AS n, round(sum(value), 2) AS total FROM y GROUP BY 1, 2 HAVING count(*) >= 2""")
def event_sessions(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    by, order = ["user_id"], ["ts", "event_id"]
    rows = Q.islands(e, by, order, F.col("us") - Q.previous("us", by, order) > 1800000000)
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).where("n >= 2")


@query("""
SELECT conv_id, turn, coalesce((SELECT min(y.turn) FROM conversations y WHERE y.conv_id = x.conv_id AND y.turn > x.turn AND y.role = 'user') - 1, (SELECT max(y.turn) FROM conversations y WHERE y.conv_id = x.conv_id)) AS end_at
FROM conversations x WHERE role = 'user'""")
def next_boundary_slices(spark, d):
    rows = Q.next_boundary(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    return rows.where("role = 'user'").select("conv_id", "turn", "end_at")


@query(r"""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<((?:h[1-6]|p|li|td|pre)\b[^>]*>.*?</(?:h[1-6]|p|li|td|pre))>', 1)) AS raw, unnest(range(0, len(regexp_extract_all(html, '(?is)<((?:h[1-6]|p|li|td|pre)\b[^>]*>.*?</(?:h[1-6]|p|li|td|pre))>', 1)))) AS i FROM pages),
k AS (SELECT page_id, i, lower(regexp_extract(raw, '^(\w+)', 1)) AS kind FROM b)
SELECT page_id, count(*) FILTER (WHERE h > 0) AS under_heading, count(*) FILTER (WHERE h = 0) AS before_heading FROM (SELECT page_id, kind, count(*) FILTER (WHERE kind = 'h1') OVER (PARTITION BY page_id ORDER BY i) AS h FROM k) GROUP BY page_id""")
def heading_assignment(spark, d):
    blocks = D.html_blocks(table(spark, d, "pages")).withColumn("level", F.when(F.col("block_type") == "h1", 1))
    rows = Q.heading_path(blocks, ["page_id"], ["block_index"], "level", "text", 1)
    under = F.size("path") > 0
    return rows.groupBy("page_id").agg(F.count(F.when(under, 1)).alias("under_heading"), F.count(F.when(~under, 1)).alias("before_heading"))


@query("""
SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_per_type(spark, d):
    return Q.latest(table(spark, d, "events").select("event_type", "user_id", "event_id", "ts"), ["event_type", "user_id"], F.col("ts"), F.col("event_id")).select("event_type", "user_id", "event_id")


@query("""
SELECT p_brand, p_partkey, turn FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part) ORDER BY turn, p_brand LIMIT 60""")
def round_robin_pool(spark, d):
    out = Q.round_robin(table(spark, d, "part"), "p_brand", ["p_brand"], [F.desc("p_retailprice"), "p_partkey"], 60)
    return out.select("p_brand", "p_partkey", F.col("turn").cast("long").alias("turn"))


@query("SELECT p_partkey, round(p_retailprice - 3 * (row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) - 1), 2) AS adjusted FROM part")
def running_penalties(spark, d):
    return Q.running_penalty(table(spark, d, "part"), ["p_type"], "p_name", ["p_partkey"], "p_retailprice", 3.0).select("p_partkey", F.round("adjusted", 2).alias("adjusted"))


@query("""
WITH x AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, (SELECT max(turn) + 5 FROM conversations z WHERE z.conv_id = c.conv_id) AS last_page FROM conversations c),
n AS (SELECT x.*, (SELECT max(y.turn) FROM x y WHERE y.conv_id = x.conv_id AND y.turn < x.turn AND y.level < x.level) AS parent, (SELECT min(y.turn) FROM x y WHERE y.conv_id = x.conv_id AND y.turn > x.turn AND y.level <= x.level) AS nxt FROM x)
SELECT conv_id, turn, parent, CASE WHEN nxt IS NULL THEN last_page ELSE greatest(turn, nxt - 1) END AS end_page, (SELECT count(*) FROM x y WHERE y.conv_id = n.conv_id AND y.turn > n.turn AND y.turn < coalesce(nxt, 1000000)) AS descendants FROM n""")
def outline_spans(spark, d):
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    rows = table(spark, d, "conversations").select("conv_id", "turn", level.alias("level"), F.col("turn").alias("page"), (F.max("turn").over(Window.partitionBy("conv_id")) + 5).alias("last_page"))
    out = Q.outline_spans(rows, ["conv_id"], "turn", "level", "page", "last_page")
    return out.select("conv_id", "turn", "parent", "end_page", F.col("descendants").cast("long").alias("descendants"))


@query("""
SELECT o_orderkey, cost FROM (SELECT o_orderkey, (CAST(floor(o_totalprice / 100) AS BIGINT) + coalesce(n, 0) * 35 + CASE WHEN o_orderpriority = '1-URGENT' THEN 600 ELSE 0 END) AS cost
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) ORDER BY cost DESC, o_orderkey LIMIT 200""")
def heavy_first_schedule(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    cost = F.floor(F.col("o_totalprice") / 100) + F.coalesce("n", F.lit(0)) * 35 + F.when(F.col("o_orderpriority") == "1-URGENT", 600).otherwise(0)
    return table(spark, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", cost.alias("cost")).orderBy(F.desc("cost"), "o_orderkey").limit(200)


@query("""
SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, big, rank, sum(big) OVER (PARTITION BY p_brand ORDER BY rank) AS have FROM (
 SELECT p_brand, p_partkey, CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS big, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part)) WHERE rank <= 5 OR (big = 1 AND have <= 3)""")
def top_with_minimum(spark, d):
    out = retrieve.with_minimum(table(spark, d, "part"), ["p_brand"], 5, 3, F.col("p_size") > 40, F.desc("p_retailprice"), F.col("p_partkey"))
    return out.select("p_brand", "p_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_per_group(spark, d):
    out = retrieve.top_k(table(spark, d, "customer"), ["c_nationkey"], 3, F.desc("c_acctbal"), F.col("c_custkey"))
    return out.select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("""
SELECT event_id, (SELECT max(y.event_id) FROM events y WHERE y.user_id = x.user_id AND y.event_type = 'signup' AND y.event_id <= x.event_id) AS signup_id FROM events x WHERE event_type = 'purchase'""")
def nearest_before(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").withColumn("signup_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'purchase'").select("event_id", "signup_id")
