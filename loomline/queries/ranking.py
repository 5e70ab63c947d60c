"""Retrieval."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import search
from ..registry import query
from ..sources.tables import table


@query("""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
t AS (SELECT doc_id, len(w) AS l, unnest(w) AS token FROM d), tf AS (SELECT doc_id, l, token, count(*) AS f FROM t GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS token FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * greatest(l, 1) / a))), 4) AS score FROM tf JOIN df USING (token) JOIN q USING (token), n GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def bm25_topk(spark, d):
    out = search.bm25_search(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", F.col("text"), F.col("text"), 5)
    return out.select("item_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@query("""
SELECT doc_id, score, total FROM (SELECT doc_id, score, count(*) OVER () AS total FROM (
 SELECT doc_id, ((length(t) - length(replace(t, 'license', ''))) // 7 + (length(t) - length(replace(t, 'the', ''))) // 3)::BIGINT AS score FROM (SELECT doc_id, lower(text) AS t FROM documents)) WHERE score > 0) ORDER BY score DESC, doc_id LIMIT 30""")
def keyword_search(spark, d):
    hits = table(spark, d, "documents").select("doc_id", X.keyword_count(F.col("text"), ["license", "the"]).cast("long").alias("score")).where("score > 0")
    total = hits.agg(F.count("*").alias("total"))  # one row
    return hits.orderBy(F.desc("score"), "doc_id").limit(30).join(F.broadcast(total)).select("doc_id", "score", "total")


@query("""
WITH s AS (SELECT p_partkey AS id, p_name || ' ' || p_type AS x, ':' || replace(lower(p_type), ' ', '') || ' > :' || replace(lower(p_brand), '#', '#') AS k, p_size AS t, p_size % 4 AS i,
 CASE WHEN p_size > 40 THEN 'high' WHEN p_size < 5 THEN 'review_required' ELSE 'usable' END AS quality FROM part),
w AS (SELECT *, len(list_intersect(['large', 'widget', 'economy', 'largewidgeteconomy'], list_distinct(list_concat(list_transform(regexp_extract_all(x, '[A-Za-z0-9]{2,}'), lambda y: lower(y)), [replace(lower(x), ' ', '')])))) / 4.0 AS overlap,
 CASE WHEN ends_with(k, ':economy') OR starts_with(k, ':economy > ') OR ends_with(':economy', k) THEN 1.6 ELSE 0 END AS path FROM s)
SELECT id, round(path + overlap + least(t, 5) * 0.03 + least(i, 5) * 0.02 + CASE quality WHEN 'high' THEN 0.25 WHEN 'review_required' THEN -0.2 ELSE 0 END, 4) AS score FROM w WHERE path + overlap > 0
ORDER BY score DESC, id LIMIT 25""")
def material_search(spark, d):
    quality = F.when(F.col("p_size") > 40, "high").when(F.col("p_size") < 5, "review_required").otherwise("usable")
    slices = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("search_text"), X.section_key(F.array("p_type", "p_brand")).alias("section_key"),
        F.col("p_size").alias("table_count"), (F.col("p_size") % 4).alias("image_count"), quality.alias("quality"),
    )
    return search.material_search(slices, "large widget economy", ":economy", [], 25).select("id", "score")


@query("""
WITH s AS (SELECT p_partkey AS id, list_distinct(list_concat(list_transform(regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z0-9]{2,}'), lambda y: lower(y)), [replace(lower(p_name || ' ' || p_type), ' ', '')])) AS w, ':' || lower(p_type) AS own, p_size AS t, p_size % 4 AS i FROM part),
n AS (SELECT n_nationkey, p_name || ' widget' AS q, CASE WHEN n_nationkey % 2 = 0 THEN ':' || lower(p_type) ELSE '' END AS k FROM nation JOIN part ON p_partkey = n_nationkey),
m AS (SELECT n_nationkey, k, list_distinct(list_concat(list_transform(regexp_extract_all(q, '[A-Za-z0-9]{2,}'), lambda y: lower(y)), [replace(lower(q), ' ', '')])) AS w FROM n),
x AS (SELECT n_nationkey AS node_id, id, round(CASE WHEN k = own THEN 3.0 ELSE 0 END + len(list_intersect(m.w, s.w)) / len(m.w)::DOUBLE + least(t, 5) * 0.03 + least(i, 5) * 0.02, 4) AS score FROM m, s WHERE k = own OR len(list_intersect(m.w, s.w)) > 0)
SELECT node_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 5""")
def node_materials(spark, d):
    from ..plans.nodes import materials_by_node

    part = table(spark, d, "part")
    slices = part.select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("search_text"), X.section_key(F.array("p_type")).alias("section_key"), F.col("p_size").alias("table_count"), (F.col("p_size") % 4).alias("image_count"), F.lit("usable").alias("quality"),
    )
    nodes = table(spark, d, "nation").join(part, F.col("p_partkey") == F.col("n_nationkey"))
    key = F.when(F.col("n_nationkey") % 2 == 0, X.section_key(F.array("p_type"))).otherwise("")
    out = materials_by_node(nodes.select(F.col("n_nationkey").alias("node_id"), F.concat("p_name", F.lit(" widget")).alias("query"), key.alias("path_key")), slices, 5)
    return out.select("node_id", F.col("rank").cast("long").alias("rank"), "id", "score")
