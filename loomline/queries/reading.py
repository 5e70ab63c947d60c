"""Scans, pages, optional filters, blocks of documents."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query
from ..sources import documents as D
from ..sources import tables as S
from ..sources.tables import table


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged_orders(spark, d):
    return S.page(table(spark, d, "orders"), F.desc("o_orderdate"), F.col("o_orderkey"), limit=20, offset=40).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def optional_filters(spark, d):
    return S.filtered(table(spark, d, "orders"), o_orderstatus="F", o_orderpriority="5-LOW", o_custkey=None).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042')")
def account_lookup(spark, d):
    return S.point_lookup(table(spark, d, "customer"), "c_name", "CUSTOMER#000000042", ignore_case=True).select("c_custkey", "c_name")


@query("""
WITH s AS (SELECT * FROM supplier WHERE s_suppkey IN (1, 3, 5) OR contains(s_name, '000007') OR contains(s_name, '0002'))
SELECT s_suppkey, count(l_orderkey) AS items, count(DISTINCT l_partkey) AS parts FROM s LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def whitelist_filter(spark, d):
    s = table(spark, d, "supplier").where(F.col("s_suppkey").isin(1, 3, 5) | X.contains_any(F.col("s_name"), ["000007", "0002"])).select("s_suppkey")
    j = s.join(table(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.groupBy("s_suppkey").agg(F.count("l_orderkey").alias("items"), F.count_distinct("l_partkey").alias("parts"))


@query(r"""
WITH h AS (SELECT doc_id, source, contains(lower(regexp_replace(text, '\s+', '', 'g')), 'mitlicense') OR contains(lower(regexp_replace(text, '\s+', '', 'g')), 'apachelicense') AS hit FROM documents)
SELECT doc_id, source FROM (SELECT *, bool_or(hit) OVER (PARTITION BY source) AS any_hit FROM h) WHERE hit OR NOT any_hit""")
def keyword_filter_fallback(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", X.contains_any(F.col("text"), ["MIT License", "Apache License"]).alias("hit"))
    known = rows.groupBy("source").agg(F.bool_or("hit").alias("any_hit"))
    return rows.join(known, "source").where("hit or not any_hit").select("doc_id", "source")


@query(r"""
SELECT doc_id, i - 1 AS row_index, md5(line) AS line_md5 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE contains(line, ' | ')""")
def matching_rows(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_index", "line"))
    return lines.where(F.contains("line", F.lit(" | "))).select("doc_id", F.col("row_index").cast("long").alias("row_index"), F.md5("line").alias("line_md5"))


@query(r"""
WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS r FROM documents WHERE contains(text, ' | ')),
c AS (SELECT doc_id, r, unnest(string_split(line, '|')) AS cell, unnest(range(0, len(string_split(line, '|')))) AS c FROM r)
SELECT doc_id, count(*) AS cells, sha256(string_agg('B' || doc_id || '_R' || r || '_C' || c || trim(cell), ',' ORDER BY r, c)) AS digest FROM c WHERE trim(cell) <> '' GROUP BY doc_id""")
def cell_references(spark, d):
    docs = table(spark, d, "documents").where(F.contains("text", F.lit(" | ")))
    cells = D.cell_refs(docs.select("doc_id", F.col("doc_id").alias("block"), "text"), "doc_id", "block", "text")
    at = lambda k: F.regexp_extract("cell_ref", rf"_{k}(\d+)", 1).cast("int")
    parts = F.sort_array(F.collect_list(F.struct(at("R").alias("r"), at("C").alias("c"), F.concat("cell_ref", "text").alias("x"))))
    return cells.groupBy("doc_id").agg(F.count("*").alias("cells"), F.sha2(F.array_join(F.transform(parts, lambda p: p["x"]), ","), 256).alias("digest"))


@query(r"""
WITH b AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '(?is)<((?:h[1-6]|p|li|td|pre)\b[^>]*>.*?</(?:h[1-6]|p|li|td|pre))>', 1))) AS raw FROM pages)
SELECT page_id, regexp_extract(raw, '^(\w+)', 1) AS block_type, count(*) AS n FROM b GROUP BY 1, 2""")
def html_block_counts(spark, d):
    return D.html_blocks(table(spark, d, "pages")).groupBy("page_id", "block_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, length(left(text, 900))::BIGINT AS clipped, md5(left(text, 900)) AS digest FROM documents")
def clipped_projection(spark, d):
    head = F.left("text", F.lit(900))
    return table(spark, d, "documents").select("doc_id", "lang", F.length(head).cast("long").alias("clipped"), F.md5(head).alias("digest"))


@query("""
SELECT part.p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size::BIGINT WHEN p_partkey % 4 <> 0 THEN p_partkey ELSE 0 END AS table_count FROM part""")
def alias_coalesce(spark, d):
    from ..functions.values import first_set

    size = F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size")).cast("long")
    key = F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", first_set(size, key).alias("table_count"))


@query("SELECT c_nationkey, count(*) AS kept FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY c_nationkey")
def cascade_delete(spark, d):
    from ..operators.dedup import cascade_delete as delete

    gone = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return delete(gone, "c_custkey", {"customer": table(spark, d, "customer")})["customer"].groupBy("c_nationkey").agg(F.count("*").alias("kept"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem)
SELECT n.l_orderkey, n.n AS place, p.l_partkey AS left_part, s.l_partkey AS right_part FROM x n LEFT JOIN x p ON p.l_orderkey = n.l_orderkey AND p.n = n.n - 1 LEFT JOIN x s ON s.l_orderkey = n.l_orderkey AND s.n = n.n + 1""")
def cell_neighbours(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "lineitem").withColumns({"place": F.row_number().over(w), "left_part": F.lag("l_partkey").over(w), "right_part": F.lead("l_partkey").over(w)})
    return rows.select("l_orderkey", F.col("place").cast("long").alias("place"), "left_part", "right_part")


