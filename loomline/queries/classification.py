"""Rules, decisions, levels, quality."""

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import quality, rules
from ..registry import query
from ..sources.tables import table

TOPICS = [("license", ["License", "Copyright"]), ("contact", ["@", "http"]), ("symbols", ["###", "&&&"]), ("table", [" | "])]
INTENTS = [("question", ["?"]), ("opening", ["The ", "Der ", "La "]), ("other", [""])]


def _sql_rules(rules_, column):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in rules_)


@query(f"SELECT doc_id, {_sql_rules(TOPICS, 'text')} ELSE 'none' END AS topic FROM documents")
def document_topics(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.first_match(F.col("text"), TOPICS, "none").alias("topic"))


@query(f"SELECT conv_id, turn, {_sql_rules(INTENTS, 'text')} END AS intent FROM conversations")
def turn_intents(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", rules.first_match(F.col("text"), INTENTS).alias("intent"))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(text, '{w}')" for w in words) + f" THEN '{label}' END" for label, words in TOPICS) + "], lambda x: x IS NOT NULL), ',') AS topics FROM documents")
def document_topic_sets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(rules.all_matches(F.col("text"), TOPICS), ",").alias("topics"))


@query("""
WITH h AS (SELECT doc_id, md5(text) AS h, source, n_chars FROM documents), e AS (SELECT DISTINCT h FROM h WHERE doc_id % 10 = 0), n AS (SELECT * FROM h WHERE doc_id % 10 <> 0), f AS (SELECT h, min(doc_id) AS first_id FROM n GROUP BY h)
SELECT n.doc_id, CASE WHEN e.h IS NOT NULL THEN 'duplicate_existing' WHEN n.doc_id > first_id THEN 'internal_duplicate' WHEN toxic = 1 THEN 'project_specific_manual_review' WHEN quality = 0 THEN 'manual_review'
 WHEN n_chars / 4000.0 < 0.58 THEN 'manual_review' WHEN n_chars = 0 THEN 'manual_review' ELSE 'candidate_reuse' END AS decision
FROM n LEFT JOIN e ON e.h = n.h JOIN f ON f.h = n.h LEFT JOIN labels l ON l.doc_id = n.doc_id""")
def staging_decisions(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "n_chars")
    known = h.where("doc_id % 10 = 0").select("h").distinct().withColumn("exact", F.lit(True))
    new = h.where("doc_id % 10 <> 0")
    first = new.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    j = new.join(known, "h", "left").join(first, "h").join(table(spark, d, "labels"), "doc_id", "left")
    risk = F.when(F.col("toxic") == 1, "high").otherwise("low")
    decision = rules.staging_decision(F.col("exact"), F.col("doc_id") > F.col("first_id"), risk, F.lit(False), F.col("quality") == 0, F.col("n_chars") / 4000, F.col("n_chars") > 0)
    return j.select("doc_id", decision.alias("decision"))


@query("""
WITH m AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40 THEN 'duplicate_existing' WHEN l_discount >= 0.09 THEN 'manual_review' ELSE 'candidate_reuse' END AS x FROM lineitem)
SELECT l_orderkey, CASE WHEN bool_or(x = 'duplicate_existing') THEN 'duplicate' WHEN bool_or(x = 'manual_review') THEN 'manual_review' ELSE 'candidate_reuse' END AS decision FROM m GROUP BY 1""")
def group_decisions(spark, d):
    x = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40), "duplicate_existing").when(F.col("l_discount") >= 0.09, "manual_review").otherwise("candidate_reuse")
    return table(spark, d, "lineitem").select("l_orderkey", x.alias("x")).groupBy("l_orderkey").agg(rules.group_decision(F.col("x")).alias("decision"))


@query("""
WITH g AS (SELECT n_regionkey, count(*) AS sources, count(*) FILTER (WHERE s_acctbal > 0) AS ready, count(*) FILTER (WHERE s_suppkey % 3 > 0) AS confirmed, count(*) FILTER (WHERE s_acctbal < -900) AS risky, count(*) FILTER (WHERE s_suppkey % 97 = 5) AS failed, count(*) FILTER (WHERE s_suppkey % 31 = 1) AS pending
 FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
s AS (SELECT *, least(100, 30 + 25 + CASE WHEN ready = sources THEN 20 WHEN ready > 0 THEN 10 ELSE 0 END + CASE WHEN confirmed = sources THEN 15 WHEN confirmed > 0 THEN 7 ELSE 0 END + CASE WHEN risky = 0 THEN 10 ELSE 0 END) AS score FROM g)
SELECT n_regionkey, score, CASE WHEN risky > 0 OR failed > 0 THEN 'risk' WHEN pending > 0 THEN 'review' WHEN score >= 85 THEN 'ready' ELSE 'building' END AS level FROM s""")
def library_readiness(spark, d):
    n = lambda c, a: F.count(F.when(c, 1)).alias(a)
    s = F.col("s_suppkey")
    g = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(
        F.count("*").alias("sources"), n(F.col("s_acctbal") > 0, "ready"), n(s % 3 > 0, "confirmed"), n(F.col("s_acctbal") < -900, "risky"), n(s % 97 == 5, "failed"), n(s % 31 == 1, "pending"),
    )
    g = g.withColumn("score", rules.readiness_score(F.col("sources"), F.col("ready"), F.col("sources"), F.col("confirmed"), F.col("risky")))
    return g.select("n_regionkey", "score", rules.readiness_level(F.col("score"), F.col("sources"), F.col("risky"), F.col("failed"), F.col("pending")).alias("level"))


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS paragraphs, least(1.0, count(DISTINCT l_linenumber) / 5.0) AS coverage, count(*) FILTER (WHERE l_discount > 0.08) AS high, count(*) FILTER (WHERE l_tax > 0.06) AS medium, count(*) FILTER (WHERE l_returnflag = 'R') AS tables, count(*) FILTER (WHERE l_linestatus = 'O') AS reviews FROM lineitem GROUP BY 1)
SELECT l_orderkey, greatest(0, least(100, round(100 - greatest(0.0, 1 - coverage) * 30 - greatest(0, 4 - paragraphs) * 3 - high * 12 - medium * 5 + CASE WHEN tables >= 2 THEN 3 ELSE 0 END + CASE WHEN reviews > 0 THEN 2 ELSE 0 END)))::INT AS score FROM g""")
def chapter_scores(spark, d):
    n = lambda c, a: F.count(F.when(c, 1)).alias(a)
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("paragraphs"), F.least(F.lit(1.0), F.count_distinct("l_linenumber") / 5).alias("coverage"), n(F.col("l_discount") > 0.08, "high"), n(F.col("l_tax") > 0.06, "medium"), n(F.col("l_returnflag") == "R", "tables"), n(F.col("l_linestatus") == "O", "reviews"),
    )
    return g.select("l_orderkey", rules.penalty_score(*map(F.col, ("coverage", "paragraphs", "high", "medium", "tables", "reviews"))).alias("score"))


@query("""
SELECT CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'interrupted' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'succeeded' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def historical_statuses(spark, d):
    s = F.col("o_orderstatus")
    status = F.when(s == "P", "pending").when(s == "O", "failed").otherwise("succeeded")
    ended = F.when((s != "P") | (F.col("o_orderkey") % 2 == 0), F.col("o_orderdate"))
    return table(spark, d, "orders").groupBy(rules.historical_status(status, ended).alias("status")).agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'unknown' END AS a, CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS b FROM part),
r AS (SELECT *, CASE a WHEN 'low' THEN 0 WHEN 'high' THEN 2 ELSE 1 END AS ra, CASE WHEN b = 'low' THEN 0 WHEN b = 'high' THEN 2 ELSE 1 END AS rb FROM x)
SELECT p_partkey, CASE WHEN rb > ra THEN b ELSE a END AS risk FROM r""")
def higher_risks(spark, d):
    level = lambda c: F.when(c == 0, "low").when(c == 1, "medium").when(c == 2, "high")
    a, b = F.coalesce(level(F.col("p_size") % 4), F.lit("unknown")), level(F.col("p_partkey") % 4)
    return table(spark, d, "part").select("p_partkey", V.higher_level(a, b).alias("risk"))


RULES_SQL = """
SELECT doc_id, 'blocking' AS severity, 'empty' AS type FROM documents WHERE n_chars < 40 UNION ALL SELECT doc_id, 'warning', 'symbols' FROM documents WHERE contains(text, '%%%')
UNION ALL SELECT doc_id, 'warning', 'very_long' FROM documents WHERE n_chars > 20000 UNION ALL SELECT doc_id, 'advisory', 'single_line' FROM documents WHERE NOT contains(text, chr(10))"""


def _issues(spark, d):
    return quality.issues(table(spark, d, "documents"), "doc_id", [
        ("blocking", "empty", F.col("n_chars") < 40), ("warning", "symbols", F.contains("text", F.lit("%%%"))),
        ("warning", "very_long", F.col("n_chars") > 20000), ("advisory", "single_line", ~F.contains("text", F.lit("\n"))),
    ])


@query(RULES_SQL)
def document_issues(spark, d):
    return _issues(spark, d)


@query(f"""
SELECT blocking, warning, advisory, CASE WHEN blocking > 0 THEN 'blocked' WHEN warning > 0 THEN 'warning' ELSE 'passed' END AS verdict FROM (
 SELECT count(*) FILTER (WHERE severity = 'blocking') AS blocking, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'advisory') AS advisory FROM ({RULES_SQL}))""")
def quality_gate(spark, d):
    return quality.gate(_issues(spark, d))
