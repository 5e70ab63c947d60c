from pyspark.sql import functions as F

from loomline.functions import nested
from loomline.operators import matching, retrieve, trees

SECTION = "id string, level int, title string, number string, path array<string>, material int"
CHAPTER = "id int, sections array<struct<heading:string,blocks:array<struct<type:string,text:string>>>>"


def test_sections(spark):
    left = [
        ("P1", 1, "Plan", "1", ["1 Plan"], 0),
        ("P2", 2, "Safety", "1.1", ["1 Plan", "1.1 Safety"], 0),
        ("P3", 2, "Unknown title", "1.9", ["1 Plan", "1.9 Unknown title"], 0),
        ("P4", 2, "Nowhere", None, ["9 Other", "Nowhere"], 0),
        ("P5", 2, "Garden works", None, ["Garden works"], 0),
        ("P6", 2, "Renamed", "2.3", ["2 X", "2.3 Renamed"], 0),
    ]
    right = [
        ("S1", 2, "Safety", "1.1", ["1 Plan", "1.1 Safety"], 3),
        ("S2", 1, "Plan", "1", ["1 Plan"], 0),
        ("S3", 3, "Garden Works", "7", ["7 Garden Works"], 0),
        ("S4", 3, "Garden-works", "8", ["8 Garden-works"], 0),
        ("S5", 2, "Other name", "2.3", ["2 Y", "2.3 Other name"], 0),
    ]
    got = {r.id: (r.partner, r.method, r.score, r.candidates, r.status) for r in matching.match_sections(spark.createDataFrame(left, SECTION), spark.createDataFrame(right, SECTION), "material").collect()}
    assert got["P1"] == ("S2", "number_and_title", 1.0, 1, "matched")
    assert got["P2"] == ("S1", "number_and_title", 1.0, 1, "matched")
    assert got["P3"] == ("FALLBACK:S1..S1", "parent_subtree", 0.68, 1, "fallback")
    assert got["P4"] == (None, None, 0.0, 0, "unmatched")
    assert got["P5"] == ("S3", "title", 0.79, 2, "ambiguous")
    assert got["P6"] == ("S5", "number", 0.9, 1, "matched")


def test_best_by_text(spark):
    left = spark.createDataFrame([(1, "Safety measures"), (2, "zzz")], "left_id int, left_title string")
    right = spark.createDataFrame([(10, "Plan", "Plan", 1, 0), (11, "Safety measures", "Plan > Safety measures", 2, 1), (12, "Safety measures", "x", 2, 2)], "right_id int, title string, path_text string, depth int, pos int")
    assert [tuple(r) for r in matching.best_by_text(left, right).collect()] == [(1, 11, 1.0)]


def test_nested(spark):
    row = (1, [("A", [("paragraph", "one"), ("image", None), ("table", "t")]), ("B", []), ("C", None)])
    df = spark.createDataFrame([row], CHAPTER)
    s = F.col("sections")
    got = df.select(
        nested.count_blocks(s, "paragraph", "table").alias("n"), nested.section_text(nested.keep_blocks(s, lambda sec, b: b["type"] != "table")).alias("t"), nested.coverage(s, F.array(F.lit("a "), F.lit("X"))).alias("c"),
        nested.thin_section(s, 1).alias("thin"), F.size(nested.blocks_of(s)).alias("all"), nested.capped_texts(F.array(F.lit("abc"), F.lit("d"), F.lit("e")), 2, 2).alias("capped"),
    ).first()
    assert (got.n, got.c, got.thin, got.all, got.capped) == (2, 0.5, True, 3, ["ab", "d"])
    assert got.t.split("\n")[:2] == ["A", "one"]


def test_rerank_and_members(spark):
    df = spark.createDataFrame([("rag_evidence", "risk", ["risk"], ["a"], ["b"], "high"), ("note", "other", None, None, None, None)], "type string, intent string, intents array<string>, tags array<string>, title array<string>, risk string")
    bonus = retrieve.rerank_bonus(F.col("type"), F.col("intent"), {"risk": {"rag_evidence": 0.3}}, F.col("intents"), F.col("tags"), F.col("title"), F.array(F.lit("a"), F.lit("b")), F.col("risk"), ("risk",), ("risk",))
    assert [round(r[0], 4) for r in df.select(bonus).collect()] == [3.7, 0.0]
    rows = spark.createDataFrame([("g", i, i in (4, 5)) for i in range(6)], "g string, pos int, whole boolean")
    assert sorted(r.pos for r in retrieve.with_group_members(rows, ["g"], ["pos"], 2, F.col("whole")).collect()) == [0, 1, 4, 5]
    nodes = spark.createDataFrame([(f"n{i}", f"p{i % 2}", "r", i) for i in range(8)], "node string, parent string, root string, pos int")
    assert trees.trimmed(nodes, "node", "parent", "pos", 3, 4).count() == 4
