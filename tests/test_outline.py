from pyspark.sql import functions as F

from loomline.functions import parse
from loomline.functions import text as X
from loomline.operators import outline
from loomline.plans.nodes import materials_by_node


def test_generation_units(spark):
    rows = [("a", None, "a", 1, 0, "core"), ("b", None, "b", 1, 1, "other"), ("c", None, "c", 1, 2, "core")]
    rows += [("a1", "a", "a", 2, 0, "x"), ("a2", "a", "a", 2, 1, "large"), ("b1", "b", "b", 2, 0, "x")]
    rows += [(f"a2{i}", "a2", "a", 3, i, "first" if i == 3 else "x") for i in range(4)] + [("a11", "a1", "a", 3, 0, "x")]
    df = spark.createDataFrame(rows, "node string, parent string, root string, level int, pos int, tag string")
    is_ = lambda t: F.col("tag") == t
    got = sorted((r.unit_id, r.kind[:6]) for r in outline.generation_units(df, is_("core"), is_("large"), 3, 2, is_("first")).collect())
    assert got == [("a1", "level2"), ("a20", "level3"), ("a23", "level3"), ("b", "level1"), ("c", "level1")]


def test_heading_levels(spark):
    rows = [(0, 1, "1", True), (1, 1, "1", False), (2, 1, "2", False), (3, 2, "1.1", False), (4, 1, "3", False), (5, 1, None, True)]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, pos int, level int, number string, styled boolean")
    assert [r.resolved for r in outline.heading_levels(df, ["doc"], "pos").orderBy("pos").collect()] == [1, 2, 2, 2, 3, 1]


def test_repaired_refs(spark):
    cells = [("B1_R0_C0", 1, 0, 0, "Plan", False), ("B1_R0_C1", 1, 0, 1, "5 points", False), ("B2_R1_C0", 2, 1, 0, "Safety", True), ("B3_R1_C0", 3, 1, 0, "Safety", False)]
    points = [(1, "B1_R0_C0", "plan"), (2, "B1_R0_C0", "5 Points"), (3, "B1_R0_C0", "Safety"), (4, "B1_R0_C0", "nowhere"), (5, "X", "Plan"), (6, "B1_R0_C0", None)]
    got = {r.point_id: (r.ref, r.repaired, r.reason) for r in outline.repaired_refs(spark.createDataFrame(points, "point_id int, ref string, observed string"), spark.createDataFrame(cells, "ref string, table_no int, row_no int, cell_no int, text string, in_range boolean")).collect()}
    assert got == {1: ("B1_R0_C0", False, None), 2: ("B1_R0_C1", True, "same row"), 3: ("B2_R1_C0", True, "hinted range"), 4: ("B1_R0_C0", False, None), 5: ("X", False, None), 6: ("B1_R0_C0", False, None)}


def test_headings_captions_grades(spark):
    rows = [("1.2 Site plan", None), ("Overview", "Heading2"), ("1 Intro ..... 3", None), ("x", "TOC1"), ("Just text.", None), ("", "Heading1")]
    got = [tuple(r[0]) if r[0] else None for r in spark.createDataFrame(rows, "t string, s string").select(X.heading(F.col("t"), F.col("s"))).collect()]
    assert got == [(2, "1.2", "1.2 Site plan"), (2, None, "Overview"), None, None, None, None]
    texts = ["、 Crane  plan，", "a > b", "a | b | c", "123", "x" * 65]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.caption(F.col("t"))).collect()] == ["Crane plan", "", "", "", ""]
    assert [(g["value"], g["operator"]) for g in parse.grades_of("投标人须具备一级资质")][0][0] == 1.0


def test_materials_by_node(spark):
    slices = spark.createDataFrame([(1, "fire plan", ":a > :fire", 0, 0, "usable"), (2, "garden", ":a", 0, 0, "high"), (3, "zzz", ":q", 5, 5, "high")], "id int, search_text string, section_key string, table_count int, image_count int, quality string")
    nodes = spark.createDataFrame([("n1", "fire", ":a"), ("n2", "fire", None), ("n3", "nothing", "")], "node_id string, query string, path_key string")
    got = [(r.node_id, r.id) for r in materials_by_node(nodes, slices, 5).orderBy("node_id", "rank").collect()]
    assert got == [("n1", 2), ("n1", 1), ("n2", 1)]
