"""Classifiers and the parameter guard on literal rows."""

import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomline.functions import decisions as D
from loomline.functions import parse
from loomline.functions import values as V
from loomline.operators import joins, outline
from loomline.sources import documents


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, operator, value",
    [
        ("项目负责人经验最多3年", "<=", 3.0), ("从业经验不小于5年", ">=", 5.0), ("从业满3年", ">=", 3.0), ("经验不高于10年", "<=", 10.0), ("经验等于2年", "==", 2.0), ("经验不多于四年", "<=", 4.0),
        ("五年及以上施工管理经验", ">=", 5.0), ("年限１０年以下", "<=", 10.0), ("年限 8 年", "==", 8.0),
    ],
)
def test_comparisons(text, operator, value):
    assert [(c["category"], c["operator"], c["value"], c["unit"]) for c in parse.parameter_claims_of(text)] == [("experience_years", operator, value, "year")]


def test_categories_need_their_words():
    assert parse.parameter_claims_of("保修5年，塔楼3台") == [] == parse.parameter_claims_of(None) == parse.parameter_claims_of("")
    got = parse.parameter_claims_of("总工期不超过90日历天，投入塔吊3台以上，管理人员不少于十二人，类似业绩至少2项，具有施工总承包一级资质")
    assert [(c["category"], c["operator"], c["value"]) for c in got] == [
        ("duration_days", "<=", 90.0), ("similar_performance_count", ">=", 2.0), ("personnel_count", ">=", 12.0), ("equipment_count", ">=", 3.0), ("qualification_grade", ">=", 1.0),
    ]
    assert len(parse.parameter_claims_of("工期30天")) == 1 and len(parse.parameter_claims_of("设备" + "x" * 40 + "3台")) == 0


def test_claims_column(spark):
    rows = spark.createDataFrame([("经验满3年",), (None,), ("",), ("经验满3年",)], "t string").select(parse.parameter_claims("t").alias("c")).collect()
    assert [len(r.c) for r in rows] == [1, 0, 0, 1] and rows[0].c[0].operator == ">=" and rows[0].c[0].text == "经验满3年"


@pytest.mark.parametrize(
    "message, intent, confidence",
    [("", "fallback", 0.0), (None, "fallback", 0.0), ("你好", "daily_chat", 1.0), ("下一步 做什么", "next_action", 0.95), ("这是什么项目", "project_overview", 0.92), ("模板能不能直接套用", "template_boundary", 0.9),
     ("用哪个模板", "template", 0.86), ("Token 用了多少", "generation_summary", 0.93), ("有什么风险", "risk", 0.82), ("zzz", "fallback", 0.0), ("工期多久", "fallback", 0.0)],
)
def test_assistant(spark, message, intent, confidence):
    assert tuple(one(spark, D.assistant_intent(F.lit(message).cast("string")))) == (intent, confidence)


def test_platform(spark):
    of = lambda m, v: tuple(one(spark, D.platform_intent(F.lit(m), F.lit(v).cast("string"))))
    assert of("推荐供应商", "qa") == ("supplier_recommendation", 0.86) and of("zz", " rag ") == ("knowledge_base", 0.65) and of("zz", None) == ("fallback", 0.0) and of(" ", "qa") == ("fallback", 0.0)


def test_score_points(spark):
    of = lambda t, r, k: tuple(one(spark, D.score_point_class(F.lit(t), F.lit(r), F.lit(k))))
    assert of("内容完整性", "总承包", "epc") == ("general", "技术标完整性说明", 0.9, False)
    assert of("建筑设计", "", "x") == ("design", "设计方案", 0.86, True)
    assert of("项目理解", "", "x") == ("management", "项目理解", 0.78, False)
    assert of("工期", "总承包", "epc") == ("management", "工期管理", 0.78, False)
    assert of("工期", "总承包", "x") == ("management", "工期管理", 0.72, True)
    assert of("其它", "其它", "x") == ("construction", "unknown", 0.68, True)


def test_reuse(spark):
    of = lambda c, q, raw=None, risk=None, keep=False: tuple(one(spark, D.reuse_control(F.lit(c), F.lit(q), F.lit("docx"), F.lit(raw).cast("string"), F.lit(risk).cast("string"), F.lit(keep))))
    assert of("工程概况", "usable") == ("manual_review", "high")
    assert of("成品保护现状照片", "usable") == ("rewrite_reuse", "medium")
    assert of("钢筋绑扎", "usable") == ("parameterized_reuse", "medium")
    assert of("质量保证体系", "usable") == ("direct_reuse", "low")
    assert of("质量保证体系", "review_required") == ("rewrite_reuse", "medium")
    assert of("质量保证体系", "usable", risk="high") == ("rewrite_reuse", "high")
    assert of("一般", "pdf_fallback") == ("manual_review", "high")
    assert of("工程概况", "usable", "direct") == ("direct_reuse", "high") and of("工程概况", "usable", "light_rewrite", keep=True) == ("rewrite_reuse", "high")
    assert one(spark, D.reuse_level(F.lit("odd"))) is None and one(spark, D.reuse_level(F.lit(" review_required "))) == "manual_review"


def test_captions(spark):
    weak = lambda c: one(spark, D.weak_caption(F.lit(c).cast("string")))
    assert [weak(c) for c in (None, "", "示意图", "照 片", "第一步", "第1步、第二步", "步骤三：", "基坑示意图", "第一步 安装")] == [False, False, True, True, True, True, True, False, False]


def test_topics_and_domains(spark):
    assert one(spark, D.topics(F.lit("钢筋绑扎 BIM 模型"))) == ["bim_info", "rebar"] and one(spark, D.topics(F.lit(None).cast("string"))) == []
    assert one(spark, D.domain(F.lit("智慧工地 b i m"))) == "BIM与信息化" and one(spark, D.domain(F.lit(""))) == "其他"


def test_states(spark):
    rows = spark.createDataFrame([("j1", "blocking", 0), ("j2", None, 3), ("j3", None, 0), ("j4", "info", 0)], "j string, level string, items int")
    assert {r.j: r.s for r in rows.groupBy("j").agg(D.parse_status(F.col("level"), F.col("items")).alias("s")).collect()} == {"j1": "failed", "j2": "completed_with_warnings", "j3": "completed", "j4": "completed_with_warnings"}
    flags = one(spark, D.source_flags(F.lit(False), F.lit("failed"), F.lit(None).cast("int"), F.lit(2), F.lit("review_rule")))
    assert flags == ["待脱敏确认", "入库失败", "缺少章节切片", "2 条提示", "适合风险提示"]
    assert one(spark, D.state_flags(F.lit("parse_needs_review"), F.lit(0), F.array_repeat(F.lit("x"), 9)))[-1] == "review_item_5"


def test_average_hash(spark):
    pixels = list(range(64))
    want = f"{int(''.join('1' if p >= sum(pixels) / 64 else '0' for p in pixels), 2):016x}"
    assert one(spark, V.average_hash(F.array(*map(F.lit, pixels)))) == want
    assert one(spark, V.average_hash(F.array_repeat(F.lit(7), 64))) == "f" * 16 and one(spark, V.average_hash(F.array_repeat(F.lit(7), 5))) == ""
    digest = hashlib.sha256(b"abc").hexdigest()
    assert tuple(one(spark, V.image_ids(F.lit(bytearray(b"abc"))))) == (digest, f"sha256:{digest}")


def test_media(spark, tmp_path):
    for name, parts in (("a.docx", {"word/media/image1.png": b"one", "word/document.xml": b"<x/>", "word/media/image2.png": b""}), ("b.docx", {"x": b"y"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, data in parts.items():
                z.writestr(n, data)
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    got = sorted((r.path.rpartition("/")[2], r.part_name, bytes(r.content)) for r in documents.docx_media(spark, str(tmp_path)).collect())
    assert got == [("a.docx", "word/media/image1.png", b"one"), ("a.docx", "word/media/image2.png", b"")]


def test_perceptual_matches(spark):
    r = random.Random(2)
    base = [r.getrandbits(63) for _ in range(6)]
    known = [(i, r.choice("pq"), b ^ sum(1 << x for x in r.sample(range(63), r.randrange(6)))) for i, b in enumerate(base * 12)] + [(900, None, base[0]), (901, "p", None)]
    new = [(i, r.choice("pqr"), b) for i, b in enumerate(base)] + [(50, None, base[0]), (51, "p", None)]
    df = lambda rows: spark.createDataFrame(rows, "id int, sha256 string, bits long")
    got = sorted((x.id, x.match, x.distance) for x in joins.perceptual_matches(df(new), df(known), 4, 5).collect())
    want = []
    for i, sha, bits in new:
        if bits is not None:
            near = sorted(((bits ^ b).bit_count(), k) for k, s, b in known if b is not None and (bits ^ b).bit_count() <= 4 and not (bits == b and s == sha))
            want += [(i, k, n) for n, k in near[:5]]
    assert got == sorted(want)


def test_outline(spark):
    points = [(1, "质量管理", "质量 安全", None), (2, "项目理解", "总承包", ["x"]), (3, "消防", "", ["甲", "乙"]), (4, "其它", None, None)]
    rows = outline.outline_tree(spark.createDataFrame(points, "pos int, title string, rule string, template array<string>"), F.lit("construction")).collect()
    got = {r.number: (r.level, r.title, r.source, r.review) for r in rows}
    assert got["1"] == (1, "质量管理", "generated_from_requirement", True) and got["1.1"] == (2, "质量保证措施", "generated_from_requirement", True) and got["1.2"][1] == "安全保证措施"
    assert got["2.1"] == (2, "项目概况理解", "generated", True) and got["3.2"] == (2, "乙", "excellent_bid_template", False) and got["3"][3] is False
    assert [got[f"4.{i}"][1] for i in (1, 2, 3, 4)] == outline.UNKNOWN_CHILDREN
    packages = [("a", "p", "t1", "level3_subsection_unit", ["h"]), ("a", None, "t2", "level2_section_group", ["h", " "]), ("", None, "", "x", ["h"])]
    assert outline.heading_count(spark.createDataFrame(packages, "top string, parent string, target string, unit_type string, headings array<string>")).first()[0] == 1 + 2 + 1 + 1
