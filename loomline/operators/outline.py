"""Outlines: units of work, heading levels that depend on the one before, repair of cell references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions
from .joins import one_per_key

# Sections of a chapter by category, for design, for management, and those that a score rule asks for.
CHILDREN = {
    "项目理解": ["项目概况理解", "招标范围与建设目标理解", "项目特点分析", "技术标响应重点", "总体实施思路"],
    "技术标完整性说明": ["技术标响应范围", "评分点逐项响应说明", "章节完整性组织", "响应依据与编制原则", "技术标完整性承诺"],
    "施工方案": ["项目概况", "编制依据", "施工部署", "主要施工方法", "重点难点分析及对策", "绿色施工响应"],
    "质量管理": ["质量管理目标", "质量保证体系", "质量控制措施", "关键工序质量控制", "质量通病防治措施"],
    "安全管理": ["安全管理目标", "安全管理体系", "安全生产责任制", "危险源辨识与控制", "安全防护措施", "应急管理措施"],
    "文明环保": ["文明施工目标", "文明施工管理体系", "现场扬尘治理措施", "环境保护措施", "噪声与污水控制措施"],
    "工期管理": ["工期目标", "施工进度计划管理", "进度保证体系", "关键线路保障措施", "工期纠偏措施"],
    "施工进度": ["施工进度计划说明", "施工进度表编制", "关键线路分析", "阶段节点控制"],
    "施工总平面": ["施工总平面布置原则", "临时设施布置", "施工道路与材料堆场布置", "临水临电布置", "施工总平面图"],
    "资源投入": ["劳动力投入计划", "主要机械设备投入计划", "材料供应计划", "资源保障措施"],
    "技术创新": ["技术创新应用目标", "新技术应用措施", "新工艺应用措施", "新材料新设备应用措施", "BIM 应用措施"],
    "信息化与BIM": ["BIM 应用目标", "信息化监控措施", "施工数据采集与处理", "信息化协同管理"],
    "风险管理": ["风险识别", "风险评估", "风险控制措施", "应急预案", "风险动态管理"],
}
UNKNOWN_CHILDREN = ["评分标准响应", "实施思路", "主要措施", "复核后完善章节"]
DESIGN_CHILDREN = ["设计目标与原则", "设计依据与标准", "建筑方案设计响应", "结构与机电设计响应", "绿色建筑与节能设计措施", "设计进度与质量保证", "设计施工协同措施"]
MANAGEMENT_CHILDREN = ["管理目标与组织架构", "总承包协调管理", "设计与施工协同机制", "信息沟通与会议管理", "计划、质量、安全综合管控"]
OWN_CHILDREN = ["技术标完整性说明", "项目理解", "资源投入", "施工总平面", "施工进度", "技术创新", "信息化与BIM", "风险管理"]
RULE_CHILDREN = {
    "工程特点": "工程特点分析", "施工重点": "施工重点分析", "施工难点": "施工难点分析及对策", "绿色施工": "绿色施工措施", "施工工艺": "施工工艺选择", "施工机械": "施工机械配置", "完整": "评分标准完整性响应", "针对性": "针对性响应措施",
    "先进": "先进适用技术措施", "合理": "合理化建议", "质量": "质量保证措施", "安全": "安全保证措施", "进度": "进度控制措施", "设计": "设计方案响应", "BIM": "BIM 应用措施", "信息化": "信息化应用措施",
}
DESIGN_LIMIT, RULE_LIMIT = 7, 6


def _texts(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def outline_children(domain: Column, category: Column, rule: Column, template: Column) -> Column:
    """(titles, source, review) of the sections of a chapter: fixed ones of some categories, else what the score rule asks for in design and management,
    then the children of the template (an array, or null), then the rule again, then those of the category."""
    asked = F.array_compact(F.array(*(F.when(F.contains(F.coalesce(rule, F.lit("")), F.lit(k)), F.lit(v)) for k, v in RULE_CHILDREN.items())))
    fixed = F
    for name, titles in CHILDREN.items():
        fixed = fixed.when(category == name, _texts(titles))
    fixed = fixed.otherwise(_texts(UNKNOWN_CHILDREN))
    out = lambda titles, source, review: F.struct(titles.alias("titles"), F.lit(source).alias("source"), F.lit(review).alias("review"))
    some = lambda limit, otherwise: F.when(F.size(asked) > 0, F.slice(asked, 1, limit)).otherwise(_texts(otherwise))
    return (
        F.when(category.isin(*OWN_CHILDREN), out(fixed, "generated", True))
        .when(domain == "design", out(some(DESIGN_LIMIT, DESIGN_CHILDREN), "generated_from_requirement", True))
        .when(domain == "management", out(some(RULE_LIMIT, MANAGEMENT_CHILDREN), "generated_from_requirement", True))
        .when(F.size(F.coalesce(template, F.array().cast("array<string>"))) > 0, out(template, "excellent_bid_template", False))
        .when(F.size(asked) > 0, out(F.slice(asked, 1, RULE_LIMIT), "generated_from_requirement", True))
        .otherwise(out(fixed, "generated", True))
    )


def outline_tree(points: DataFrame, project_type: Column) -> DataFrame:
    """number, level, title, domain, category, source, review of an outline from score points (pos, title, rule, template): a chapter for each, its sections below.

    ``template`` holds the sections of a matching template, if there is one.  A chapter is numbered by ``pos``, a section within its chapter.
    """
    rows = points.select("pos", "title", "rule", "template", decisions.score_point_class(F.col("title"), F.col("rule"), project_type).alias("c"))
    rows = rows.withColumn("below", outline_children(F.col("c.domain"), F.col("c.category"), F.col("rule"), F.col("template")))
    number = F.col("pos").cast("string")
    top = rows.select(number.alias("number"), F.lit(1).alias("level"), "title", "c.domain", "c.category", "below.source", (F.col("c.needs_review") | F.col("below.review")).alias("review"))
    low = rows.select("pos", "c", "below", F.posexplode("below.titles").alias("n", "t"))
    low = low.select(F.concat(number, F.lit("."), F.col("n") + 1).alias("number"), F.lit(2).alias("level"), F.col("t").alias("title"), "c.domain", "c.category", "below.source", F.col("below.review").alias("review"))
    return top.unionByName(low)


def heading_count(packages: DataFrame) -> DataFrame:
    """expected: headings that a set of packages (top, parent, target, unit_type, headings) stands for, one row.

    Different chapters, sections and subsections, and the headings below units that are no subsections.
    """
    set_ = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    sub = F.col("unit_type") == "level3_subsection_unit"
    rows = packages.withColumn("sub", F.coalesce(sub, F.lit(False)))
    below = F.when(~F.col("sub") & (F.coalesce(F.col("target"), F.lit("")) != ""), F.size(F.filter(F.coalesce("headings", F.array().cast("array<string>")), lambda h: F.trim(h) != ""))).otherwise(0)
    parts = [F.count_distinct(set_(F.col("top"))), F.count_distinct(F.when(F.col("sub"), set_(F.col("parent"))).otherwise(set_(F.col("target")))), F.count_distinct(F.when(F.col("sub"), set_(F.col("target")))), F.coalesce(F.sum(below), F.lit(0))]
    return rows.agg(sum(parts[1:], parts[0]).alias("expected"))


def generation_units(nodes: DataFrame, core: Column, large: Column, least_children: int, most_units: int, preferred: Column) -> DataFrame:
    """unit_id, root, kind of the units in which an outline (node, parent, root, level 1 to 3, pos) is worked on.

    A top node that is not ``core`` or has no children is one unit; else each child is one, but a child that is ``large`` and has at least
    ``least_children`` children gives these instead, ``preferred`` ones first and ``most_units`` at most.  The conditions are columns of the node.
    """
    kids = nodes.groupBy(F.col("parent").alias("up")).agg(F.count("*").alias("kids"))
    n = nodes.join(kids, nodes["node"] == kids["up"], "left").withColumns({"kids": F.coalesce("kids", F.lit(0)), "core": F.coalesce(core, F.lit(False)), "large": F.coalesce(large, F.lit(False)), "first": F.coalesce(preferred, F.lit(False))})
    top = n.where("level = 1").select(F.col("node").alias("root"), (F.col("core") & (F.col("kids") > 0)).alias("split"))
    whole = top.where("not split").select(F.col("root").alias("unit_id"), "root", F.lit("level1_chapter").alias("kind"))
    mid = n.where("level = 2").join(top.where("split"), "root").withColumn("divide", F.col("large") & (F.col("kids") >= least_children))
    middle = mid.where("not divide").select(F.col("node").alias("unit_id"), "root", F.lit("level2_section_group").alias("kind"))
    low = n.where("level = 3").join(mid.where("divide").select(F.col("node").alias("parent")), "parent")
    size = F.count("*").over(Window.partitionBy("parent"))
    order = F.when(size > most_units, F.col("first").cast("int")).otherwise(0)
    low = low.withColumn("__o", order)
    low = low.withColumn("__n", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("__o"), "pos"))).where(F.col("__n") <= most_units)
    return whole.unionByName(middle).unionByName(low.select(F.col("node").alias("unit_id"), "root", F.lit("level3_subsection_unit").alias("kind")))


def heading_levels(headings: DataFrame, by: list[str], order: str) -> DataFrame:
    """``headings`` (level, number, styled) with the level in effect: resolved.

    A plain whole number without a heading style stands one below the heading before it, or beside it if that one was such a number too.
    Each level depends on the one before, so a document's headings are walked once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in headings.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in headings.columns) + ", resolved int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        out, last = [], None  # last: (level, plain number)
        for level, number, styled in zip(pdf["level"], pdf["number"], pdf["styled"]):
            plain = bool(number) and "." not in number and not styled
            if plain and last is not None:
                level = last[0] if last[1] else last[0] + 1
            out.append(int(level))
            last = (max(int(level), 1), plain)
        return pdf.assign(resolved=out)

    return headings.groupBy(*by).applyInPandas(run, schema)


def repaired_refs(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``points`` (point_id, ref, observed) against ``cells`` (ref, table_no, row_no, cell_no, text, in_range): ref, repaired, reason.

    A reference whose cell has the observed text stays.  Else the first cell of the same row with that text takes its place, else the first in the
    hinted range; else it stays as it is.
    """
    flat = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))
    c = cells.select(F.col("ref").alias("cref"), "table_no", "row_no", "cell_no", flat(F.col("text")).alias("ctext"), "in_range")
    p = points.withColumn("want", flat(F.col("observed")))
    now = p.join(c.select(F.col("cref").alias("ref"), F.col("table_no").alias("pt"), F.col("row_no").alias("pr"), F.col("ctext").alias("have")), "ref", "left")
    wrong = now.where((F.col("want") != "") & F.col("pt").isNotNull() & ~F.coalesce(F.contains("have", F.col("want")), F.lit(False)))
    near = c.where("ctext <> ''")
    hit = wrong.join(near, F.col("want") == F.col("ctext")).where(((F.col("table_no") == F.col("pt")) & (F.col("row_no") == F.col("pr"))) | F.col("in_range"))
    same = (F.col("table_no") == F.col("pt")) & (F.col("row_no") == F.col("pr"))
    hit = hit.withColumn("reason", F.when(same, "same row").otherwise("hinted range"))
    best = one_per_key(hit.select("point_id", "cref", "reason", "table_no", "row_no", "cell_no"), ["point_id"], F.when(F.col("reason") == "same row", 0).otherwise(1), F.col("table_no"), F.col("row_no"), F.col("cell_no"))
    out = points.join(best.select("point_id", "cref", "reason"), "point_id", "left")
    return out.select("point_id", F.coalesce("cref", "ref").alias("ref"), F.col("cref").isNotNull().alias("repaired"), "reason")
