"""Classifiers and decisions of the bidding domain: tables of words, and column expressions that read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rules import first_match
from . import text as X
from . import values as V

# Intents of a question to the assistant, first match wins, with the confidence of the match.
DAILY_CHAT = ["你好", "您好", "嗨", "早上好", "下午好", "晚上好", "hello", "hi", "谢谢", "辛苦了", "多谢", "再见", "拜拜", "回头见", "下次聊", "你是谁", "介绍一下你", "介绍一下自己", "你能做什么", "能力边界", "边界"]
ASSISTANT_FIRST = [
    ("daily_chat", 1.0, DAILY_CHAT),
    ("context_help", 0.92, ["这里", "这个页面", "这个模块", "当前页面", "当前步骤", "注意什么", "讲解"]),
    ("next_action", 0.95, ["下一步", "建议", "该做", "做什么"]),
]
OVERVIEW_PROJECT = ["项目", "工程", "标书", "招标"]
OVERVIEW_ASKED = ["是什么", "什么行业", "行业", "类型", "类别", "概况", "基本信息", "项目名称", "工程名称", "建设地点", "建设规模", "招标范围", "工期", "质量要求", "安全文明"]
OVERVIEW_STRICT = ["行业", "类型", "类别", "概况", "基本信息", "建设地点", "建设规模", "招标范围", "工期", "质量要求"]
OVERVIEW_PHRASES = ["这是什么项目", "这是啥项目", "这个项目是什么", "项目是什么", "这个项目是什么行业", "这个项目属于什么行业", "这是个什么行业的项目", "这个项目是什么类型", "这个项目属于什么类型"]
TEMPLATE, TEMPLATE_LIMITS = ["模板", "范本", "套用"], ["覆盖", "边界", "直接", "能不能"]
ASSISTANT_MIDDLE = [
    ("progress", 0.82, ["进度", "状态", "到哪", "当前", "阶段"]),
    ("review_report", 0.93, ["复核报告", "质检", "质量报告", "ai 复核", "ai复核", "检查报告"]),
    ("generation_summary", 0.93, ["生成小结", "本次生成", "耗时", "token", "tokens", "模型调用", "失败项"]),
    ("queue_preflight", 0.9, ["排队前", "提交前", "入队前", "开跑前", "队列前"]),
]
ASSISTANT_LAST = [
    ("template", 0.86, TEMPLATE),
    ("score_points", 0.86, ["评分", "得分", "分值", "评审", "扣分", "响应"]),
    ("outline", 0.86, ["目录", "大纲"]),
    ("word", 0.82, ["word", "成稿", "初稿", "onlyoffice", "复核"]),
    ("material_ingestion", 0.86, ["入库", "脱敏", "补充哪些", "上传参考资料", "上传资料"]),
    ("model_ops", 0.86, ["模型配置", "速度", "成本", "失败排查", "调用失败", "质量之间取舍", "max_tokens", "并发"]),
    ("materials", 0.82, ["评审办法", "法律法规", "技术规范", "企业制度", "依据", "素材", "rag", "优秀标书", "引用", "来源", "法规", "规范", "制度"]),
    ("generation", 0.82, ["正文", "生成", "重试", "章节", "偏空", "写法", "怎么写", "补充"]),
    ("risk", 0.82, ["风险", "问题", "缺口", "亮点", "合规", "法律", "条款", "暗标", "废标"]),
]
# Intents of a question to the platform, and what an open view stands for when no word does.
PLATFORM = [
    ("daily_chat", 1.0, ["你好", "您好", "hello", "hi", "你是谁", "介绍一下", "你能做什么", "能力边界"]),
    ("platform_capability", 0.92, ["平台", "系统", "能做什么", "有哪些功能", "工作台", "模块"]),
    ("bid_intelligence", 0.88, ["标讯", "公告", "招标信息", "剑鱼", "实时", "机会"]),
    ("enterprise_risk", 0.86, ["企业风险", "企查查", "风险", "失信", "诉讼", "经营异常", "资质核验"]),
    ("supplier_recommendation", 0.86, ["供应商", "供应单位", "推荐供应", "分包", "材料商"]),
    ("knowledge_base", 0.9, ["投标知识库", "知识库", "智库", "资料库", "优秀标书", "法规", "规范", "制度", "评审办法", "依据", "入库"]),
    ("template", 0.86, ["模板", "范本", "投标模板", "套用"]),
    ("bid_drafting", 0.86, ["编标", "技术标", "评分点", "目录", "正文", "word", "复核", "生成", "项目下一步"]),
]
VIEWS = {"qa": "platform_qa", "rag": "knowledge_base", "templates": "template", "bid-intel": "bid_intelligence", "risk": "enterprise_risk", "suppliers": "supplier_recommendation"}
VIEW_CONFIDENCE = 0.65
# Domains and categories of score points.
DESIGN = ["设计方案", "方案设计", "建筑设计", "结构设计", "给排水设计", "暖通设计", "电气设计", "消防设计", "绿色建筑", "限额设计", "设计优化", "设计管理", "设计进度", "设计质量", "设计服务"]
MANAGEMENT = ["总承包", "协调", "管理组织", "组织管理", "项目管理", "设计施工", "协同", "项目理解", "招标项目的理解"]
COMPLETENESS, UNDERSTANDING = "技术标完整性说明", "项目理解"
CATEGORIES = [
    (COMPLETENESS, ["内容完整性", "内容完整", "章节完整", "响应完整", "完整性响应"]),
    (UNDERSTANDING, ["项目理解", "招标项目的理解", "对招标项目的理解"]),
    ("施工总平面", ["总平面", "平面布置", "布置图"]),
    ("施工进度", ["进度", "施工进度表", "网络计划"]),
    ("工期管理", ["工期"]),
    ("技术创新", ["技术创新", "新工艺", "新技术", "新设备", "新材料"]),
    ("信息化与BIM", ["BIM", "信息化", "监控", "数据"]),
    ("质量管理", ["质量"]),
    ("安全管理", ["安全"]),
    ("文明环保", ["文明", "环境保护", "扬尘", "环保"]),
    ("绿色施工", ["绿色施工", "绿色"]),
    ("资源投入", ["资源", "劳动力", "机械", "材料", "投入"]),
    ("风险管理", ["风险", "应急"]),
    ("施工方案", ["施工方案", "技术措施", "施工组织"]),
    ("消防工程", ["消防"]),
    ("地下人防", ["人防"]),
    ("重点难点", ["重点", "难点"]),
    ("资金保障", ["资金", "专款专用"]),
]
# Words that say how far material may be used again.
FACTS = ["施工总平面", "总平面布置", "平面布置图", "施工平面图", "施工进度网络图", "施工进度横道图", "计划开竣工日期", "计划开、竣工日期", "横道图", "网络图", "项目概况", "工程概况", "建设单位", "发包人", "楼栋号", "施工段划分图"]
FACT_IMAGES = ["踏勘", "现场踏勘", "现状照片", "现状图", "场地现状", "周边环境", "周边道路", "周边管线", "航拍", "实景图", "总平面", "平面布置", "进度网络图", "横道图", "交通组织"]
PRACTICE = ["优秀做法", "标准化做法", "标准化防护", "成品保护", "样板", "工艺", "做法", "防护", "扬尘", "喷淋", "洗车", "围挡", "材料堆放", "标识标牌", "安全文明", "绿色施工", "环境保护"]
PARAMETERIZED = ["钢筋", "模板", "混凝土", "防水", "砌体", "脚手架", "土方", "基坑", "降水", "临水", "临电", "垂直运输", "机械设备", "劳动力", "季节性施工", "雨季", "冬季", "高温施工", "深基坑", "塔吊", "施工电梯"]
DIRECT = ["质量管理制度", "质量保证体系", "安全管理制度", "安全保证体系", "文明施工", "优秀做法", "标准化做法", "标准化防护", "环境保护", "扬尘治理", "绿色施工", "成品保护", "应急管理", "应急预案", "技术交底", "三检制", "样板引路", "资料管理", "信息化管理", "农民工工资"]
OF_PROJECT = ["项目名称", "工程名称", "建设地点", "施工地址", "总建筑面积", "建筑面积", "结构形式", "地下", "地上", "厂房", "实验楼", "幼儿园", "学校", "棚户区", "产业园"]
REUSE = ["direct_reuse", "rewrite_reuse", "parameterized_reuse", "manual_review"]
OLD_REUSE = {"direct": "direct_reuse", "direct_use": "direct_reuse", "light_rewrite": "rewrite_reuse", "rewrite": "rewrite_reuse", "review_required": "manual_review"}
WEAK_CAPTIONS = ["图片", "图示", "示意图", "照片", "现场图", "效果图", "施工图示", "质量实例"]
WEAK_ROWS = ["序号", "编号", "项目", "名称", "内容", "措施", "原因", "说明", "设计说明", "主要内容", "控制内容", "检查内容", "具体措施", "做法说明", "约束条件", "水泥水化热", "材料选择", "施工方法", "控制方法", "质量要求", "注意事项"]
STEP = "第?[一二三四五六七八九十百0-9]+步|步骤[一二三四五六七八九十百0-9]+"
# Topics of material, all that match.
TOPICS = {
    "measure": ["测量", "控制网", "轴线", "标高", "监测", "放线"],
    "earthwork_foundation": ["土方", "开挖", "基坑", "支护", "降水", "护坡", "边坡"],
    "rebar": ["钢筋", "套筒", "直螺纹", "箍筋", "绑扎", "马凳"],
    "formwork": ["模板", "支撑", "支模", "墙柱板", "顶板", "梁模", "斜撑", "K板"],
    "concrete": ["混凝土", "浇筑", "振捣", "养护", "温控", "大体积"],
    "waterproof": ["防水", "卷材", "涂膜", "止水", "地下室", "屋面"],
    "scaffold": ["脚手架", "连墙件", "剪刀撑", "立杆", "横杆", "安全网"],
    "masonry": ["砌体", "砌筑", "砌块", "灰缝", "构造柱", "拉结筋"],
    "post_pour_joint": ["后浇带", "变形缝", "施工缝", "止水带"],
    "mechanical_electrical": ["机电", "接地", "避雷", "配电箱", "线管", "管线", "风机", "水泵", "阀门"],
    "safety": ["安全", "高处坠落", "坠落", "塔吊", "吊装", "触电", "火灾", "危险源", "洞口防护", "临边", "坍塌"],
    "civilized_site": ["安全文明", "标准化防护", "优秀做法", "文明", "扬尘", "洗车", "围挡", "垃圾", "生活区", "办公区", "食堂", "宿舍", "卫生间", "污水"],
    "bim_info": ["BIM", "信息化", "智慧工地", "模型", "平台", "监控", "数据", "族库", "碰撞检测", "深化"],
    "quality_management": ["质量", "检验", "验收", "创优", "通病", "保证体系"],
    "schedule_management": ["工期", "进度管理", "关键线路", "纠偏", "组织保证", "技术保证", "经济保证", "工期保证"],
    "resource_equipment": ["资源", "劳动力", "机械设备", "物资", "材料供应", "机械", "设备"],
}
# Domains of library slices, first match wins.
DOMAINS = [
    ("测量与监测", ["测量", "控制网", "轴线", "标高", "沉降", "监测"]),
    ("土方基坑", ["土方", "基坑", "降水", "支护", "开挖"]),
    ("钢筋工程", ["钢筋", "箍筋", "绑扎", "直螺纹"]),
    ("模板工程", ["模板", "支模", "支撑体系", "吊模"]),
    ("混凝土工程", ["混凝土", "浇筑", "振捣", "养护", "大体积"]),
    ("防水工程", ["防水", "止水", "后浇带", "施工缝", "屋面", "地下室"]),
    ("脚手架与防护", ["脚手架", "外架", "防护棚", "临边", "洞口"]),
    ("砌体工程", ["砌体", "砌筑", "构造柱", "灰缝"]),
    ("装饰装修", ["装饰", "装修", "抹灰", "涂料", "吊顶", "门窗", "地面"]),
    ("机电安装", ["机电", "给排水", "电气", "暖通", "通风", "空调", "管道", "桥架", "电缆"]),
    ("质量管理", ["质量", "创优", "样板", "三检", "通病", "验收"]),
    ("安全管理", ["安全", "危险源", "应急", "防护", "责任制"]),
    ("文明环保", ["文明", "环保", "扬尘", "绿色施工", "垃圾", "围挡", "喷淋", "洗车"]),
    ("工期进度", ["工期", "进度", "横道图", "网络图", "计划"]),
    ("资源配置", ["资源", "劳动力", "机械", "设备", "材料"]),
    ("BIM与信息化", ["BIM", "信息化", "智慧工地", "监控", "数据"]),
    ("风险管理", ["风险", "应急", "预案", "事故", "隐患"]),
    ("总平面与临设", ["总平面", "平面布置", "临设", "临时道路", "办公区", "生活区"]),
]
# Levels of parse warnings, and the flags of a library source.
WARNING_LEVELS = {
    "cross_page_content": "high", "missing_content": "high",
    "score_points_empty": "blocking", "score_point_raw_missing": "blocking", "not_technical_bid_score_point": "blocking", "score_point_ref_missing": "blocking",
    "possible_non_technical_score_point": "high", "duplicate_score_point_title": "high", "score_total_over_100": "high", "score_point_needs_confirmation": "high", "level_1_title_normalized": "high",
    "missing_field": "medium", "table_structure_change": "medium",
}
ADVISORY_KNOWLEDGE = ["law_regulation", "technical_standard", "enterprise_policy", "review_rule"]
NO_SLICES = "缺少章节切片"
GENERATION_JOBS = ["chapter_llm_generation", "chapter_generation"]


def any_of(c: Column, words: list[str]) -> Column:
    """Whether one of the words is in the text."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def asked(message: Column) -> Column:
    """A message in lower case with single spaces."""
    return F.regexp_replace(F.lower(F.trim(X.blank(message))), r"\s+", " ")


def _intents(c: Column, rules: list[tuple]) -> list[tuple[Column, Column]]:
    return [(hit if isinstance(hit, Column) else any_of(c, [w.lower() for w in hit]), F.struct(F.lit(name).alias("intent"), F.lit(confidence).alias("confidence"))) for name, confidence, hit in rules]


def _first(choices: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F
    for hit, value in choices:
        out = out.when(hit, value)
    return out.otherwise(otherwise)


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is not inlined again."""
    return F.transform(F.array(value), body)[0]


def assistant_intent(message: Column) -> Column:
    """(intent, confidence) of a question: fallback with 0 for a blank one and where no rule holds."""
    c = asked(message)
    about, strict = any_of(c, OVERVIEW_PROJECT), any_of(c, OVERVIEW_STRICT)
    overview = F.when(strict, about).otherwise(any_of(c, OVERVIEW_PHRASES) | (about & any_of(c, OVERVIEW_ASKED)))
    rules = [("fallback", 0.0, c == ""), *ASSISTANT_FIRST, ("project_overview", 0.92, overview), *ASSISTANT_MIDDLE, ("template_boundary", 0.9, any_of(c, TEMPLATE) & any_of(c, TEMPLATE_LIMITS)), *ASSISTANT_LAST]
    return _first(_intents(c, rules), F.struct(F.lit("fallback").alias("intent"), F.lit(0.0).alias("confidence")))


def platform_intent(message: Column, view: Column) -> Column:
    """(intent, confidence) of a question to the platform; the open view decides where no word does."""
    c, open_view = asked(message), F.trim(X.blank(view))
    rules = [("fallback", 0.0, c == ""), *PLATFORM, *((intent, VIEW_CONFIDENCE, open_view == v) for v, intent in VIEWS.items())]
    return _first(_intents(c, rules), F.struct(F.lit("fallback").alias("intent"), F.lit(0.0).alias("confidence")))


def score_category(c: Column) -> Column:
    """First category one of whose words is in the text; null if there is none."""
    return first_match(X.blank(c), CATEGORIES)


def score_point_class(title: Column, rule: Column, project_type: Column) -> Column:
    """(domain, category, confidence, needs_review) of a score point; its title goes before its rule."""
    title, rule = X.blank(title), X.blank(rule)
    pair = lambda d, n: F.struct(F.lit(d).alias("domain"), F.lit(n).alias("confidence"))
    out = lambda a, b, c, d: F.struct(a.alias("domain"), b.alias("category"), c.alias("confidence"), d.alias("needs_review"))

    def found(c: Column) -> Column:
        manages = any_of(title, MANAGEMENT) | F.coalesce(c["own"] == UNDERSTANDING, F.lit(False))
        cases = [
            (any_of(title, DESIGN), "design", 0.86), (manages, "management", 0.78), (c["own"].isNull() & any_of(rule, DESIGN), "design", 0.78),
            ((project_type == "epc") & any_of(rule, MANAGEMENT), "management", 0.78), (any_of(rule, MANAGEMENT), "management", 0.72),
        ]
        return _bound(_first([(F.coalesce(hit, F.lit(False)), pair(d, n)) for hit, d, n in cases], pair("construction", 0.82)), lambda f: graded(c, f))

    def graded(c: Column, f: Column) -> Column:
        domain = f["domain"]
        category = F.coalesce(c["own"], c["ruled"], F.when(domain == "design", "设计方案").when(domain == "management", "综合管理"), F.lit("unknown"))
        confidence = F.when(category == "unknown", F.least(f["confidence"], F.lit(0.68))).otherwise(f["confidence"])
        review = (domain == "design") | (category == "unknown") | (confidence < 0.75)
        return F.when(c["own"] == COMPLETENESS, out(F.lit("general"), F.lit(COMPLETENESS), F.lit(0.9), F.lit(False))).otherwise(out(domain, category, confidence, review))

    return _bound(F.struct(score_category(title).alias("own"), score_category(rule).alias("ruled")), found)


def states_facts(c: Column) -> Column:
    """Whether material states facts of one project: plans and overviews, or pictures of the site that show no general practice."""
    return any_of(c, FACTS) | (any_of(c, FACT_IMAGES) & ~any_of(c, PRACTICE))


def project_risk(c: Column, quality: Column, source_type: Column) -> Column:
    """How specific to one project a canonical text is: high, medium or low."""
    plain = lambda w: F.contains(c, X.canonical_text(F.lit(w))).cast("int")
    hits = sum((plain(w) for w in [*FACTS, *FACT_IMAGES, *OF_PROJECT]), F.lit(0))
    return (
        F.when((quality == "pdf_fallback") | states_facts(c) | (hits >= 2), "high")
        .when((hits == 1) | (quality == "review_required") | (source_type == "pdf_docx_fusion"), "medium")
        .otherwise("low")
    )


def reuse_level(c: Column) -> Column:
    """A level of reuse under its present name; null if it is none."""
    raw = F.trim(X.blank(c))
    renamed = _first([(raw == old, F.lit(new)) for old, new in OLD_REUSE.items()], raw)
    return F.when(renamed.isin(*REUSE), renamed)


def reuse_control(c: Column, quality: Column, source_type: Column, stated: Column, stated_risk: Column, keep_rewrite: Column) -> Column:
    """(level, risk) of reuse for a canonical text, with what was stated before and whether a stated rewrite is to be kept."""
    quality = X.blank(quality)
    risk = F.coalesce(F.when(F.trim(X.blank(stated_risk)).isin(*V.LEVELS), F.trim(X.blank(stated_risk))), project_risk(c, quality, X.blank(source_type)))
    level, medium = reuse_level(stated), V.higher_level(risk, F.lit("medium"))
    own = F.when(level == "manual_review", "high").when(level == "parameterized_reuse", medium).otherwise(risk)
    out = lambda a, b: F.struct(a.alias("level"), b.alias("risk"))
    rewrite = F.lit("rewrite_reuse")
    return (
        F.when(level.isNotNull() & (level != "rewrite_reuse"), out(level, own))
        .when((level == "rewrite_reuse") & keep_rewrite, out(level, risk))
        .when(states_facts(c) | (quality == "pdf_fallback"), out(F.lit("manual_review"), F.lit("high")))
        .when(any_of(c, PARAMETERIZED), out(F.lit("parameterized_reuse"), medium))
        .when(quality == "review_required", out(rewrite, medium))
        .when(any_of(c, DIRECT) & (risk == "low"), out(F.lit("direct_reuse"), F.lit("low")))
        .otherwise(out(rewrite, risk))
    )


def fusion_quality(status: Column, tables: Column, images: Column) -> Column:
    """Quality of a slice joined from two documents."""
    status = X.blank(status)
    has = (F.coalesce(tables, F.lit(0)) != 0) | (F.coalesce(images, F.lit(0)) != 0)
    return F.when((status == "matched") & has, "high").when(status.isin("fallback", "ambiguous"), "review_required").when(status == "unmatched", "pdf_fallback").otherwise("usable")


def weak_caption(c: Column) -> Column:
    """Whether a caption only says that there is a picture, a row label or a step."""
    raw = X.blank(c)
    compact = F.regexp_replace(raw, r"\s+", "")
    parts = F.filter(F.split(raw, r"[|；;、，,\s/]+"), lambda p: F.trim(p) != "")
    step = lambda p: F.regexp_replace(p, r"^[：:.\-—_]+|[：:.\-—_]+$", "").rlike(f"^(?:{STEP})$")
    steps = compact.rlike("^(?:第[一二三四五六七八九十百0-9]+步)+$") | ((F.size(parts) > 0) & F.forall(parts, step))
    return (compact != "") & (compact.isin(*WEAK_CAPTIONS, *WEAK_ROWS) | steps)


def image_review(caption: Column, nearby: Column, level: Column, risk: Column) -> Column:
    """Why a picture needs a review: fact_or_risk, no_caption, weak_caption, no_nearby_text; null if it needs none."""
    caption = X.blank(caption)
    return (
        F.when((level == "manual_review") | (risk == "high"), "fact_or_risk")
        .when(caption == "", "no_caption")
        .when(weak_caption(caption), "weak_caption")
        .when(X.blank(nearby) == "", "no_nearby_text")
    )


def review_bucket(reason: Column, risk: Column, caption: Column, nearby: Column) -> Column:
    """Bucket of a stated review reason."""
    reason, caption = X.blank(reason), F.trim(X.blank(caption))
    return (
        F.when(any_of(reason, ["高风险", "项目事实"]) | F.coalesce(risk == "high", F.lit(False)), "项目专属/高风险")
        .when(any_of(reason, ["说明过于泛化"]) | weak_caption(caption), "题注偏弱")
        .when(any_of(reason, ["未提取"]) | (caption == ""), "缺失题注")
        .when(any_of(reason, ["邻近文字"]) | (F.trim(X.blank(nearby)) == ""), "缺少邻近语义")
        .otherwise("其他")
    )


def topics(c: Column) -> Column:
    """All topics one of whose words is in the text, by name."""
    c = X.blank(c)
    return F.array_compact(F.array(*(F.when(any_of(c, words), F.lit(name)) for name, words in sorted(TOPICS.items()))))


def domain(c: Column) -> Column:
    """First domain one of whose words is in the text, marks and case apart."""
    return first_match(X.canonical_text(c), [(name, [w.lower() for w in words]) for name, words in DOMAINS], "其他")


def project_state(word: Column, generating: Column, generated: Column, inputs: Column, outline: Column, parsed: Column, failed: Column, high_reviews: Column, score_points: Column, files: Column) -> Column:
    """How far a project has come, from the furthest artefact that exists; all but the counts are booleans."""
    return (
        F.when(word, "word_exported")
        .when(generating, "chapters_generating")
        .when(generated & (failed | high_reviews), "chapters_generated_with_warnings")
        .when(generated, "chapters_generated")
        .when(inputs, "chapter_inputs_ready")
        .when(outline & high_reviews, "outline_needs_review")
        .when(outline, "outline_generated")
        .when(parsed & ((score_points <= 0) | high_reviews), "parse_needs_review")
        .when(parsed, "tender_parsed")
        .when(files > 0, "files_uploaded")
        .otherwise("empty_project")
    )


def state_flags(state: Column, score_points: Column, reviews: Column) -> Column:
    """Codes of the flags of a project: a parse to review, no score points, and the first five review items."""
    fixed = F.array_compact(F.array(F.when(state == "parse_needs_review", F.lit("parse_needs_review")), F.when((score_points == 0) & (state != "empty_project"), F.lit("score_points_empty"))))
    return F.concat(fixed, F.transform(F.slice(reviews, 1, 5), lambda r, i: F.concat(F.lit("review_item_"), (i + 1).cast("string"))))


def job_state(status: Column, active: Column) -> Column:
    """(status, terminal, retryable) of a job: pending or running work that nothing carries on was interrupted."""
    now = F.when(status.isin("pending", "running") & ~active, "interrupted").otherwise(X.blank(status))
    return F.struct(now.alias("status"), now.isin("succeeded", "failed", "cancelled", "interrupted").alias("terminal"), now.isin("failed", "interrupted").alias("retryable"))


def source_flags(confirmed: Column, status: Column, slices: Column, warnings: Column, knowledge: Column) -> Column:
    """Up to six flags of a library source, in order."""
    status, slices, warnings = X.blank(status), F.coalesce(slices, F.lit(0)), F.coalesce(warnings, F.lit(0))
    marks = [
        (F.coalesce(~confirmed, F.lit(False)), F.lit("待脱敏确认")), (status == "failed", F.lit("入库失败")), (status == "processing", F.lit("解析中")), (status == "pending_review", F.lit("待人工复核")),
        ((slices <= 0) & (status != "processing"), F.lit(NO_SLICES)), (warnings > 0, F.concat(warnings.cast("string"), F.lit(" 条提示"))),
        (knowledge.isin(*ADVISORY_KNOWLEDGE), F.lit("适合风险提示")), (knowledge == "excellent_bid", F.lit("适合正文参考")),
    ]
    return F.slice(F.array_compact(F.array(*(F.when(hit, mark) for hit, mark in marks))), 1, 6)


def source_level(confirmed: Column, status: Column, flags: Column, warnings: Column) -> Column:
    """blocked, review, risk or ready."""
    return (
        F.when(F.coalesce(~confirmed, F.lit(False)) | (status == "failed"), "blocked")
        .when(status.isin("processing", "pending_review"), "review")
        .when(F.array_contains(flags, NO_SLICES), "risk")
        .when(F.coalesce(warnings, F.lit(0)) > 0, "review")
        .otherwise("ready")
    )


def warning_level(kind: Column) -> Column:
    return _first([(kind == k, F.lit(v)) for k, v in WARNING_LEVELS.items()], F.lit("info"))


def parse_status(level: Column, items: Column) -> Column:
    """Aggregate over the warnings of a parse (null level: no warning) and its count of review items: failed, completed_with_warnings or completed."""
    return F.when(F.coalesce(F.bool_or(level == "blocking"), F.lit(False)), "failed").when((F.count(level) > 0) | (F.max(items) > 0), "completed_with_warnings").otherwise("completed")
