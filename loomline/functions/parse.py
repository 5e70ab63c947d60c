"""Parsing that needs positions or a stack: Arrow-batched Python, a batch at a time."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Chinese digits, words of comparison before and after a number, grades from best to worst.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
BEFORE_CJK = {"不少于": ">=", "不低于": ">=", "不小于": ">=", "至少": ">=", "满": ">=", "不超过": "<=", "不高于": "<=", "不大于": "<=", "不多于": "<=", "最多": "<=", "等于": "=="}
AFTER_CJK = {"及以上": ">=", "以上": ">=", "及其以上": ">=", "及以下": "<=", "以下": "<=", "以内": "<="}
# Categories of parameters, words that must stand in the text and near the number, units, the unit's name.
EXPERIENCE = ["经验", "经历", "年限", "从业", "项目负责人", "技术负责人", "施工管理"]
SCHEDULE = ["工期", "日历天", "计划开工", "计划竣工", "节点工期"]
PARAMETERS = [
    ("experience_years", EXPERIENCE, "年", "year"),
    ("duration_days", SCHEDULE, "日历天|天", "day"),
    ("similar_performance_count", ["类似业绩", "业绩"], "个|项", "count"),
    ("personnel_count", ["人员", "管理人员", "技术人员", "项目团队", "项目班子"], "人", "count"),
    ("equipment_count", ["机械", "设备", "塔吊", "施工电梯", "机具"], "台|套", "count"),
]
NUMBER = r"\d+(?:\.\d+)?|[零〇一二两三四五六七八九十百]+"
#: Characters before and after a number in which its comparison, and its words, may stand.
NEAR, AROUND = 8, 24
# English words, an addition.
BEFORE = BEFORE_CJK | {"at least": ">=", "at most": "<=", "no more than": "<="}
AFTER = AFTER_CJK | {"or more": ">=", "or less": "<="}
# Fixed values, continued.
GRADES = ("特级", "一级", "二级", "三级", "四级")
GRADED = "资质|施工总承包|专业承包"
UNITS = {"年": "year", "years": "year", "天": "day", "日": "day", "days": "day", "人": "person", "persons": "person", "台": "set", "sets": "set"}

CLAIMS = T.ArrayType(T.StructType().add("unit", T.StringType()).add("operator", T.StringType()).add("value", T.DoubleType()).add("start", T.IntegerType()).add("end", T.IntegerType()))
PARAMETER_CLAIMS = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType() if n == "value" else T.IntegerType() if n == "start" else T.StringType()) for n in ("category", "unit", "operator", "value", "text", "start")]))
OBJECT = T.StructType().add("object", T.StringType()).add("method", T.StringType())
CLAIM = re.compile(r"(\d+(?:\.\d+)?|[零〇一二两三四五六七八九十百]+)\s*(" + "|".join(UNITS) + r")(?![a-z])")


def chinese_number(raw: str | None) -> float | None:
    """Arabic or Chinese numeral up to the hundreds; None if it is neither."""
    raw = (raw or "").strip()
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", raw):
        return float(raw)
    total = 0
    for unit, size in (("百", 100), ("十", 10)):
        head, mark, tail = raw.partition(unit)
        if mark:
            if len(head) > 1 or (head and head not in DIGITS):
                head = head[-1:] if head[:1] in ("零", "〇") else None
                if head is None:
                    return None
            total += (DIGITS[head] if head else 1) * size
            raw = tail
            if not raw:
                return float(total)
    if not raw or any(c not in DIGITS for c in raw):
        return None
    value = 0
    for c in raw:
        value = value * 10 + DIGITS[c]
    return float(total + value)


def operator_near(text: str, start: int, end: int) -> str:
    """Comparison stated around a number; words before it go before words after it, and none means equality."""
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    return next((o for w, o in BEFORE.items() if w in before), None) or next((o for w, o in AFTER.items() if w in after), "==")


WIDTHS = str.maketrans("０１２３４５６７８９，；：！（）", "0123456789,;:!()", " ")
COUNTED = [(category, terms, unit, re.compile(f"({NUMBER})\\s*(?:{units})")) for category, terms, units, unit in PARAMETERS]


def parameter_claims_of(text: str | None) -> list[dict]:
    """Parameters that a text states: numbers with the unit of a category near one of its words, and grades of qualification; equal ones once."""
    text = (text or "").translate(WIDTHS)
    found = []
    for category, terms, unit, pattern in COUNTED:
        for m in pattern.finditer(text) if any(t in text for t in terms) else ():
            near = text[max(0, m.start() - AROUND) : m.end() + AROUND].strip()
            value = chinese_number(m[1])
            if value is not None and any(t in near for t in terms):
                found.append({"category": category, "unit": unit, "operator": operator_near(text, *m.span()), "value": value, "text": near, "start": m.start()})
    for g in grades_of(text):
        near = text[max(0, g["start"] - AROUND) : g["end"] + AROUND].strip()
        found.append({"category": "qualification_grade", "unit": g["unit"], "operator": g["operator"], "value": g["value"], "text": near, "start": g["start"]})
    return list({tuple(c[k] for k in ("category", "operator", "value", "unit", "text")): c for c in reversed(found)}.values())[::-1]


def claims_of(text: str | None) -> list[dict]:
    """Numbers with a unit and the comparison stated within eight characters: words before win over words after."""
    out = []
    for m in CLAIM.finditer(text or ""):
        value = chinese_number(m[1])
        if value is None:
            continue
        op = operator_near(text, *m.span())
        out.append({"unit": UNITS[m[2]], "operator": op, "value": value, "start": m.start(), "end": m.end()})
    return out


GRADE = re.compile(f"({'|'.join(GRADES)}).{{0,12}}(?:{GRADED})|(?:{GRADED}).{{0,12}}({'|'.join(GRADES)})")


def grades_of(text: str | None) -> list[dict]:
    """Grades of qualification as ranks, the best being 0, with the comparison stated nearby.

    The comparison is applied to the rank as it stands, so "at least grade two" asks for ranks of 2 and more.
    """
    out = []
    for m in GRADE.finditer(text or ""):
        op = operator_near(text, *m.span())
        out.append({"unit": "grade_rank", "operator": op, "value": float(GRADES.index(m[1] or m[2])), "start": m.start(), "end": m.end()})
    return out


def object_text(text: str) -> str | None:
    """The first balanced JSON object, braces inside strings apart."""
    start = text.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def without_noise(text: str) -> str:
    """Trailing commas dropped, bare keys quoted."""
    text = re.sub(r",(\s*[}\]])", r"\1", text.strip())
    return re.sub(r"([{,]\s*)([A-Za-z_]\w*)(\s*:)", r'\1"\2"\3', text)


def parsed_object(text: str | None) -> tuple[str | None, str]:
    """(canonical JSON of the object in a response, how it was read: none, rule or failed)."""
    text = (text or "").strip()
    fenced = re.sub(r"^```(?:json)?\s*|\s*```$", "", text)
    for candidate in dict.fromkeys([text, fenced, object_text(text)]):
        for method, tried in (("none", candidate), ("rule", without_noise(candidate or ""))):
            try:
                found = json.loads(tried or "")
            except ValueError:
                continue
            if isinstance(found, dict):
                return json.dumps(found, sort_keys=True, ensure_ascii=False, separators=(",", ":")), method
    return None, "failed"


@F.pandas_udf(T.DoubleType())
def number_value(raw: pd.Series) -> pd.Series:
    return raw.map(chinese_number)


@F.pandas_udf(CLAIMS)
def claims(text: pd.Series) -> pd.Series:
    return text.map(claims_of)


@F.pandas_udf(CLAIMS)
def grades(text: pd.Series) -> pd.Series:
    return text.map(grades_of)


@F.pandas_udf(PARAMETER_CLAIMS)
def parameter_claims(text: pd.Series) -> pd.Series:
    return text.map({t: parameter_claims_of(t) for t in text.unique()})


@F.pandas_udf(OBJECT)
def json_object(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(text.map(parsed_object).tolist(), columns=["object", "method"])
