"""Canonical text, titles, tokens and similarity, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that canonical text drops, the pattern of numbered titles, words that queries ignore.
CANONICAL_MARKS = r"[\s　.．、，,。；;：:（）()【】\[\]_-]+"
NUMBERED = r"^\s*(\d+(?:\.\d+)*)[.．、\s]+(\S.*)$"
STOPWORDS = ("这个", "当前", "一下", "什么", "怎么", "哪些", "有没有", "项目")
MATCH_MARKS = r"[（）()【】\[\]《》<>、，。；;：:！!？?\s\"'“”‘’\-_.·]"
MATCH_CUTS = r"[，。；;：:、\s\"'“”‘’（）()【】\[\]《》<>]+"
CJK = r"[一-鿿]"


def blank(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def canonical_text(c: Column) -> Column:
    return F.lower(F.regexp_replace(blank(c), CANONICAL_MARKS, ""))


def title_number(c: Column) -> Column:
    """Leading dotted number of a title, null if there is none."""
    return F.nullif(F.regexp_extract(blank(c), NUMBERED, 1), F.lit(""))


def title_text(c: Column) -> Column:
    found = F.regexp_extract(blank(c), NUMBERED, 2)
    return F.trim(F.when(found != "", found).otherwise(blank(c)))


def canonical_segment(c: Column) -> Column:
    return F.concat(F.coalesce(title_number(c), F.lit("")), F.lit(":"), canonical_text(title_text(c)))


def section_key(path: Column) -> Column:
    """A path of titles as one key."""
    return F.array_join(F.transform(path, canonical_segment), " > ")


def number_path(path: Column) -> Column:
    return F.filter(F.transform(path, title_number), lambda n: n.isNotNull())


def path_ends_with(path: Column, end: Column) -> Column:
    """Whether ``path`` ends with the elements of ``end``."""
    n = F.size(end)
    return (n > 0) & (F.size(path) >= n) & (F.slice(path, F.greatest(F.size(path) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))) == end)


def material_tokens(c: Column) -> Column:
    """Runs of Latin letters and digits or of CJK characters, two or more long, and the whole canonical text; repeats stay."""
    runs = F.transform(F.regexp_extract_all(blank(c), F.lit(rf"[A-Za-z0-9]{{2,}}|{CJK}{{2,}}"), F.lit(0)), F.lower)
    return F.filter(F.concat(runs, F.array(canonical_text(c))), lambda t: t != "")


def grams(run: Column, size: int) -> Column:
    n = F.length(run)
    starts = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(run, i, F.lit(size)))


def query_tokens(c: Column) -> Column:
    """Lower-case Latin words; CJK runs of up to two characters whole, longer ones as 2-, 3- and 4-grams; no stop words; repeats stay."""
    low = F.lower(blank(c))
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"{CJK}+"), F.lit(0))
    parts = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) <= 2, F.array(r)).otherwise(F.concat(*(grams(r, n) for n in (2, 3, 4))))))
    return F.filter(F.concat(latin, parts), lambda t: ~t.isin(*STOPWORDS))


def long_phrases(c: Column, most: int = 20) -> Column:
    """CJK runs of four or more characters."""
    return F.slice(F.regexp_extract_all(blank(c), F.lit(f"{CJK}{{4,}}"), F.lit(0)), 1, most)


def phrase_overlap(query: Column, text: Column, most: float = 0.8) -> Column:
    """Share of the query's phrases found in the text, scaled to ``most``."""
    phrases, canon = long_phrases(query), canonical_text(text)
    hits = F.size(F.filter(phrases, lambda p: F.contains(canon, p)))
    return F.when(F.size(phrases) > 0, F.least(F.lit(most), hits / F.size(phrases) * most)).otherwise(F.lit(0.0))


def title_overlap(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(material_tokens(a)), F.array_distinct(material_tokens(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(F.lit(0.0))


def match_text(c: Column) -> Column:
    """Lower case, without a leading number and marks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(blank(c))), r"^\s*\d+(\.\d+)*[、.．\s-]*", ""), MATCH_MARKS, "")


def match_segments(c: Column, most: int = 8) -> Column:
    return F.slice(F.filter(F.transform(F.split(blank(c), MATCH_CUTS), match_text), lambda s: F.length(s) >= 3), 1, most)


def text_match_score(source: Column, target: Column) -> Column:
    """1 equal, 0.92 contained, 0.82 containing, else shared segments up to 0.78, else shared characters times 0.56."""
    s, t = match_text(source), match_text(target)
    ss, ts = match_segments(source), match_segments(target)
    hits = F.size(F.filter(ss, lambda x: F.contains(t, x))) + F.size(F.filter(ts, lambda x: F.contains(s, x)))
    chars = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"[一-龥a-z0-9]"), F.lit(0)))
    sc, tc = chars(s), chars(t)
    few = (F.size(sc) < 6) | (F.size(tc) < 6)
    return (
        F.when((s == "") | (t == ""), F.lit(0.0))
        .when(s == t, F.lit(1.0))
        .when((F.length(s) >= 4) & F.contains(t, s), F.lit(0.92))
        .when((F.length(t) >= 4) & F.contains(s, t), F.lit(0.82))
        .when(hits > 0, F.least(F.lit(0.78), hits / F.greatest(F.lit(2), F.size(ss) + F.size(ts)) + 0.34))
        .when(few, F.lit(0.0))
        .otherwise(F.size(F.array_intersect(sc, tc)) / F.least(F.size(sc), F.size(tc)) * 0.56)
    )


def keyword_count(text: Column, words: list[str]) -> Column:
    """Non-overlapping occurrences of all the words in the lower-cased text."""
    low = F.lower(blank(text))
    total = F.lit(0)
    for w in dict.fromkeys(words):
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(w)))) / len(w)).cast("int") * words.count(w)
    return total


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any word is in the text, white space and case apart."""
    low = F.lower(F.regexp_replace(blank(text), r"\s+", ""))
    found = F.lit(False)
    for w in words:
        found = found | F.contains(low, F.lit("".join(w.split()).lower()))
    return found


def chunks(c: Column, size: int = 12) -> Column:
    n = F.ceil(F.length(c) / size).cast("int")
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(c, i * size + 1, F.lit(size)))


def contained(text: Column, whole: Column, share: float = 0.75, least: int = 8) -> Column:
    """Whether the canonical text is in the canonical whole, entirely or for that share of its 12-character chunks."""
    t, w = canonical_text(text), canonical_text(whole)
    parts = chunks(t)
    hits = F.size(F.filter(parts, lambda p: F.contains(w, p)))
    return (F.length(t) >= least) & (F.contains(w, t) | (hits >= share * F.size(parts)))


def half_width(c: Column) -> Column:
    """Full-width digits and marks to half width, blanks dropped."""
    return F.replace(F.translate(blank(c), "０１２３４５６７８９，；：！（）", "0123456789,;:!()"), F.lit(" "))


def truncated(c: Column, most: int = 220) -> Column:
    flat = F.trim(F.regexp_replace(blank(c), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.left(flat, F.lit(most)), F.lit("...")))


def around(c: Column, start: Column, end: Column, size: int = 24) -> Column:
    """Text from ``size`` characters before ``start`` to as many after ``end`` (0-based, end exclusive), trimmed."""
    first = F.greatest(start - size, F.lit(0))
    return F.trim(F.substr(c, (first + 1).cast("int"), (end + size - first).cast("int")))


def display_length(c: Column) -> Column:
    """ASCII characters count half, rounded up; others one."""
    ascii_ = F.length(F.regexp_replace(blank(c), r"[^\x00-\x7F]", ""))
    return F.length(blank(c)) - ascii_ + F.floor((ascii_ + 1) / 2)


def redacted(c: Column) -> Column:
    """Keys and bearer tokens masked."""
    masked = F.regexp_replace(blank(c), r"(?i)\bsk-[A-Za-z0-9_-]{8,}", "sk-***")
    return F.regexp_replace(masked, r"(?i)\b(bearer)\s+[A-Za-z0-9._-]{8,}", "$1 ***")


def risky_path(path: Column) -> Column:
    """A segment over 70 characters, or over 42 with sentence marks."""
    return F.exists(path, lambda s: (F.length(s) > 70) | ((F.length(s) > 42) & s.rlike("[，。；,.;]")))


def tokens_quarter(c: Column) -> Column:
    """A token for every four characters, at least one; none for empty text. Half to even."""
    n = F.length(blank(c))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(n / 4).cast("int")))


def tokens_dense(chars: Column) -> Column:
    """A token for every 1.8 characters, rounded up."""
    return F.ceil(chars / 1.8)


def heading(text: Column, style: Column) -> Column:
    """(level, number, title) of a paragraph that is a heading, else null: numbered, or short and of a heading style; contents lines are none."""
    t = F.trim(F.regexp_replace(blank(text), r"\s+", " "))
    low = F.lower(blank(style))
    number = title_number(t)
    contents = low.startswith("toc") | t.rlike(r"(\.{3,}|…+|\t)\s*\d+$")
    styled = low.rlike(r"heading|标题") & (F.length(t) <= 60) & ~t.rlike("[。；;]$")
    style_level = F.coalesce(F.regexp_extract(low, r"(\d+)", 1).try_cast("int"), F.lit(1))
    numbered = F.struct(F.size(F.split(number, r"\.")).alias("level"), number.alias("number"), F.concat_ws(" ", number, title_text(t)).alias("title"))
    plain = F.struct(style_level.alias("level"), F.lit(None).cast("string").alias("number"), t.alias("title"))
    return F.when((t == "") | contents, F.lit(None)).when(number.isNotNull(), numbered).when(styled, plain)


def caption(text: Column, most: int = 64) -> Column:
    """A caption without marks around it; empty if it is a path, a table row, too long or only digits."""
    t = F.trim(F.regexp_replace(F.regexp_replace(blank(text), r"^[|；;、，,\s]+|[|；;、，,\s]+$", ""), r"\s+", " "))
    bad = t.contains(" > ") | (F.length(t) - F.length(F.replace(t, F.lit("|"))) >= 2) | (F.length(t) > most) | t.rlike(r"^\d+$")
    return F.when(bad, F.lit("")).otherwise(t)
