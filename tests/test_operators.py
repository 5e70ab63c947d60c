"""Operators on literal rows: ties, nulls, empty input, CJK text."""

import pytest
from pyspark.sql import functions as F

from loomline.functions import parse, values
from loomline.functions import text as X
from loomline.operators import aggregates, dedup, incremental, joins, quality, retrieve, rules, sequences, trees
from loomline.plans import search
from loomline.sources import documents, tables


def one(spark, column, **row):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items())) if row else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("title, number, text", [("1.2 Site plan", "1.2", "Site plan"), ("3、安全 措施", "3", "安全 措施"), ("no number", None, "no number"), ("", None, ""), (None, None, "")])
def test_numbered_titles(spark, title, number, text):
    c = F.lit(title).cast("string")
    assert one(spark, X.title_number(c)) == number and one(spark, X.title_text(c)) == text


def test_canonical_and_keys(spark):
    assert one(spark, X.canonical_text(F.lit("（A）- b_C。 施工"))) == "abc施工"
    assert one(spark, X.section_key(F.array(F.lit("1 Start"), F.lit("1.1 The End")))) == "1:start > 1.1:theend"
    assert one(spark, X.path_ends_with(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bc")))) is True
    assert one(spark, X.path_ends_with(F.array(*map(F.lit, "bc")), F.array(*map(F.lit, "abc")))) is False


def test_query_tokens(spark):
    assert one(spark, X.query_tokens(F.lit("Plan_2 施工 施工方案 项目"))) == ["plan_2", "施工", "施工", "工方", "方案", "施工方", "工方案", "施工方案"]
    assert one(spark, X.query_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, X.material_tokens(F.lit("ab c 安全"))) == ["ab", "安全", "abc安全"]


def test_match_scores(spark):
    score = lambda a, b: one(spark, X.text_match_score(F.lit(a), F.lit(b)))
    assert score("1. Safety plan", "safety plan") == 1.0
    assert score("safety", "the safety plan") == 0.92
    assert score("the safety plan", "safety") == 0.82
    assert score("", "x") == 0.0 and score("abc", "xyz") == 0.0


def test_widths_tokens_windows(spark):
    assert one(spark, X.display_length(F.lit("abc施工"))) == 4
    assert [one(spark, X.tokens_quarter(F.lit("x" * n))) for n in (0, 1, 10, 14)] == [0, 1, 2, 4]
    assert one(spark, X.half_width(F.lit("１２（３）， x"))) == "12(3),x"
    assert one(spark, X.around(F.lit("0123456789" * 10), F.lit(50), F.lit(52), 3)) == "78901234"
    assert one(spark, X.redacted(F.lit("key sk-abcdefgh12 Bearer abc.def.ghi"))) == "key sk-*** Bearer ***"
    assert one(spark, X.contained(F.lit("abcdefghijkl mnopqrstuvwx yz"), F.lit("zz abcdefghijklmnopqrstuvwx"))) is False
    assert one(spark, X.contained(F.lit("abcdefgh"), F.lit("zz abc defgh"))) is True


def test_hashes(spark):
    assert one(spark, values.hamming(values.hex_bits(F.lit("ffffffffffffffff")), values.hex_bits(F.lit("fffffffffffffff8")))) == 3
    assert one(spark, values.hamming(values.hex_bits(F.lit("xyz")), F.lit(0).cast("long"))) == 999
    assert one(spark, values.higher_level(F.lit("odd"), F.lit("medium"))) == "odd"
    assert one(spark, values.higher_level(F.lit("low"), F.lit("high"))) == "high"
    assert [one(spark, values.duration_bucket(F.lit(x))) for x in (90.0, 180.0, 300.0, 300.5)] == ["<=90s", "90-180s", "180-300s", ">300s"]
    assert one(spark, values.duration_text(F.lit(3725.0))) == "1h 2m 5s"


def test_times(spark):
    at = lambda s: one(spark, F.date_format(values.parsed_time(F.lit(s)), "yyyy-MM-dd HH:mm"))
    assert at("2024-01-02T03:04:05Z") == "2024-01-02 03:04"
    assert at("2024-01-02T03:04:05+08:00") == "2024-01-01 19:04"
    assert at("2024-01-02T03:04:05") == "2024-01-01 19:04"
    assert at("nonsense") is None


@pytest.mark.parametrize("raw, value", [("12", 12.0), ("3.5", 3.5), ("十", 10.0), ("二十三", 23.0), ("一百零五", 105.0), ("两百", 200.0), ("x", None), ("", None), (None, None)])
def test_numerals(raw, value):
    assert parse.chinese_number(raw) == value


def test_claims(spark):
    got = one(spark, parse.claims(F.lit("保修期不少于五年，本项目的计划工期为90天以内; at most 20 persons")))
    assert [(c.unit, c.operator, c.value) for c in got] == [("year", ">=", 5.0), ("day", "<=", 90.0), ("person", "<=", 20.0)]


@pytest.mark.parametrize("text, found", [('{"a": 1}', ('{"a":1}', "none")), ('```json\n{"a": 1}\n```', ('{"a":1}', "none")), ('so: {"a": "}", b: [1,],} end', ('{"a":"}","b":[1]}', "rule")), ("[1]", (None, "failed")), ("", (None, "failed")), (None, (None, "failed"))])
def test_json_objects(text, found):
    assert parse.parsed_object(text) == found


def test_best_match(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.895), (1, 12, 0.8), (2, 10, 0.75), (3, 10, 0.5)], "a int, b int, score double")
    got = {r.a: (r.b, r.candidates, r.status) for r in joins.best_match(pairs, "a", "b", "score", F.col("b"), least=0.72, delta=0.01).collect()}
    assert got == {1: (10, 2, "ambiguous"), 2: (10, 1, "matched")}


def test_hamming_pairs_lose_nothing(spark):
    import random

    r = random.Random(1)
    bits = [r.getrandbits(63) for _ in range(20)] + [-1, -2]
    bits += [b ^ sum(1 << i for i in r.sample(range(63), r.randrange(8))) for b in bits for _ in range(3)]
    bits += bits[:9] * 2 + [5] * 300
    got = [(p.a, p.b, p.distance) for p in joins.hamming_pairs(spark.createDataFrame([*enumerate(bits), (9999, None)], "id int, bits long"), "id", "bits", 5).collect()]
    first = {v: i for i, v in reversed(list(enumerate(bits)))}
    apart = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    want = {(first[v], i, 0) for i, v in enumerate(bits) if first[v] < i} | {(i, j, apart(x, y)) for x, i in first.items() for y, j in first.items() if i < j and apart(x, y) <= 5}
    assert len(got) == len(want) and set(got) == want


def test_priority_join_of_a_frequent_key(spark):
    left = spark.range(50).selectExpr("id AS l", "'a' AS x", "'b' AS y")
    right = spark.range(70).selectExpr("id + 3 AS r", "if(id = 60, 'a', null) AS x", "'b' AS y")
    got = joins.priority_join(left, right, [F.col("x"), F.col("y")], [F.col("x"), F.col("y")], "l", "r").collect()
    assert {(g.r, g.key_number) for g in got} == {(63, 0)} and len(got) == 50


def test_compare_with_missing_rows(spark):
    e = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "k int, quality int")
    a = spark.createDataFrame([(2, 5), (3, 5), (4, 5)], "k int, n int")
    got = {x.k: (x.status, x.failed_checks) for x in joins.outer_compare(e, a, "k", {"quality": F.col("e.quality") == 1, "n": F.col("a.n") > 1}).collect()}
    assert got == {1: ("missing", ""), 2: ("passed", ""), 3: ("failed", "quality"), 4: ("extra", "")}


def test_interval_and_prefix_joins(spark):
    points = spark.createDataFrame([(x,) for x in range(-5, 30)], "x int")
    spans = spark.createDataFrame([("a", -3, 2), ("b", 7, 7), ("c", 9, 3)], "s string, lo int, hi int")
    assert sorted((r.s, r.x) for r in joins.interval_join(points, spans, "x", "lo", "hi", 4).collect()) == [("a", x) for x in range(-3, 3)] + [("b", 7)]
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, []), (4, ["b"])], "id int, path array<string>")
    outer = spark.createDataFrame([(["a"],), (["a", "b"],)], "top array<string>")
    assert sorted((r.id, len(r.top)) for r in joins.under_prefix(rows, outer, "path", "top").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_priority_join(spark):
    left = spark.createDataFrame([(1, "x", "p"), (2, None, "p"), (3, "", "q"), (4, "y", "r")], "l int, k1 string, k2 string")
    right = spark.createDataFrame([(7, "x", "z"), (8, "w", "p"), (6, "v", "p")], "r int, k1 string, k2 string")
    got = {x.l: (x.r, x.key_number) for x in joins.priority_join(left, right, [F.col("k1"), F.col("k2")], [F.col("k1"), F.col("k2")], "l", "r").collect()}
    assert got == {1: (7, 0), 2: (6, 1), 3: (None, None), 4: (None, None)}


def test_heading_path(spark):
    rows = [(1, 1, "A"), (2, 2, "A.1"), (3, None, "x"), (4, 1, "B"), (5, None, "y"), (6, 3, "B..1")]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, pos int, level int, title string")
    got = [r.path for r in sequences.heading_path(df, ["doc"], ["pos"], "level", "title", 3).orderBy("pos").collect()]
    assert got == [["A"], ["A", "A.1"], ["A", "A.1"], ["B"], ["B"], ["B", "B..1"]]


def test_outline_spans(spark):
    rows = [(0, 1, 1), (1, 2, 1), (2, 2, 4), (3, 1, 4), (4, 2, 6)]
    df = spark.createDataFrame([("d", *r, 9) for r in rows], "doc string, pos long, level int, page int, last int")
    got = [(r.parent, r.end_page, r.descendants) for r in sequences.outline_spans(df, ["doc"], "pos", "level", "page", "last").orderBy("pos").collect()]
    assert got == [(None, 3, 2), (0, 3, 0), (0, 4, 0), (None, 9, 1), (3, 9, 0)]


def test_greedy_by_keys(spark):
    df = spark.createDataFrame([("b", 1, ["x", "y"]), ("b", 2, ["y"]), ("b", 3, ["z", None]), ("b", 4, []), ("c", 1, ["x"]), ("b", 5, ["z"])], "b string, pos int, keys array<string>")
    assert sorted((r.b, r.pos) for r in dedup.greedy_by_keys(df, ["b"], ["pos"], "keys").collect()) == [("b", 1), ("b", 3), ("b", 4), ("c", 1)]


def test_overlay_keeps_explicit_nulls(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": None, "c": "3"})], "x map<string,string>, y map<string,string>")
    assert df.select(dedup.overlay(F.col("x"), F.col("y"))).first()[0] == {"a": None, "b": "2", "c": "3"}


def test_replacement_and_placing(spark):
    rows = [("c", i, "t1", i < 5) for i in range(5)] + [("c", 5, "t2", False), ("c", 6, "t2", False), ("c", 7, "t2", False)]
    df = spark.createDataFrame(rows, "c string, pos int, theme string, chosen boolean")
    got = sorted(r.pos for r in dedup.replace_over_represented(df, ["c"], "pos", "theme", "chosen", 3, 2).where("chosen").collect())
    assert got == [0, 1, 2, 5, 6]
    placed = spark.createDataFrame([("c", 1, "s", 9.0), ("c", 1, "t", 5.0), ("c", 2, "s", 9.0), ("c", 2, "t", 5.0)], "c string, item int, slot string, score double")
    assert sorted((r.item, r.slot) for r in dedup.place_greedily(placed, ["c"], "item", "slot", "score", "item", 6.0).collect()) == [(1, "s"), (2, "t")]


def test_staging_order(spark):
    f, t = F.lit(False), F.lit(True)
    decide = lambda *a: one(spark, rules.staging_decision(*a))
    assert decide(t, t, F.lit("high"), t, t, F.lit(1.0), t) == "duplicate_existing"
    assert decide(f, f, F.lit("high"), t, f, F.lit(1.0), t) == "project_specific_manual_review"
    assert decide(f, f, F.lit("low"), t, f, F.lit(1.0), t) == "suspected_duplicate_existing"
    assert decide(f, f, F.lit("low"), f, f, F.lit(None).cast("double"), t) == "manual_review"
    assert decide(f, f, F.lit("low"), f, f, F.lit(0.58), t) == "candidate_reuse"


def test_intent_scores(spark):
    intents = [{"name": "a", "match": ["x", "y"]}, {"name": "b", "match": ["z"], "required": ["q"]}]
    s = lambda text, *asked: round(one(spark, rules.intent_score(F.lit(text), intents, F.array(*map(F.lit, asked)))), 4)
    assert s("x y", "a") == 0.59 and s("x z", "a", "b") == 0.0 and s("x z q", "a", "b") == 0.94 and s("n", "a") == 0.0


def test_resume_and_fold(spark):
    work = spark.createDataFrame([(k, "h", "c") for k in range(6)], "id int, package_hash string, cache_key string")
    state = spark.createDataFrame([(1, "v1", "h", "c", "completed"), (2, "v0", "h", "c", "completed"), (3, "v1", "x", "c", "completed"), (4, "v1", "h", None, "failed"), (5, "v1", "h", "d", "completed")], "id int, schema_version string, package_hash string, cache_key string, status string")
    got = {r.id: (r.action, r.reason) for r in incremental.resume_decision(work, state, "id", "v1").collect()}
    assert got == {0: ("generate", "no state"), 1: ("skip", "completed"), 2: ("generate", "version"), 3: ("generate", "input changed"), 4: ("generate", "unfinished"), 5: ("generate", "settings changed")}
    assert {r.action for r in incremental.resume_decision(work, state, "id", "v1", force=True).collect()} == {"generate"}
    events = spark.createDataFrame([("j", 1, "running", "m", 5), ("j", 2, "failed", None, None)], "job string, seq int, status string, message string, started int")
    assert tuple(incremental.last_event_fold(events, "job", ["seq"], ["status", "message"], ["started"]).first()) == ("j", "failed", None, 5)


def test_bm25_repeats_and_search(spark):
    docs = spark.createDataFrame([(1, "safety plan safety"), (2, "site plan"), (3, ""), (4, "other words")], "id int, text string")
    q = lambda t: search.bm25_search(docs, spark.createDataFrame([(0, t)], "q int, text string"), "id", "q", F.col("text"), F.col("text"), 3).collect()
    single, double = q("safety"), q("safety safety")
    assert [r.id for r in single] == [1] and abs(double[0].score - 2 * single[0].score) < 2e-4
    assert [r.id for r in q("plan safety")] == [1, 2] and q("nothing") == []


def test_material_search_intents(spark):
    rows = [(1, "safety fire plan", ":safety", 1, 0, "high"), (2, "safety plan", ":safety > :fire", 0, 0, "usable"), (3, "garden", ":garden", 9, 9, "high")]
    df = spark.createDataFrame(rows, "id int, search_text string, section_key string, table_count int, image_count int, quality string")
    assert [r.id for r in search.material_search(df, "safety plan", ":safety", [], 5).collect()] == [1, 2]
    intents = [{"name": "fire", "triggers": ["fire"], "match": ["fire"]}]
    assert [r.id for r in search.material_search(df, "fire safety", None, intents, 5).collect()] == [1]


def test_trees_and_quality(spark):
    nodes = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", None, "D")], "node string, parent string, title string")
    assert {r.node: (r.depth, r.path) for r in trees.flatten(nodes, "node", "parent", "title", 3).collect()} == {"a": (1, ["A"]), "b": (2, ["A", "B"]), "c": (3, ["A", "B", "C"]), "d": (1, ["D"])}
    assert trees.closure(nodes, "node", "parent", 2).where("ancestor = 'a'").count() == 3
    found = quality.issues(nodes, "node", [("blocking", "root", F.col("parent").isNull()), ("warning", "null", F.lit(None).cast("boolean"))])
    assert quality.gate(found).first().verdict == "blocked" and quality.gate(found.limit(0)).first().verdict == "passed"


def test_promotion_numbers_on(spark):
    library = spark.createDataFrame([(7, "x")], "id long, k string")
    new = spark.createDataFrame([(0, "x"), (1, "y"), (2, "y"), (3, "z")], "id long, k string")
    got = incremental.promote(library, new, "id", "k", "id").collect()
    assert sorted(r.id for r in got) == [7, 8, 9] and sorted(r.k for r in got) == ["x", "y", "z"]
    assert incremental.promote(library.limit(0), new, "id", "k", "id").count() == 3


def test_small_aggregates(spark):
    df = spark.createDataFrame([("g", "a", 3), ("g", "b", 1), ("g", "b", 5), ("g", "a", 2), ("g", "c", 0)], "g string, v string, at int")
    assert [(r.v, r.n) for r in aggregates.top_values(df, ["g"], "v", "at", 2).orderBy("rank").collect()] == [("b", 2), ("a", 2)]
    empty = df.limit(0).agg(*aggregates.duration_stats(F.col("at")))
    assert tuple(empty.first()) == (0.0, 0.0, 0.0, 0.0, 0.0)
    assert [r.v for r in retrieve.with_minimum(df, ["g"], 1, 2, F.col("v") == "b", F.desc("at")).orderBy("rank").collect()] == ["b", "b"]


def test_word_files(spark, tmp_path):
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>1 Plan</w:t></w:r></w:p><w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr><w:tr>{cell("c")}</w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "one.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    rows = documents.docx_blocks(spark, str(tmp_path)).orderBy("block_index").collect()
    assert [(r.block_type, r.style, r.text, r.row_count, r.max_column_count) for r in rows] == [("paragraph", "Heading1", "1 Plan", 0, 0), ("table", None, "a | b\nc", 2, 2)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2, "b": "x"}\n')
    got = tables.json_lines(spark, str(tmp_path), "a int, b string").where("a is not null").collect()
    assert sorted((r.a, r.b) for r in got) == [(1, None), (2, "x")]
