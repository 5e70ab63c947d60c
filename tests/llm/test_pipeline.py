import pytest

pytest.importorskip("loomline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

import random
import re

from loomline.llm import decontaminate, mixture, quality_cnn, sharding, simhash
from loomline.llm.common import table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    top = tmp_path_factory.mktemp("tables")
    some = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
    items = [(n, some(14)) for n in range(3)]
    docs = [(i, some(r.randrange(20, 90)), "en", f"s{r.randrange(3)}", 1) for i in range(150)]
    docs += [(200 + i, " ".join(w + "%%%" for w in some(40).split()), "en", "s0", 1) for i in range(60)]
    docs += [(300 + i, docs[i][1], "en", "s1", 1) for i in range(20)]
    docs += [(400 + i, some(20) + " " + items[i % 3][1] + " " + some(20), "en", "s2", 1) for i in range(6)]
    docs += [(500, None, "en", None, 0), (501, "", "en", "s1", 0)]
    labels = [(d[0], 0 if 200 <= d[0] < 300 else 1, 0) for d in docs if d[0] < 300]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{top}/{name}.parquet")
    return str(top)


def test_stages_take_effect(spark, folder):
    docs = table(spark, folder, "documents")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).persist()
        steps[name] = docs.collect()
        assert docs.columns == columns + ["shard"] * (name == "sharding")
    good = {d.doc_id for d in steps["quality classifier"]}
    assert not good & set(range(200, 260)) and len(good & set(range(150))) >= 145
    one = [d.doc_id for d in steps["near duplicates"]]
    assert len(one) == len(set(one)) and not set(one) & set(range(300, 320))
    assert {d for d in good if d < 150} <= set(one)
    clean = {d.doc_id for d in steps["benchmark decontamination"]}
    assert set(one) - clean == set(range(400, 406)) & set(one)
    sizes = {d.doc_id: len(re.findall(mixture.WORD, d.text or "")) for d in steps["benchmark decontamination"]}
    taken = {}
    for d in steps["source mix"]:
        taken[d.doc_id] = taken.get(d.doc_id, 0) + len(re.findall(mixture.WORD, d.text or ""))
    want = {m.doc_id: m.taken for m in mixture.mix_sources(spark.createDataFrame(steps["benchmark decontamination"], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert {i: n for i, n in want.items() if n} == {i: n for i, n in taken.items() if n}
    assert all(n <= 2 * sizes[i] for i, n in taken.items())
    last = steps["sharding"]
    assert len(last) == len(steps["source mix"]) and all(0 <= d.shard < 24 for d in last)
    by_text = {}
    for d in last:
        assert by_text.setdefault(d.text or "", d.shard) == d.shard


def test_run_agrees_with_itself(spark, folder):
    first = sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert first and first == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_odd_tables(spark, folder, tmp_path):
    """Null, empty, repeated and very long texts, and columns named as the stages name theirs; then no rows."""
    r = random.Random(9)
    some = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
    rows = [(i, some(40), "s1") for i in range(30)] + [(None, None, None), (1, "", "s1"), (2, some(200_000), "s2"), (None, some(30), "s2"), (None, None, None)]
    rows += [(3, rows[3][1], "s1")] * 3
    own = ["shard", "__hit", "__size", "__group", "__key", "__piece", "__once", "__source", "__kept", "fp", "row", "key", "lang", "n chars", "a`b", "__runs", "once"]
    schema = "doc_id long, text string, source string, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in own)
    for name in ("labels", "benchmark"):
        table(spark, folder, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for n, some_rows in (("full", rows), ("empty", [])):
        docs = spark.createDataFrame([(*x, *own) for x in some_rows], schema)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path)).persist()
            if name == "sharding":
                assert docs.columns == ["doc_id", "text", "source", "input_shard", *own[1:], "shard"]
            else:
                assert docs.columns == before.columns
            for x in docs.collect():
                assert [x["input_" * (name == "sharding") + "shard"], *(x[c] for c in own[1:])] == own
        assert bool(docs.count()) == (n == "full")


def test_stages_keep_odd_rows(spark, folder):
    rows = [(None, None, None), (5, "", "a"), (5, "", "a"), (6, "some words", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [x.text for x in corpus_pipeline.near_duplicates(spark, docs, folder).orderBy("doc_id").collect()] == ["", "some words"]
    assert corpus_pipeline.decontamination(spark, docs, folder).count() == 4
    last = corpus_pipeline.sharding(spark, docs, folder).collect()
    assert len(last) == 4 and len({x.shard for x in last if not x.text}) == 1


def plain_pack(sizes, capacity):
    bins, out = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(room, b) for b, room in enumerate(bins) if room >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            bins.append(max(capacity, sizes[i]))
            b = len(bins) - 1
        bins[b] -= sizes[i]
        out.append((i, b))
    return [b for _, b in sorted(out)]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 7, 7, r.randrange(1, 60), 120]) for _ in range(80)]
    assert sharding.best_fit_decreasing(sizes, 100) == plain_pack(sizes, 100)
    bins = sharding.pack(sizes, 9)
    loads = [sum(s for s, b in zip(sizes, bins) if b == x) for x in range(9)]
    assert max(loads) <= sum(sizes) / 9 + max(sizes)  # items of 120 may leave no better choice
    small = [s for s in sizes if s < 20] * 4
    loads = [sum(s for s, b in zip(small, sharding.pack(small, 9)) if b == x) for x in range(9)]
    assert max(loads) <= sum(small) / 9 + 1
    assert sharding.pack([], 3) == []


@pytest.mark.parametrize("ranked, broadcast", [(1 << 14, 1000), (3, 0)])
def test_every_group_is_packed(spark, monkeypatch, ranked, broadcast):
    import hashlib
    import zlib

    monkeypatch.setattr(sharding, "RANKED", ranked)
    monkeypatch.setattr(sharding, "BROADCAST_GROUPS", broadcast)
    r = random.Random(5)
    texts = ["x" * r.randrange(20) + f"{i:03d}" for i in range(300)] + ["y" * r.randrange(2000, 5000) for _ in range(20)] + ["copy"] * 400 + ["other copy"] * 9
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 7).collect()
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    halves = lambda t: tuple(signed(int(hashlib.md5(t.encode()).hexdigest()[a : a + 16], 16)) for a in (0, 16))
    groups = sorted(set(texts), key=halves)  # of one size, in order of their digests
    bins = dict(zip(groups, sharding.pack([texts.count(t) * (len(t) + 8) for t in groups], 7)))
    assert {g.doc_id: g.shard for g in got} == {i: bins[t] for i, t in enumerate(texts)}
    assert {g.doc_id: g.text_crc32 for g in got} == {i: zlib.crc32(t.encode()) for i, t in enumerate(texts)}


def test_classes_of_sizes(spark):
    sizes = [0, 8, 32767, 32768, 32769, 65535, 65536, 65537, 10**6, 10**9 + 7, 2**40 + 1, 10**15]
    got = [x[0] for x in spark.createDataFrame([(n,) for n in sizes], "n long").select(sharding.size_class(sharding.F.col("n"))).collect()]
    assert all(n <= c <= n * (1 + 1 / 1024) for n, c in zip(sizes, got)) and got[:4] == sizes[:4]


def test_shards(spark):
    import zlib

    rows = [(i, f"text {i % 37} " * (i % 11 + 1), "x") for i in range(500)] + [(None, None, "x"), (600, "", "x"), (3, "text 3 " * 4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard_documents(df, 5).collect()
    assert len(got) == len(rows)
    assert sorted((-1 if g.doc_id is None else g.doc_id, g.size, g.text_crc32) for g in got) == sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for s in range(5):
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))
    texts = {}
    for g in got:
        assert texts.setdefault((g.size, g.text_crc32), g.shard) == g.shard
    assert sharding.shard_documents(df.limit(0), 5).count() == 0


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        free -= set(over)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out | {s: left * w[s] / sum(w[x] for x in free) for s in free}


def test_mix(spark):
    r = random.Random(6)
    rows = [(i, " w" * r.randrange(0, 40), r.choice(["b", "a", "é", None, "z"]) if i > 20 else "tiny", "x") for i in range(900)]
    rows += [(1000, None, "b", "x"), (1001, "\xa0", "a", "x"), (None, "one two", "a", "x"), (5, rows[5][1], "tiny", "x"), (2000, "big " * 3000, "z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string").repartition(5)
    out = [g.asDict() for g in mixture.mix_sources(df).collect()]
    assert len(out) == len(rows)
    sizes = {}
    for g in out:
        sizes[g["source"]] = sizes.get(g["source"], 0) + g["size"]
    assert sum(sizes.values()) == sum(len(re.findall("[^ \t-\r]+", t or "")) for _, t, *_ in rows)
    want = plain_targets(sizes)
    for s, n in sizes.items():
        mine = [g for g in out if g["source"] == s]
        assert all(g["source_size"] == n and abs(g["target"] - want[s]) < 1e-6 and 0 <= g["taken"] <= 2 * g["size"] for g in mine)
        assert abs(sum(g["taken"] for g in mine) - want[s]) <= 2
    again = mixture.mix_sources(df.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(str(x) for x in mixture.mix_sources(df).collect())
    assert mixture.mix_sources(df.limit(0)).count() == 0


def plain_taken(rows, targets):
    """Words taken of each row: complete epochs, then rows by key until the rest is full."""
    import hashlib
    import math

    out = []
    for source, (size, target) in targets.items():
        mine = []
        for i, t, s in rows:
            if s == source:
                t = t or ""
                n = len(re.findall("[^ \t-\r]+", t))
                digest = hashlib.md5(f"42:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
                weight = max(0.1, 1 / (1 + abs(math.log((len(t) + 1) / (n + 1) / 7))))
                mine.append((-math.log((int(digest[:13], 16) + 1) / 2**52) / weight, n, str(i)))
        epochs = int(target // size) if size else 0
        rest = math.floor(target) - epochs * size
        for _, n, i in sorted(mine):
            out.append((i, n, epochs * n + min(n, rest)))
            rest -= min(n, rest)
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_the_keys_decide_what_is_taken(spark, hot):
    r = random.Random(8)
    rows = [(i, " ".join("x" * r.randrange(1, 9) for _ in range(r.randrange(0, 30))), r.choice("abcd")) for i in range(400)]
    rows += [(None, None, "a"), (None, "w w", "b"), (7, "w w", None)] + rows[:40]
    if hot:
        rows = rows + [(i % 2 or None, "word", "a") for i in range(1000)] + [(5, f"text {i}", "c") for i in range(500)]
    got = mixture.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    targets = {g.source: (g.source_size, g.target) for g in got}
    assert sorted((str(g.doc_id), g.size, g.taken) for g in got) == plain_taken(rows, targets)


def test_repeated_rows_fill_the_target(spark):
    rows = spark.range(1000).selectExpr("1L AS doc_id", "'word' AS text", "'a' AS source").repartition(7)
    got = mixture.mix_sources(rows).agg({"target": "max", "taken": "sum"}).first()
    assert abs(got["sum(taken)"] - got["max(target)"]) <= 1 and got["max(target)"] == 1500
    assert mixture.mixed_documents(rows).count() == 1500


def test_sql_of_the_mix(spark, folder):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = [tuple(x) for x in mixture.op3_source_mix(spark, folder).collect()]
    assert sorted(got) == sorted(con.sql(mixture.ORACLE_SQL).fetchall())


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "abc", "x"), (3, "x" * 3_000_000, "x"), (3, "x" * 3_000_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_cnn.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= g.score <= 1 for g in got)
    assert got[0].score == got[1].score and got[3].score == got[4].score
    assert {g.score for g in quality_cnn.classify(docs, labels.limit(0)).collect()}
    assert quality_cnn.classify(docs.limit(0), labels).count() == 0


def test_quality_parts_and_batches_agree():
    net = quality_cnn.ByteCnn().ready()
    r = random.Random(1)
    texts = ["".join(r.choice("ab c\n") for _ in range(n)).encode() for n in (0, 1, 7, 100, 5000)] + [b"Er " * 60]
    together = net.scores(texts)
    assert [round(x, 12) for x in together] == [round(float(net.scores([t])[0]), 12) for t in texts]
