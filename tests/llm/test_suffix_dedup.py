import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("loomline.llm")
from loomline.llm import suffix_dedup as S


def brute(rows, length=400):
    places = {}
    for d, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            places.setdefault(hashlib.md5(b[i : i + length]).digest(), []).append((d, i))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + length] = True
    out = []
    for (i, t), g in zip(rows, gone):
        b = np.frombuffer((t or "").encode(), np.uint8)
        runs = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()) if len(g) else 0
        out.append((i, len(b), int(g.sum()), runs, hashlib.sha256(b[~g].tobytes()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    some = lambda n, a="abcdé ": "".join(r.choice(a) for _ in range(n))
    passage, long = some(700), some(3000)
    texts = [None, "", "short", some(399), some(400), some(5000), long, long, long[:1500] + "X" + long[1501:], long[200:900], "q" + long[200:900]]
    texts += [some(r.randrange(50, 600)) + passage[r.randrange(150) : r.randrange(560, 700)] + some(300) for _ in range(12)]
    texts += [some(300) + passage[:397] + some(50), "ab " * 400, "ab " * 134, ("xyz" * 200)[:402], ("zxy" * 200)[:401], some(100) + "a" * 401 + some(30), "a" * 400]
    texts += [some(2500, "ab") + passage + some(10) + passage, long.replace("a", "a", 1)[::-1], long[:800] * 3]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(0, None), (18, long), (None, passage)]


@pytest.mark.parametrize("broadcast, bucket", [(1 << 20, 400_000), (0, 150), (0, 5)])
def test_against_brute_force(spark, monkeypatch, broadcast, bucket):
    monkeypatch.setattr(S, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(S, "BUCKET", bucket)
    rows = corpus()
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, n_spans string").repartition(3)
    got = S.remove_repeats(df).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("letters", [b"a", b"ab", b"\0a\xff"])
def test_multikey_order(letters):
    r = random.Random(1)
    strings = [bytes(r.choice(letters) for _ in range(r.choice([0, 3, 8, 24, 24]))) for _ in range(300)]
    strings += [s[: r.randrange(25)] + bytes(r.choice(letters) for _ in range(3)) for s in strings]
    filled = [s[:24].ljust(24, b"\0") for s in strings]
    order, lengths = S.multikey(S.as_words(filled, 24))
    assert [filled[i] for i in order] == sorted(filled) and sorted(order.tolist()) == list(range(len(filled)))
    assert lengths.tolist() == [0] + [shared(filled[i], filled[j]) for i, j in zip(order, order[1:])]


def test_windows_of_a_bucket():
    r = random.Random(3)
    core = bytes(r.choice(b"abc") for _ in range(700))
    n, at, left, right = [], [], [], []
    for _ in range(60):  # an anchor at 300 of the core, what surrounds it equal for some way
        a, b = r.randrange(0, 273), r.randrange(128, 400)
        x, y = bytes(r.choice(b"ab") for _ in range(400)), bytes(r.choice(b"ab") for _ in range(400))
        before, after = (x + core[300 - a : 300])[-272:], (core[300 : 300 + b] + y)[:400]
        m, k = sorted((r.randrange(273), r.randrange(273)))
        left.append(before[272 - k :])
        right.append(after[: 400 - m])
        at.append(k)
        n.append(k - m + 1)
    active = np.array([[k - m < o <= k for o in range(273)] for k, m in zip(at, n)])
    window = lambda i, o: left[i][len(left[i]) - o :] + right[i][: 400 - o]
    for by_suffix in (True, False):
        hit, edge = S.compared([x[::-1] for x in left], right, active, by_suffix)
        for o in range(273):
            for i in range(60):
                assert hit[i, o] == (active[i, o] and any(window(i, o) == window(j, o) for j in np.flatnonzero(active[:, o]) if j != i))
        assert edge.any() and not (edge & ~active).any()


def test_sql_gives_the_rows(spark, tmp_path):
    import duckdb

    rows = [r for r in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.sql(S.ORACLE_SQL).fetchall()
    assert sorted((tuple(g[:5]) for g in got), key=str) == brute(rows)
    assert sorted(map(str, got)) == sorted(str(tuple(x)) for x in S.op4_suffix_dedup(spark, str(tmp_path)).collect())


def test_chunks_of_a_long_text_agree(monkeypatch):
    r = np.random.default_rng(2)
    text = bytes(r.integers(97, 100, 6000).astype(np.uint8))
    whole = [np.concatenate(x) for x in zip(*S.segments([text]))]
    monkeypatch.setattr(S, "CHUNK", 1000)
    parts = [np.concatenate(x) for x in zip(*S.segments([text]))]
    anchors = lambda x: {int(a) + i: (int(a) + int(at), int(h)) for a, n, at, h in zip(x[1], x[2], x[3], x[4]) for i in range(n)}
    assert anchors(whole) == anchors(parts) and len(anchors(whole)) == 5601
