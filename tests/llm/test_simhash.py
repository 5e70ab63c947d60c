import random

import pytest

pytest.importorskip("loomline.llm")
from loomline.llm import simhash as S
from loomline.llm.components import component_roots


def plain_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, close):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if close(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_rows_against_brute_force(spark):
    r = random.Random(1)
    base = [" ".join(r.choice(["Alpha", "beta", "été", "x"]) + str(r.randrange(30)) for _ in range(n)) for n in (1, 2, 3, 8, 40, 200) for _ in range(4)]
    texts = base + [t.upper() for t in base[:6]] + [t + " end" for t in base] + [None, "", " \n\t", "\xa0", base[0], base[5]]
    rows = [(i + 3, t, "x") for i, t in enumerate(texts)]
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    fps = {i: plain_fingerprint(t) for i, t, _ in rows}
    want = groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("dense", [64, 3])
def test_links_lose_nothing(spark, monkeypatch, dense):
    monkeypatch.setattr(S, "DENSE", dense)
    r = random.Random(2)
    fps = {0, -1, 1 << 63}
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(25):
            fps.add(f)
            f ^= 1 << r.randrange(64)
            if r.random() < 0.5:
                f ^= 1 << r.randrange(64)
    signed = sorted({f % 2**64 - (2**64 if f % 2**64 >= 2**63 else 0) for f in fps})
    edges = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {x.node: x.root for x in component_roots(edges).collect()}
    want = groups(signed, lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    assert {f: roots.get(f, f) for f in signed} == want


def test_long_chain_and_empty(spark):
    chain = spark.range(300).selectExpr("(id * 7919) % 301 a", "((id + 1) * 7919) % 301 b")
    assert {x.root for x in component_roots(chain).collect()} == {0}
    assert component_roots(chain.limit(0)).count() == 0
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(4, "a b c d", 1), (2, "A b  c d", 2), (9, None, 3), (11, "", 4), (20, "other words here now", 5)], "doc_id long, text string, n int")
    assert sorted(x.doc_id for x in S.keep_one(docs).collect()) == [2, 9, 20]


def test_one_stays_without_or_with_repeated_ids(spark):
    lone, named, first, second = "words of rows without any id", "a text that one row names", "the first text of four", "some second text of four and two"
    rows = [(None, lone), (None, lone.upper()), (None, lone), (7, named), (None, named), (4, first), (4, second), (2, second), (4, first), (9, None), (None, "")]
    got = [(x.doc_id, (x.text or "").lower()) for x in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted([(None, lone), (7, named), (4, first), (2, second), (9, "")], key=str)
    unrelated = [r for r in rows if r[0] != 4]
    got = [x.doc_id for x in S.keep_one(spark.createDataFrame(unrelated, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == [2, 7, 9, None]
