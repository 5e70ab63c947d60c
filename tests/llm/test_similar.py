import random

import pytest

pytest.importorskip("loomline.llm")
from loomline.llm import similar as S


def plain_set(text):
    """Shingles as tuples of words; A-Z in lower case, white space of ASCII."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The documents that stay, one after the other in order."""
    kept = []
    for i, text in rows:
        mine = plain_set(text)
        if not any(mine == x or mine and x and 5 * len(mine & x) >= 4 * len(mine | x) for _, x in kept):
            kept.append((i, mine))
    return [i for i, _ in kept]


def corpus(r, n):
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    some = lambda k: [word() for _ in range(k)]
    passage, texts = some(60), []
    for _ in range(n):
        base = some(r.choice([1, 3, 5, 8, 30, 80, 200]))
        if r.random() < 0.4:
            base = base[: len(base) // 3] + passage + base[len(base) // 3 :]
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 4])):
            copy = list(r.choice(texts[-5:]))
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = word()
            texts.append(copy)
    texts += [[*passage[:40], word()] for _ in range(12)]
    r.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, often, rounds", [(1, 8, 3), (2, 1, 0), (3, 1, 1)])
def test_against_brute_force(spark, monkeypatch, seed, often, rounds):
    monkeypatch.setattr(S, "OFTEN", often)
    monkeypatch.setattr(S, "ROUNDS", rounds)
    monkeypatch.setattr(S, "SAMPLE", 8 if often > 1 else 2)
    if seed == 2:
        monkeypatch.setattr(S, "BROADCAST_NODES", 5)
        monkeypatch.setattr(S, "BROADCAST_ENTRIES", 5)
    rows = corpus(random.Random(seed), 90)
    rows += [(len(rows), None), (len(rows) + 1, " \n"), (len(rows) + 2, rows[7][1].upper()), (len(rows) + 3, rows[8][1].replace(" ", "\n  "))]
    got = sorted(x.doc_id for x in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    want = plain_kept(rows)
    assert got == want and len(want) < len(rows) - 20


def test_a_large_group(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(400):
        copy = list(base)
        for _ in range(r.randrange(4)):
            copy[r.randrange(120)] = word()
        rows.append((i, " ".join(copy)))
    got = sorted(x.doc_id for x in S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain_kept(rows)


def test_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2.0), (2, "A  B", "y", 3.0), (None, "c", "z", 4.0)], "doc_id long, text string, node string, entry double")
    assert sorted(map(tuple, S.keep_one(df).collect()), key=str) == [(1, "a b", "x", 2.0), (None, "c", "z", 4.0)]
    assert S.keep_one(df.limit(0)).columns == df.columns and S.keep_one(df.limit(0)).count() == 0


def test_fingerprints_come_first(spark):
    """Nodes whose fingerprints differ in up to 8 - MATCH bits meet through positional bytes; near copies go by fingerprints before lists of shingles are paired."""
    r = random.Random(5)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [r.getrandbits(64) for _ in range(40)]
    copies = [base[i % 40] ^ sum(1 << b for b in r.sample(range(64), i % 6)) for i in range(400)]
    prints = spark.createDataFrame([(f"a{i:03}".encode(), signed(x)) for i, x in enumerate(base)] + [(f"b{i:03}".encode(), signed(x)) for i, x in enumerate(copies)], "node binary, fp long")
    some = lambda kind: prints.where(f"node like '{kind}%'").select("node")
    got = {(bytes(x.a), bytes(x.b)) for x in S.by_fingerprints(prints, some("a"), some("b")).collect()}
    assert {(f"a{i % 40:03}".encode(), f"b{i:03}".encode()) for i in range(400)} <= got
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(20):
        text = [word() for _ in range(300)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:-1], word()]))]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select(S.node(S.F.col("doc_id"), S.F.col("text")).alias("node"), "text")
    first = S.similar_to_others(texts)[0]
    assert first.count() >= 15 and plain_kept(rows) == list(range(0, 40, 2))
