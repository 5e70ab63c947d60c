import hashlib
import random
import re

import pytest

pytest.importorskip("loomline.llm")
from loomline.llm import decontaminate as D


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for item, b in items:
            b = words(b)
            n = min(10, len(b))
            for s in range(len(b) - n + 1) if b else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(item))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [10**6, 0])
def test_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
    r = random.Random(3)
    some = lambda n: " ".join(r.choice(["The", "of", "é", "x1", "zz"]) for _ in range(n))
    items = [(n, some(n)) for n in (0, 1, 3, 9, 10, 11, 14, 30)] + [(100, None), (14, some(14)), (7, "the the the the the the the the the the the the")]
    docs = [(i, some(r.choice([0, 1, 5, 9, 10, 12, 60]))) for i in range(25)] + [(50, None), (51, ""), (52, "the " * 40), (None, items[7][1]), (53, items[6][1].upper() + "!"), (53, items[6][1].upper() + "!")]
    docs += [(60 + k, some(8) + "-" + items[7][1].replace(" ", ",\n") + " " + some(3)) for k in range(3)] + [(70, "É " * 12)]
    items = [x for x in items if x[0] != 1 or words(x[1]) != ["the"]]
    got = D.contamination(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_hit string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    nothing = D.contamination(docs, items.limit(0)).collect()
    assert [(x.n_words, x.n_hit, x.contaminated) for x in nothing] == [(2, 0, False)]
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.keep_clean(docs, items).count() == 0 and D.keep_clean(docs, items.limit(0)).count() == 1
