from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("loomline.llm")
from loomline.llm import quality_cnn as Q


def plain_marked(text):
    """Repetitions replaced, byte by byte."""
    padded = text + bytes(Q.GAP + Q.AGREE)
    out = list(padded)
    for i in range(len(padded) - Q.AGREE + 1):
        if any(i >= back and padded[i : i + Q.AGREE] == padded[i - back : i - back + Q.AGREE] for back in range(1, Q.BACK + 1)) and padded[i]:
            out[i] = Q.REPEAT
    return out


def plain_activations(net, text):
    """Filters at every chunk of a text, one multiplication at a time."""
    flat = plain_marked(text)
    size = (len(text) + Q.GAP + 1) // Q.STEP * Q.STEP
    out = []
    for a in range(0, size - Q.WIDTH + 1, Q.STEP):
        out.append([sum(net.p["embed"][flat[a + w]] @ net.p["kernel"][w, :, f] for w in range(Q.WIDTH)) for f in range(Q.FILTERS)])
    return np.array(out)


def plain_score(net, text):
    top = plain_activations(net, text).max(axis=0)
    z = np.maximum(top + net.p["bias"], 0) @ net.p["out"] + net.p["shift"][0]
    return 1 / (1 + np.exp(-z))


TEXTS = [b"", b"x", b"the quick brown fox", b"abc abc abc abc abc abc abc abc abc", bytes(range(1, 120)), "été ß 漢字".encode() * 4]


def test_scores_equal_a_plain_network():
    net = Q.ByteCnn(3)
    net.p["bias"] = np.linspace(-0.5, 0.5, Q.FILTERS)
    net.ready()
    assert np.allclose(net.scores(TEXTS), [plain_score(net, t) for t in TEXTS], atol=1e-4)


def test_gradients_equal_differences():
    net, y = Q.ByteCnn(5), np.array([0, 1, 1, 0, 1, 0.0])
    net.p["bias"] = np.full(Q.FILTERS, 0.3)
    loss = lambda: -sum(t * np.log(p) + (1 - t) * np.log(1 - p) for t, p in zip(y, (plain_score(net, x) for x in TEXTS))) / len(y)
    grads = net._gradients(TEXTS, y)
    r = np.random.default_rng(1)
    for name, value in net.p.items():
        steep = np.argsort(-np.abs(grads[name].ravel()))[:2].tolist() + [int(r.integers(value.size))]
        for i in steep:
            kept, step = value.flat[i], 1e-4
            value.flat[i] = kept + step
            up = loss()
            value.flat[i] = kept - step
            down = loss()
            value.flat[i] = kept
            assert abs((up - down) / (2 * step) - grads[name].flat[i]) < 2e-3 * max(1, abs(grads[name].flat[i]))


def test_training_is_bounded_by_bytes(spark):
    docs = [(i, ("good words " if i % 2 else "%%% ### ") * 200) for i in range(40)] + [(100 + i, "good words " * 40_000) for i in range(9)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    net = Q.train(docs, labels)
    low, high = net.scores([b"%%% ### " * 100, b"good words " * 100])
    assert low < 0.5 < high


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="no test data")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.op9_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
