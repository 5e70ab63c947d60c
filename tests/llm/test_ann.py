from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loomline.llm")
from loomline.llm import ann as A


def brute(rows, queries, k=10):
    out = {}
    for q, v in queries:
        best = sorted((float(np.sqrt(((np.float64(v) - np.float64(x)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = best[:k]
    return out


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 64)).astype("float32")
    x[2000:2600] = x[0]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = A.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), F.col("vec_id") % 100 == 0).collect()
    want = brute(rows, [rows[i] for i in range(0, 3000, 100)])
    found = {}
    for g in got:
        found.setdefault(g.query_id, {})[g.rank] = (g.score, g.vec_id)
    assert set(found) == set(want)
    hits = 0
    for q, best in want.items():
        mine = [found[q][n] for n in range(1, 11)]
        assert mine == sorted(mine) and all(abs(s - np.linalg.norm(np.float64(x[q]) - np.float64(x[i]))) < 1e-12 for s, i in mine)
        hits += len({i for _, i in mine} & {i for _, i in best})
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, i in want[0]] == [found[0][n][1] for n in range(1, 11)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, nan, 0.0]), (4, [inf, 1.0, 0.0]), (5, [1.0, None, 0.0]), (6, [-3.0, 0.5, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (100, [5e-300, 0.0, 1e-300]), (200, [0.0, 0.0, 0.0]), (9, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = sorted((g.query_id, g.rank, g.vec_id) for g in A.search(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 7), (0, 2, 100), (0, 3, 6), (100, 1, 0), (100, 2, 7), (100, 3, 6)]
    assert A.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, A.search(df, F.col("vec_id") % 100 == 0).collect()))
    monkeypatch.setattr(A, "BLOCK", 7)
    assert sorted(map(tuple, A.search(df, F.col("vec_id") % 100 == 0).collect())) == one


@pytest.mark.parametrize("times", [2, 12])
def test_repeated_rows_count_once(spark, times):
    r = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(120, 8)))]
    df = spark.createDataFrame(rows * times, "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame(rows[:5], df.schema)
    group = [F.lit(0).alias("bucket"), F.lit(0).alias("block")]
    want = brute(rows, rows[:5])
    got = {}
    for g in A.nearest_within(queries.select("*", *group), df.select("*", *group), 10).collect():
        got.setdefault(g.query_id, []).append((g.score, g.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    once = sorted(map(tuple, A.search(spark.createDataFrame(rows, df.schema), F.col("vec_id") % 20 == 0).collect()))
    assert sorted(map(tuple, A.search(df, F.col("vec_id") % 20 == 0).collect())) == once
    assert len(once) == 6 * 10


def test_smallest_distance_of_a_vec_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [9.0, 0.0]), (1, [2.0, 0.0]), (2, [4.0, 0.0]), (1, [2.0, 0.0])] + [(3, [1.5, 0.0])] * 11
    got = A.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert sorted((g.rank, g.vec_id, g.score) for g in got) == [(1, 3, 0.5), (2, 1, 1.0), (3, 2, 3.0)]


def test_lengths_are_searched_apart(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 20)
    monkeypatch.setattr(A, "QUERIES", 7)
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=(8, 5, 1)[i % 3 if i % 10 else 0]).tolist()) for i in range(150)]
    got = {}
    for x in A.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), A.F.col("vec_id") % 2 == 0, 5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert set(got) == set(range(0, 150, 2))
    same = 0
    for q, found in got.items():
        mine = dict(rows)[q]
        all_ = sorted((float(np.linalg.norm(np.array(v) - np.array(mine))), i) for i, v in rows if i != q and len(v) == len(mine))
        assert [n for n, _, _ in sorted(found)] == list(range(1, 6)) and {i for _, i, _ in found} <= {i for _, i in all_}
        same += len({i for _, i, _ in found} & {i for _, i in all_[:5]})
    assert same >= 0.9 * 5 * len(got)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").is_dir(), reason="no test data")
def test_recall_on_the_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    vectors, ids = np.array(t["embedding"].to_pylist()), t["vec_id"].to_numpy()
    found = {}
    for x in A.op10_neighbours(spark, "/root/testdata/sf0.01").collect():
        found.setdefault(x.query_id, set()).add(x.vec_id)
    hits = 0
    for q, near in found.items():
        d = np.linalg.norm(vectors - vectors[ids == q][0], axis=1)
        d[ids == q] = np.inf
        hits += len(near & set(ids[np.argsort(d)[:10]].tolist()))
    assert len(found) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(found)
