import math
import random

import duckdb
import pytest

from loomline import queries
from loomline.operators import joins


def both(spark, folder, suppliers, customers):
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_acctbal double").repartition(2).write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").repartition(3).write.parquet(f"{folder}/customer.parquet")
    con = duckdb.connect()
    for name in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    order = lambda rows: sorted((tuple(repr(x) for x in r) for r in rows))
    return order(map(tuple, queries.QUERIES["best_match_join"](spark, str(folder)).collect())), order(con.execute(queries.SQL["best_match_join"]).fetchall())


@pytest.mark.parametrize("seed, few", [(1, 0), (2, 0), (2, 10**6)])
def test_against_sql(spark, tmp_path, monkeypatch, seed, few):
    """Close and distant numbers, halves of the last digit, copies, repeated and null keys, numbers on one side only."""
    monkeypatch.setattr(joins, "FEW_PAIRS", few)
    r = random.Random(seed)
    number = lambda: r.choice([r.randrange(-99999, 999999) / 100, r.randrange(-999, 9999) / 2, r.randrange(300) / 100, r.random() * 3, 5000.0, -0.0])
    suppliers = [(i, r.choice([0, 1, 2, 3, 9]), number()) for i in range(150)] + [(7, 1, 5000.0), (7, 2, 12.5), (8, 0, 4.0), (8, 0, 4.0), (None, 1, 5.0), (900, None, 5.0), (901, 1, None), (902, 4, 0.0), (903, 5, 1e9), (904, 4, 9000.0)]
    customers = [(i, r.choice([0, 1, 2, 3]), number()) for i in range(400)] + [(i, 4, 2800.0 + i % 7 / 4) for i in range(60)] + [(None, 1, 5.0), (901, None, 5.0), (902, 2, None), (903, 5, 1e9 + 3), (904, 5, 1e9 - 3.5)]
    got, want = both(spark, tmp_path, suppliers, customers)
    assert got == want and len(got) > 100


def test_numbers_beyond_cells(spark, tmp_path, monkeypatch):
    """Keys with infinite and very large numbers."""
    monkeypatch.setattr(joins, "FEW_PAIRS", 0)
    customers = [(1, 0, float("inf")), (2, 0, 10.0), (3, 0, 11.0), (4, 1, 1e15), (5, 1, 20.0), (6, 2, 30.0)]
    suppliers = [(1, 0, 10.0), (2, 1, 21.0), (3, 1, 1e15), (4, 2, 31.0), (1, 2, 29.0)]
    got, want = both(spark, tmp_path, suppliers, customers)
    assert got == want and len(got) == 4


def test_one_key(spark, tmp_path):
    """60,000 rows of one key on either side: 3.6 thousand million pairs, which are not formed."""
    rows = spark.range(60000).selectExpr("id", "id % 6000 * 1.5D AS x")
    rows.selectExpr("id AS s_suppkey", "1 AS s_nationkey", "x AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    rows.selectExpr("id AS c_custkey", "1 AS c_nationkey", "x AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.a: (r.b, r.score, r.candidates, r.status) for r in queries.QUERIES["best_match_join"](spark, str(tmp_path)).collect()}
    score = lambda gap: math.floor((1 - gap / 10000) * 1e4 + 0.5) / 1e4
    for a in range(0, 60000, 5711):
        close = sum(1 - score(abs(a % 6000 - b) * 1.5) <= 0.01 + 1e-12 for b in range(6000))
        assert got[a] == (a % 6000, 1.0, 10 * close, "ambiguous")
    assert len(got) == 60000
