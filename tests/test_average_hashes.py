import random

import duckdb

from loomline import queries


def test_halves_and_missing_components(spark, tmp_path):
    """Grey values that are halves in 32 bits, though not in 64, are rounded as the SQL rounds them."""
    r = random.Random(6)
    rows = [(i, [(r.randrange(60, 190) + 0.5 - 128) / 400 if k < 20 else r.gauss(0, 1) / 8 for k in range(64)]) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [0.1] * 5), (1003, [0.1, 0.2] * 40), (1004, [None] * 64), (1005, [0.1] * 60 + [None, 0.2, 0.1, 0.3])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(queries.SQL["average_hashes"]).fetchall()
    assert len(want) == 406
    assert sorted(map(tuple, queries.QUERIES["average_hashes"](spark, str(tmp_path)).collect())) == sorted(want)
