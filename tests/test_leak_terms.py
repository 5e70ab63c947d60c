import duckdb
import pytest

from loomline import queries

LONG = "a passage of more than twenty characters"


@pytest.mark.parametrize("with_empty", [False, True])
def test_terms_of_any_length_at_any_place(spark, tmp_path, with_empty):
    items = [(1, "secre"), (2, LONG), (3, " led by a space, as long as others"), (4, "x"), (5, "twenty characters ab"), (6, "nowhere to be found"), (7, None), (8, LONG), (9, "été 𝄞"), (10, "two\nlines")]
    items += [(11, "")] * with_empty
    docs = [(1, "the secret"), (2, "mid" + LONG + "word"), (3, "and led by a space, as long as others"), (4, None), (5, ""), (None, "no id, secretly"), (6, "secre secre"), (6, "secre secre")]
    docs += [(6, "another " + LONG), (7, "un été 𝄞𝄞"), (8, "two\nlines"), (9, "y" * 4090 + LONG), (10, "y" * 8191 + "secret"), (11, "𝄞" * 4096 + LONG), (None, "no id, secretly")]
    spark.createDataFrame(items, "item_id long, text string").repartition(2).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(queries.SQL["leak_term_scan"]).fetchall()
    assert len(want) > 8
    assert sorted(map(tuple, queries.QUERIES["leak_term_scan"](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
