"""The queries against their SQL over the smallest tables."""

import os

import pytest

from brickyard.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(queries.ORACLES[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(want.select(*[f'"{c}"' for c in cols]).fetchall(), key=key)


def test_line_sql_counts_rows(spark, rows, tmp_path):
    """Repeated and null ids: a row is a document on both sides."""
    import collections

    import duckdb

    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    found = queries.QUERIES["op8_line_dedup"](spark, f"file://{tmp_path}").select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = db.sql(queries.ORACLES["op8_line_dedup"]).select("doc_id", "n_lines", "n_dropped", "kept_sha256").fetchall()
    assert collections.Counter(map(tuple, found)) == collections.Counter(wanted)
