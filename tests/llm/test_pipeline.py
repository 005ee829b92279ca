"""The pipeline's stages against the operators' own rules."""

import corpus_pipeline
from brickyard.llm import queries


def test_stages(spark, docs, rows, tmp_path):
    bench = spark.createDataFrame([(1, " ".join(rows[2][1].split()[:15]))], "item_id long, text string")
    bench.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    df, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = f"file://{tmp_path}/{name}"
        stage(spark, df, f"file://{tmp_path}").write.parquet(out)
        df = spark.read.parquet(out)
        counts.append(df.count())
        if name != "tokens":
            assert df.columns == docs.columns
        if name == "near_duplicates":
            ids = [r.doc_id for r in df.collect()]
            assert 407 in ids and ids.count(407) == 1 and not {100, 101, 102, 103, 200, 201, 202, 203} & set(ids) and {3, 5} <= set(ids)
        if name == "decontamination":
            assert " ".join(rows[2][1].split()[:15]) not in " ".join(next(r.text for r in df.collect() if r.doc_id == 2).split())
    assert counts[0] < len(rows) and counts[-1] == counts[-2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and set(queries.QUERIES) <= names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(entry.oracle_sql()) <= names


def test_near_duplicates_deal_no_texts_at_the_end(spark):
    """More rows in a task than a bitmap has, repeated rows in several tasks, columns named as the stage's own are."""
    rows = spark.range(0, 70_000, 1, 2).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text", "id % 7 AS task", "id AS bits", "id AS page")
    again = rows.filter("doc_id % 1000 = 999")
    texts = spark.createDataFrame([(100_000, "a b c d e f g", 0, 0, 0), (100_001, "a b c d e f g", 0, 0, 0), (None, "a b c d e f g", 0, 0, 0)], "doc_id long, text string, task long, bits long, page long")
    got = corpus_pipeline.near_duplicates(spark, rows.union(again).union(texts), "")
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    kept = [tuple(r) for r in got.collect()]
    assert got.columns == rows.columns
    assert sorted(kept, key=str) == sorted([(i, None, i % 7, i, i) for i in range(70_000)] + [(100_000, "a b c d e f g", 0, 0, 0), (None, "a b c d e f g", 0, 0, 0)], key=str)
