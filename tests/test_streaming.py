import datetime

from brickyard.streaming.co_change import co_change_windows


def test_stream_counts_pairs_like_a_batch(spark, tmp_path):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [(day(0), ["components/a/src/x", "components/b/src/y"]), (day(1), ["components/b/z", "bases/a/q", "README"]), (day(2), ["components/a/x"]), (day(40), ["components/a/x", "components/c/y"]), (day(41), [f"components/{c}/x" for c in "abcdef"])]
    schema = "ts timestamp, paths array<string>"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(f"file://{tmp_path}/in")
    stream = co_change_windows(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("co_changes").option("checkpointLocation", f"file://{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.a, r.b, r.shared) for r in spark.table("co_changes").collect())
    assert got == sorted((r.a, r.b, r.shared) for r in co_change_windows(df).collect()) == [("a", "b", 2), ("a", "c", 1)]
