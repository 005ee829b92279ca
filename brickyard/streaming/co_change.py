"""Co-change over a stream of commits: pairs of bricks in the same commit, counted in event-time windows."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.sources import git


def commit_stream(spark: SparkSession, root: str, starting: str | None = None) -> DataFrame:
    """ts, paths: the commits of a repository as they come, after ``starting`` if that is given."""
    read = git.register(spark).readStream.format("gitlog").option("byCommit", "true")
    read = read.option("startingCommit", starting) if starting else read
    return read.load(os.path.abspath(root)).select(F.col("at").alias("ts"), "paths")


def co_change_windows(commits: DataFrame, window: str = "30 days", late: str = "1 day", most: int = 5) -> DataFrame:
    """Streaming or batch commits(ts, paths ARRAY<STRING>) -> window, a, b, shared.

    A commit arrives whole, so its bricks (the first two parts of its paths) are found within its row and only one
    aggregation holds state, bounded by the watermark. Commits of more than ``most`` bricks are left out.
    """
    brick = F.transform("paths", lambda p: F.regexp_extract(p, r"^[^/]+/([^/]+)/", 1))
    bricks = F.array_sort(F.array_distinct(F.filter(brick, lambda b: b != "")))
    rows = commits.withWatermark("ts", late).select("ts", bricks.alias("bricks")).filter(F.size("bricks").between(2, most))
    pairs = F.flatten(F.transform("bricks", lambda a: F.transform(F.filter("bricks", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = rows.select("ts", F.explode(pairs).alias("p"))
    return rows.groupBy(F.window("ts", window), F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("shared"))
