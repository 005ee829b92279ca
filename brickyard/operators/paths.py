"""Paths and the folders they lie in, as equi-joins on path prefixes; folders may be of any depth, and nested."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folders(path: Column) -> Column:
    """All folders above a path: for a/b/c.txt a and a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def owners(paths: DataFrame, bricks: DataFrame) -> DataFrame:
    """paths(path, ...) in the folder of a brick(brick, dir, ord), with brick: the first in order of those that have it."""
    key = [c for c in paths.columns]
    inside = paths.filter(F.col("path").contains("/")).withColumn("_dir", F.explode(folders(F.col("path"))))
    hit = inside.join(bricks.select("brick", F.col("dir").alias("_dir"), F.col("ord").alias("_ord")), "_dir")
    return hit.groupBy(*key).agg(F.min_by("brick", "_ord").alias("brick"))


def under(paths: DataFrame, bricks: DataFrame, part: str) -> DataFrame:
    """bricks(brick, dir) with a path below their folder's ``part``: all of them, also where folders are nested."""
    split = F.split("path", "/")
    cuts = F.filter(F.sequence(F.lit(2), F.size(split) - 1), lambda i: F.element_at(split, i) == part)
    tops = F.transform(cuts, lambda i: F.array_join(F.slice(split, F.lit(1), i - 1), "/"))
    found = paths.filter(F.size(split) > 2).select(F.explode(tops).alias("dir")).distinct()
    return bricks.join(found, "dir", "left_semi").select("brick").distinct()
