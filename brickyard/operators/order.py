"""Positions in a global order, without a task that sees all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.session import kept


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """df with each row's position (long, from ``start``) in the given order, which should leave no ties.

    Rows are dealt by ranges of the order and sorted within them; a row's position is its place in its range and the sizes of
    the ranges before. Only those sizes, one a range, meet in one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The id that Spark gives rows has the partition in its upper bits and the place in it below.
    placed = kept(dealt.withColumn("_id", F.monotonically_increasing_id()).withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    joined = placed.join(F.broadcast(before), "_range")  # as many rows as ranges
    return joined.withColumn(name, F.col("_before") + F.col("_place") + start).drop("_id", "_range", "_place", "_before")
