"""Statistics over long metric tables (metric, brick, value)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.session import kept


def leave_one_out(values: DataFrame) -> DataFrame:
    """values(metric, brick, value) with mean, std_dev and peers of the other bricks' values of the metric.

    One row a metric goes to its values: sums about the metric's mean, which lose no digits to its size, and the
    least and greatest values, the first two of each, which tell whether all the others are equal: their deviation must come
    out as exactly 0, and their mean as that value.
    """
    values = kept(values)  # it is read four times
    centres = values.groupBy("metric").agg(F.avg("value").alias("_centre"))
    apart = values.join(centres, "metric").withColumn("_off", F.col("value") - F.col("_centre"))
    ends = apart.groupBy("metric").agg(
        F.count("value").alias("_n"), F.sum("value").alias("_total"), F.sum("_off").alias("_sum"), F.sum(F.col("_off") * F.col("_off")).alias("_squares"),
        F.min("value").alias("_low"), F.max("value").alias("_high"), F.first("_centre").alias("_centre"),
    )
    above, below = F.when(F.col("value") > F.col("_low"), F.col("value")), F.when(F.col("value") < F.col("_high"), F.col("value"))
    at_ends = values.join(ends.select("metric", "_low", "_high"), "metric").groupBy("metric").agg(
        F.count_if(F.col("value") == F.col("_low")).alias("_n_low"), F.count_if(F.col("value") == F.col("_high")).alias("_n_high"),
        F.min(above).alias("_low2"), F.max(below).alias("_high2"), F.avg(above).alias("_mean_above"), F.avg(below).alias("_mean_below"), F.stddev_samp(above).alias("_dev_above"), F.stddev_samp(below).alias("_dev_below"),
    )
    v = values.join(ends.join(at_ends, "metric"), "metric", "left")
    known = F.col("value").isNotNull()
    v = v.withColumn("_off", F.coalesce(F.col("value") - F.col("_centre"), F.lit(0.0)))
    v = v.withColumn("peers", F.coalesce(F.col("_n") - known.cast("int"), F.lit(0)))
    v = v.withColumns({"_is_low": known & (F.col("value") == F.col("_low")) & (F.col("_n_low") == 1), "_is_high": known & (F.col("value") == F.col("_high")) & (F.col("_n_high") == 1)})
    low, high = F.when(F.col("_is_low"), F.col("_low2")).otherwise(F.col("_low")), F.when(F.col("_is_high"), F.col("_high2")).otherwise(F.col("_high"))
    v = v.withColumns({"_l": low, "_h": high}).withColumn("_off_mean", (F.col("_sum") - F.col("_off")) / F.nullif(F.col("peers"), F.lit(0)))
    equal = F.col("_l") == F.col("_h")
    squares = F.col("_squares") - F.col("_off") * F.col("_off") - F.col("peers") * F.col("_off_mean") * F.col("_off_mean")
    # Where a lone end is taken away, what is left can be too small beside it to be found by subtraction.
    mean = F.when(equal, F.col("_l")).when(F.col("_is_low"), F.col("_mean_above")).when(F.col("_is_high"), F.col("_mean_below")).otherwise((F.col("_total") - F.coalesce("value", F.lit(0.0))) / F.nullif(F.col("peers"), F.lit(0)))
    deviation = F.when(F.col("peers") > 1, F.when(equal, F.lit(0.0)).when(F.col("_is_low"), F.col("_dev_above")).when(F.col("_is_high"), F.col("_dev_below")).otherwise(F.sqrt(F.greatest(squares, F.lit(0.0)) / (F.col("peers") - 1))))
    return v.withColumns({"mean": F.when(F.col("peers") > 0, mean), "std_dev": deviation}).select(*values.columns, "mean", "std_dev", "peers")


def outliers(values: DataFrame, directions: DataFrame, std_devs: float = 2.0, least: int = 4) -> DataFrame:
    """values and directions(metric, direction) -> metric, brick, value, z, mean, std_dev of values at least so many
    deviations past the others' mean, for metrics with enough values."""
    facts = leave_one_out(values).filter((F.col("peers") >= least - 1) & (F.col("std_dev") > 0))
    facts = facts.withColumn("z", (F.col("value") - F.col("mean")) / F.col("std_dev")).join(F.broadcast(directions), "metric")
    return facts.filter(F.when(F.col("direction") == "max", F.col("z")).otherwise(-F.col("z")) >= std_devs).select("metric", "brick", "value", "z", "mean", "std_dev", "peers")


def with_average(values: DataFrame) -> DataFrame:
    """values(metric, brick, value) and a row with a null brick for each metric's average, in one pass."""
    return values.groupingSets([["metric", "brick"], ["metric"]], "metric", "brick").agg(F.avg("value").alias("value"))


def means(df: DataFrame, key: str, measures: dict) -> DataFrame:
    """The means of measures for each key, and in a row with a null key over all rows, with n rows each; one pass."""
    rows = df.select(key, *[m.alias(name) for name, m in measures.items()])
    return rows.groupingSets([[key], []], key).agg(*[F.avg(name).alias(name) for name in measures], F.count("*").alias("n"))


def share(df: DataFrame, key: list[str], part, out: str) -> DataFrame:
    """The share of each key's rows for which ``part`` holds; null keys' shares can't be."""
    return df.groupBy(*key).agg(F.try_divide(F.count_if(part).cast("double"), F.count("*")).alias(out))
