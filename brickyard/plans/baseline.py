"""Comparison of a head report with a base report: what is new, existing, indirect or resolved."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.operators import paths
from brickyard.plans.registry import METRICS


def changed_bricks(bricks: DataFrame, changed: DataFrame) -> DataFrame:
    """bricks(brick, dir) with a changed file under dir/src/; changed(path)."""
    return paths.under(changed, bricks, "src")


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Null-safe join on what identifies a violation; lines move, subjects don't."""
    r = right.select(*[F.col(c).alias(f"_{c}") for c in ("brick", "metric", "subject")]).distinct()
    on = (F.col("brick") == F.col("_brick")) & (F.col("metric") == F.col("_metric")) & F.col("subject").eqNullSafe(F.col("_subject"))
    return left.join(r.hint("merge"), on, how)


def compare(head: DataFrame, base: DataFrame, changed: DataFrame, base_values: DataFrame, base_functions: DataFrame) -> DataFrame:
    """head violations with status and base_value.

    base_values(brick, metric, value) and base_functions(brick, id and measures) are the base's; changed(brick).
    A function made worse is new, and its message says what it was. Tables with a row a function or violation are never broadcast: the
    optimizer reckons their size by the file they come from, before rows are made of its columns.
    """
    f = base_functions.select("brick", "id", F.explode(F.array(*[F.struct(F.lit(m.key).alias("metric"), F.col(m.measure).cast("double").alias("value")) for m in METRICS.values() if m.kind == "function"])).alias("x"))
    f = f.select(F.col("brick").alias("_b"), F.col("x.metric").alias("_m"), F.col("id").alias("_s"), F.col("x.value").alias("_fv")).dropDuplicates(["_b", "_m", "_s"])
    b = base_values.select(F.col("brick").alias("_vb"), F.col("metric").alias("_vm"), F.col("value").alias("_bv"))
    known = _same(head.select("brick", "metric", "subject").distinct(), base, "left_semi").withColumns({"_kb": F.col("brick"), "_km": F.col("metric"), "_ks": F.col("subject"), "_known": F.lit(True)}).select("_kb", "_km", "_ks", "_known")
    v = head.join(f.hint("merge"), (F.col("kind") == "function") & (F.col("brick") == F.col("_b")) & (F.col("metric") == F.col("_m")) & (F.col("subject") == F.col("_s")), "left")
    v = v.join(b, (F.col("kind") == "brick") & (F.col("brick") == F.col("_vb")) & (F.col("metric") == F.col("_vm")), "left")
    v = v.join(known.hint("merge"), (F.col("brick") == F.col("_kb")) & (F.col("metric") == F.col("_km")) & F.col("subject").eqNullSafe(F.col("_ks")), "left")
    v = v.join(changed.select(F.col("brick").alias("_c")).distinct(), F.col("brick") == F.col("_c"), "left")
    was = F.coalesce("_fv", "_bv")
    worse = F.coalesce((F.col("kind") == "function") & F.when(F.col("direction") == "max", F.col("value") > F.col("_fv")).otherwise(F.col("value") < F.col("_fv")), F.lit(False))
    status = F.when(F.coalesce("historical", F.lit(False)), "existing").when(worse, "new").when(F.col("_known"), "existing").when(F.col("_c").isNotNull(), "new").otherwise("indirect")
    shown = F.when(was == F.rint(was), was.cast("long").cast("string")).otherwise(F.format_string("%.1f", was))
    message = F.when(worse, F.concat("message", F.lit(" (was "), shown, F.lit(")"))).otherwise(F.col("message"))
    return v.select(*[message.alias(c) if c == "message" else F.col(c) for c in head.columns], status.alias("status"), was.alias("base_value"))


def resolved(base: DataFrame, head: DataFrame) -> DataFrame:
    return _same(base, head, "left_anti")


def new_edges(head: DataFrame, base: DataFrame) -> DataFrame:
    """head edges with is_new where the base has none between the two."""
    b = base.select(F.col("from").alias("_f"), F.col("to").alias("_t")).distinct().withColumn("_old", F.lit(True))
    joined = head.join(b, (F.col("from") == F.col("_f")) & (F.col("to") == F.col("_t")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in head.columns], F.col("_old").isNull().alias("is_new"))
