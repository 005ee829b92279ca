"""Mixing sources to target weights by Pareto order sampling.

Each source's share of all words is its weight's share, stopped at ``max_repeat`` times the
words the source has; what is stopped goes to the other sources by weight, until none is
above its stop.

Within a source, documents are wanted by unequal odds: a document of its size band (powers of two of
its words) has the merit 2^(-tilt * (band - the source's mean band)), at most 2^bound away from 1, so
with the default tilt shorter documents are drawn, and repeated, somewhat more than very long ones. Its
expected copies are merit times a factor, max_repeat at most, with one factor for the source at which
the expected words are the target. The whole part of the expected copies is taken for certain. The rest
is the inclusion probability p: documents are ranked by random odds u / (1 - u) over inclusion odds
p / (1 - p), and the lowest ranks are taken until the source's words are nearest to its target, so the
sample's size in words is fixed. u is a hash of the id and the seed, so reruns agree and the sample
doesn't depend on partitioning.

The rank cut is found without sorting a source in one task: ranks fall into bins (of rank / (1 + rank)),
words are summed by (source, bin), and only the one bin in which the cut falls is ordered, by (source,
bin). A source may hold any share of the rows; its documents are never collected together. All tables
that are joined to documents have a row a source, or one for each of its at most 64 size bands.

Defined results: a null or empty text has size 0 and no copies; a null source is a source of its own, last
in order; a null id is sampled like any other (all null ids share one u); rows that repeat an id, a source
and a size band share a rank and are taken together; a source without words gets target 0; an empty table
gives an empty result. ``mix`` keeps extra columns, whatever their names, and takes each row as often as
``mix_plan`` says.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.llm._shared import checkpointed

WEIGHTS = (5.0, 2.0, 1.0)
SALTS = 64
FEW = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with ``number``, from 0 by code point of the source, null last: in ranges, so no task has all sources."""
    ranged = checkpointed(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("n"))  # a row a range
    before = counts.select(F.col("__range"), (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    within = Window.partitionBy("__range").orderBy(F.col("source").asc_nulls_last())
    return ranged.join(before, "__range").withColumn("number", F.col("__before") + F.row_number().over(within) - 1).drop("__range", "__before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = 3.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Rounds over the source table: what is left is shared by weight, sources above their stop are stopped.
    A round sends one row to the driver.
    """
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    df = _numbered(sizes).withColumn("weight", F.get(pattern, F.pmod("number", F.lit(len(weights))).cast("int")))
    df = checkpointed(df.withColumn("stop", F.col("source_size") * F.lit(float(max_repeat))))
    total = float(df.agg(F.sum("source_size")).first()[0] or 0)
    level, n_stopped = None, -1
    while True:
        # A source is stopped for good: stopping others only raises the level for the rest.
        stopped = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("stop")
        n, taken, free = df.agg(F.count_if(stopped), F.sum(F.when(stopped, F.col("stop"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if n == n_stopped or not free:
            break
        n_stopped, level = n, (total - (taken or 0.0)) / free
    level = F.lit(float("inf") if level is None or not free else level)
    return df.select("source", "source_size", F.least("stop", level * F.col("weight")).alias("target"))


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _band(size: Column) -> Column:
    return F.when(size > 0, F.floor(F.log2(size.cast("double")))).otherwise(-1).cast("int")


def _chance(doc_id: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def _rank(u: Column, part: Column) -> Column:
    """Random odds over inclusion odds."""
    return F.when((part > 0) & (part < 1), (u / (1 - u)) / (part / (1 - part)))


def _odds(cells: DataFrame, weights, max_repeat: float, tilt: float, bound: float) -> DataFrame:
    """(source, band, words, docs) -> (source, band, source_size, target, whole, part): certain copies and inclusion probability."""
    by_source = Window.partitionBy("source")
    some = F.when(F.col("band") >= 0, F.col("docs"))
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"), (F.sum(some * F.col("band")) / F.sum(some)).alias("mean_band"))
    targets = _on_source(source_targets(sizes.select("source", "source_size"), weights, max_repeat), sizes.select("source", "mean_band"), "inner")
    df = _on_source(cells, targets, "inner")
    away = F.greatest(F.lit(-bound), F.least(F.lit(bound), (F.col("mean_band") - F.col("band")) * F.lit(tilt)))
    df = df.withColumn("merit", F.pow(F.lit(2.0), away))
    # Bands by falling merit reach max_repeat in that order; the factor is that of the first band that doesn't.
    order = by_source.orderBy(F.desc("merit"), "band")
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rest = F.col("target") - F.lit(float(max_repeat)) * F.coalesce(F.sum("words").over(before), F.lit(0))
    df = df.withColumn("factor", rest / F.nullif(F.sum(F.col("words") * F.col("merit")).over(onwards), F.lit(0.0)))
    fits = F.col("factor") * F.col("merit") <= F.lit(float(max_repeat))
    df = df.withColumn("factor", F.max_by(F.when(fits, F.col("factor")), F.when(fits, F.struct("merit", -F.col("band")))).over(by_source))
    copies = F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.coalesce(F.least(F.lit(float(max_repeat)), F.greatest(F.lit(0.0), F.col("factor") * F.col("merit"))), F.lit(float(max_repeat))))
    # Sums in floating point don't make a whole number of copies a chance of almost one.
    copies = F.when(F.abs(copies - F.rint(copies)) < 1e-9, F.rint(copies)).otherwise(copies)
    df = df.withColumn("__copies", copies).withColumn("whole", F.floor("__copies").cast("int"))
    return df.select("source", "band", "words", "source_size", "target", "whole", (F.col("__copies") - F.col("whole")).alias("part"))


def _tables(d: DataFrame, weights, max_repeat: float, bins: int, tilt: float, bound: float) -> tuple[DataFrame, DataFrame]:
    """(source, size, u) of all documents -> odds (source, band, ...) and cuts (source, cut_rank): who is taken once more."""
    cells = checkpointed(d.groupBy("source", "band").agg(F.sum("size").alias("words"), F.count("*").alias("docs")))
    odds = checkpointed(_odds(cells, weights, max_repeat, tilt, bound))
    lots = odds.groupBy("source").agg(F.min("target").alias("goal"), F.sum(F.col("words") * F.col("whole")).alias("certain"))
    lots = lots.select("source", (F.col("goal") - F.col("certain")).alias("lot"))
    rows = _on_source(d.filter("size > 0"), odds.select("source", "band", "part"), "inner", SALTS, "band").withColumn("rank", _rank(F.col("u"), F.col("part"))).filter("rank is not null")
    rows = rows.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * bins).cast("int")).select("source", "size", "rank", "bin")
    binned = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bin")
    binned = _on_source(binned, lots, "inner").withColumn("until", F.sum("words").over(running)).withColumn("from", F.col("until") - F.col("words"))
    # The bin in which the lot is filled; where it never is, all are taken.
    cut = binned.filter((F.col("from") <= F.col("lot")) & (F.col("until") > F.col("lot"))).groupBy("source").agg(F.min("bin").alias("bin"), F.min_by("from", "bin").alias("from"), F.min("lot").alias("lot"))
    # That bin alone is ordered: rows that share a rank are one step.
    inside = _on_source(rows, cut, "inner", SALTS, "bin").groupBy("source", "bin", "rank", "from", "lot").agg(F.sum("size").alias("step"))
    ordered = Window.partitionBy("source", "bin").orderBy("rank")
    inside = inside.withColumn("until", F.col("from") + F.sum("step").over(ordered))
    nearer = F.col("until") - F.col("lot") <= F.col("lot") - (F.col("until") - F.col("step"))
    last = inside.filter((F.col("until") <= F.col("lot")) | nearer).groupBy("source").agg(F.max("rank").alias("in_bin"))
    edge = (F.col("bin") / F.lit(bins)) / (1 - F.col("bin") / F.lit(bins))  # the least rank of the bin
    cuts = _on_source(cut.select("source", edge.alias("edge")), last, "left").select("source", F.coalesce("in_bin", "edge").alias("cut_rank"), F.col("in_bin").isNotNull().alias("closed"))
    return odds, checkpointed(cuts)


def _taken(df: DataFrame, odds: DataFrame, cuts: DataFrame) -> DataFrame:
    """df (source, band, u) with source_size, target, rank and copies."""
    df = _on_source(df, odds.select("source", "band", "source_size", "target", "whole", "part"), "left", SALTS, "band")
    df = _on_source(df.withColumn("rank", _rank(F.col("u"), F.col("part"))), cuts, "left", SALTS)
    more = F.when(F.col("cut_rank").isNull(), F.col("rank").isNotNull()).otherwise(F.coalesce(F.when(F.col("closed"), F.col("rank") <= F.col("cut_rank")).otherwise(F.col("rank") < F.col("cut_rank")), F.lit(False)))
    return df.withColumn("copies", F.coalesce("whole", F.lit(0)) + F.when(more, 1).otherwise(0))


def _on_source(left: DataFrame, right: DataFrame, how: str, salts: int = 1, *also: str) -> DataFrame:
    """Null-safe join on source (and ``also``); the right side is broadcast only if it has few rows.

    Documents are joined by salted source otherwise, so that a hot source is dealt to many tasks.
    """
    r = right.withColumnRenamed("source", "__source").withColumnsRenamed({c: f"__{c}" for c in also}).drop(*[c for c in right.columns if c in left.columns and c != "source" and c not in also])
    few = salts > 1 and right.count() <= FEW
    same = [F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")), *also) == F.struct(F.col("__source").isNull(), F.coalesce("__source", F.lit("")), *[f"__{c}" for c in also])]
    if few:
        r = F.broadcast(r)
    elif salts > 1:
        left = left.withColumn("__salt", F.pmod(F.hash("u"), F.lit(salts)) if "u" in left.columns else F.pmod(F.hash("rank"), F.lit(salts)))
        r = r.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        same.append(F.col("__salt") == F.col("__at"))
    return left.join(r, same, how).drop("__source", "__salt", "__at", *[f"__{c}" for c in also])


def mix_plan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: float = 3.0, seed: int = 17, bins: int = 4096, tilt: float = 0.25, bound: float = 1.0
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, rank, copies, taken."""
    d = checkpointed(_sized(docs, doc_id, text, source, seed))
    done = _taken(d, *_tables(d, weights, max_repeat, bins, tilt, bound))
    return done.select("doc_id", "source", "size", "source_size", "target", "rank", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """doc_id, source, size, band, u of docs, in that order."""
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), _words(F.col(f"`{text}`")).alias("size"))
    return d.withColumn("band", _band(F.col("size"))).withColumn("u", _chance(F.col("doc_id"), seed))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeat: float = 3.0, seed: int = 17, bins: int = 4096, tilt: float = 0.25, bound: float = 1.0
) -> DataFrame:
    """The sample itself: rows of docs with their columns, each repeated as often as it is taken.

    The tables of odds and cuts come to the rows; texts are shuffled only if there are more than FEW
    (source, band) pairs.
    """
    d = checkpointed(_sized(docs, doc_id, text, source, seed))
    odds, cuts = _tables(d, weights, max_repeat, bins, tilt, bound)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole).select("row", F.col("row").getField(doc_id).alias("doc_id"), F.col("row").getField(source).alias("source"), _words(F.col("row").getField(text)).alias("size"))
    rows = rows.withColumn("band", _band(F.col("size"))).withColumn("u", _chance(F.col("doc_id"), seed)).drop("doc_id", "size")
    taken = _taken(rows, odds, cuts).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
