"""Operators on names, libraries, keywords and repeated fragments."""

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Namespaces that belong to the language itself.
PURE_NAMESPACES = (
    "clojure.core clojure.core.protocols clojure.core.reducers clojure.core.server clojure.core.specs.alpha clojure.data clojure.datafy clojure.edn "
    "clojure.instant clojure.main clojure.math clojure.pprint clojure.reflect clojure.repl clojure.set clojure.spec.alpha clojure.spec.gen.alpha "
    "clojure.spec.test.alpha clojure.stacktrace clojure.string clojure.template clojure.test clojure.uuid clojure.walk clojure.xml clojure.zip "
    "cljs.core cljs.math cljs.pprint cljs.reader cljs.repl cljs.spec.alpha cljs.spec.gen.alpha cljs.spec.test.alpha cljs.stacktrace cljs.test"
).split()
# How many segments name a library under these first segments.
SEGMENTS = {"clojure": 3, "cljs": 3, "babashka": 2, "cognitect": 2}
DOMAINS = "com org io net dev systems me ai app co tech info biz xyz us uk de fr nl se no fi dk ch at be eu es it pl cz ca au nz jp br in".split()


def is_external(target: Column, is_js: Column, top: str | None) -> Column:
    """True of a library outside the workspace and the language."""
    own = F.lit(False) if top is None else (target == top) | target.startswith(f"{top}.")
    return is_js | ~(own | target.isin(PURE_NAMESPACES) | (target == "goog") | target.startswith("goog."))


def segment(ns: Column, top: str | None) -> Column:
    """The first part of a workspace namespace after the top one; null for others, or without a top namespace."""
    if top is None:
        return F.lit(None).cast("string")
    rest = F.substring(ns, len(top) + 2, 1_000_000)
    return F.when(ns.startswith(f"{top}."), F.split_part(rest, F.lit("."), F.lit(1)))


def is_interface(ns: Column, top: str | None, seg: Column, interface: str) -> Column:
    name = F.concat(F.lit(f"{top}." if top else ""), seg, F.lit(f".{interface}"))
    return F.coalesce((ns == name) | ns.startswith(F.concat(name, F.lit("."))), F.lit(False))


def npm_package(module: Column) -> Column:
    parts = F.split(module, "/")
    return F.array_join(F.slice(parts, 1, F.when(module.startswith("@"), 2).otherwise(1)), "/")


def library_key(target: Column, is_js: Column) -> Column:
    """What a required namespace or module is grouped by."""
    parts = F.split(target, r"\.")
    first = parts[0]
    n = F.when(first.isin(DOMAINS), 3).otherwise(1)
    for name, k in SEGMENTS.items():
        n = F.when(first == name, k).otherwise(n)
    return F.when(is_js, npm_package(target)).otherwise(F.array_join(F.slice(parts, 1, n), "."))


def common_prefix(least: Column, greatest: Column) -> Column:
    """The segments two dotted names share from the start. The shared start of a set of names is that of its
    least and greatest in segment order, so a group needs only min and max of its segment arrays."""
    same = F.zip_with(least, greatest, lambda a, b: F.coalesce(a == b, F.lit(False)))
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))
    return F.array_join(F.slice(least, 1, n.cast("int")), ".")


def libraries(requires: DataFrame) -> DataFrame:
    """requires(brick, file, line, ord, target, is_js) of external libraries -> one row a library and brick:
    library, brick, n_bricks, file, line of the first require."""
    r = requires.withColumn("key", library_key(F.col("target"), F.col("is_js")))
    parts = F.when(F.col("is_js"), F.array("key")).otherwise(F.split("target", r"\."))
    names = r.withColumn("parts", parts).groupBy("key", "is_js").agg(F.min("parts").alias("lo"), F.max("parts").alias("hi"), F.countDistinct("brick").alias("n_bricks"))
    names = names.select("key", "is_js", "n_bricks", common_prefix(F.col("lo"), F.col("hi")).alias("library"))
    first = r.groupBy("key", "is_js", "brick").agg(F.min_by(F.struct("file", "line"), F.struct("ord", "line")).alias("at"))
    return first.join(names, ["key", "is_js"]).select("library", "brick", "n_bricks", "at.file", "at.line")


def shared_counts(used: DataFrame, owner: str, item: str) -> DataFrame:
    """For each owner, how many of its items another owner has too (0 kept for owners without any)."""
    distinct = used.select(owner, item).distinct()
    many = distinct.groupBy(item).agg(F.count("*").alias("_n")).filter("_n > 1")
    hits = distinct.join(many, item, "left_semi").groupBy(owner).agg(F.count("*").alias("shared"))
    return distinct.select(owner).distinct().join(hits, owner, "left").fillna(0, ["shared"])


def duplicates(fragments: DataFrame, limit: float) -> DataFrame:
    """fragments(brick, file, hash, forms, line, end_line) over the limit whose hash more than one brick has, without
    those inside a larger such fragment of their file."""
    over = fragments.filter(F.col("forms") > limit)
    many = over.groupBy("hash").agg(F.countDistinct("brick").alias("_n")).filter("_n > 1")
    return outermost(over.join(many, "hash", "left_semi"))


def outermost(fragments: DataFrame) -> DataFrame:
    """The fragments that don't lie within the lines of one of their file with more forms.

    A file's fragments stand together, sorted by where they start, wide and large ones first, so whatever may hold a
    fragment comes before it. A task goes through them once. It remembers the file's ends so far that nothing beats, being
    both later and larger; they are sorted, so the largest fragment that ends late enough is found by bisection.
    """
    order = [F.asc("file"), F.asc("line"), F.desc("end_line"), F.desc("forms")]
    return fragments.repartition("file").sortWithinPartitions(*order).mapInArrow(_sweep, fragments.schema)


def _sweep(batches):
    of, ends, forms = object(), [], []
    for batch in batches:
        keep = []
        for file, end, size in zip(*(batch.column(c).to_pylist() for c in ("file", "end_line", "forms")), strict=True):
            if file != of:
                of, ends, forms = file, [], []
            at = bisect_left(ends, end)
            keep.append(at == len(ends) or forms[at] <= size)
            if keep[-1]:  # forms fall as ends rise; what the new one beats stands before it
                stop = at + (at < len(ends) and ends[at] == end)
                start = at
                while start and forms[start - 1] <= size:
                    start -= 1
                ends[start:stop], forms[start:stop] = [end], [size]
        yield batch.filter(pa.array(keep, pa.bool_()))
