"""What is read from source text, over files made of the suppliers, each fact with SQL that says what the file holds.

A supplier has a source file and a test file. Their forms stand one to a line, some of them repeated as often as the supplier's
key says, so that names, lines and counts follow from the key.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions.facts import extract

QUERIES: dict = {}
ORACLES: dict = {}

# k: the supplier, n: how many private functions or tests its files have.
FILES = "s AS (SELECT s_suppkey AS k, s_suppkey % 4 + 1 AS n FROM supplier)"

_NS = '.core (:require [top.a.interface :as a] [top.b.interface :refer [x y]] (lib.pre [one :as o] two) "react" [top.c.core :as-alias c]) #?(:clj (:require [jvm.only :as j])))'
_SOURCE = [
    '(defn f [a b & more] (throw (ex-info "bad" {:type :x})))',
    "(defn g [x] (try (x) (catch Exception e (log/error e)) (catch Foo e (throw e)) (catch Throwable t nil)))",
    "(def state (atom {}))",
    "(def ^:dynamic *d* 1)",
    "(alter-var-root #'state inc)",
    '(defn h [] (throw (RuntimeException. "x")))',
    '(defn u [] (throw (ex-info "x" {:a ::own})))',
    "[::c/z ::o/y :q/r] #_(skipped :not/there) ; nor :this/one",
]
_TEST = ["(with-redefs [a/x 1] 2)", "(defn slow [] (Thread/sleep 5))", "(def s (atom 1))"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {FILES}{sql}"
        return f

    return add


def _repeated(before: str, after: str) -> Column:
    """A line for each of 1 to n, with the number in it."""
    lines = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit(before), i.cast("string"), F.lit(after)))
    return F.array_join(lines, "\n")


def _facts(spark: SparkSession, sf_dir: str, test: bool) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 4 + 1).cast("int").alias("n"))
    # The table is few bytes, so one task would read it, and parse all texts: its keys are dealt before there are texts.
    s = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")
    name = F.concat(F.lit("(ns top.s"), F.col("k").cast("string"))
    # The same form with other white space; its numbers are the same for every fifth supplier.
    gap = F.when(F.col("k") % 2 == 0, " ").otherwise("  ,  ")
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: (i + F.col("k") % 5).cast("string")), " ")
    large = F.concat(F.lit("(comment "), F.regexp_replace(numbers, F.lit(" "), gap), F.lit(")"))
    if test:
        text = F.concat_ws("\n", F.concat(name, F.lit(".t (:require [top.a.interface :as a]))")), _repeated("(deftest t", " (is (= 1 (a/run i))) (are [x] x 1))"), *map(F.lit, _TEST))
    else:
        text = F.concat_ws("\n", F.concat(name, F.lit(_NS)), _repeated("(defn- p", " [x] (a/run x))"), *map(F.lit, _SOURCE), large)
    null = F.lit(None).cast("string")
    files = s.select(null.alias("brick"), null.alias("type"), null.alias("dir"), F.col("k").cast("string").alias("file"), F.lit(test).alias("is_test"), F.lit(0).alias("ord"), text.alias("source"))
    return extract(files)


def _each(spark: SparkSession, sf_dir: str, column: str, test: bool = False) -> DataFrame:
    return _facts(spark, sf_dir, test).select(F.col("file").cast("long").alias("k"), F.explode(column).alias("x")).select("k", "x.*")


@query(
    """, r AS (SELECT unnest([
  {'ord': 0, 'target': 'top.a.interface', 'is_js': false, 'alias': 'a', 'as_alias': NULL, 'refer': ''}, {'ord': 1, 'target': 'top.b.interface', 'is_js': false, 'alias': NULL, 'as_alias': NULL, 'refer': 'x,y'},
  {'ord': 2, 'target': 'lib.pre.one', 'is_js': false, 'alias': 'o', 'as_alias': NULL, 'refer': ''}, {'ord': 3, 'target': 'lib.pre.two', 'is_js': false, 'alias': NULL, 'as_alias': NULL, 'refer': ''},
  {'ord': 4, 'target': 'react', 'is_js': true, 'alias': NULL, 'as_alias': NULL, 'refer': ''}, {'ord': 5, 'target': 'top.c.core', 'is_js': false, 'alias': NULL, 'as_alias': 'c', 'refer': ''},
  {'ord': 6, 'target': 'jvm.only', 'is_js': false, 'alias': 'j', 'as_alias': NULL, 'refer': ''}]) AS x)
SELECT k, x.ord, x.target, x.is_js, x.alias, x.as_alias, x.refer, 1 AS line FROM s, r"""
)
def source_requires(spark, sf_dir):
    return _each(spark, sf_dir, "requires").select("k", "ord", "target", "is_js", "alias", "as_alias", F.array_join("refer", ",").alias("refer"), "line")


@query(
    """, d AS (
  SELECT k, i - 1 AS ord, 'p' || i AS name, i + 1 AS line, true AS private, false AS throws, 'a/run,x' AS refs FROM (SELECT k, unnest(range(1, n + 1)) AS i FROM s)
  UNION ALL SELECT k, n, 'f', n + 2, false, true, '&,a,b,ex-info,more,throw' FROM s
  UNION ALL SELECT k, n + 1, 'g', n + 3, false, true, 'Exception,Foo,Throwable,catch,e,log/error,t,throw,try,x' FROM s
  UNION ALL SELECT k, n + 2, 'state', n + 4, false, false, 'atom' FROM s
  UNION ALL SELECT k, n + 3, '*d*', n + 5, false, false, '' FROM s
  UNION ALL SELECT k, n + 4, 'h', n + 7, false, true, 'RuntimeException.,throw' FROM s
  UNION ALL SELECT k, n + 5, 'u', n + 8, false, true, 'ex-info,throw' FROM s)
SELECT k, ord::INT AS ord, name, line::INT AS line, private, throws, refs FROM d"""
)
def source_definitions(spark, sf_dir):
    return _each(spark, sf_dir, "definitions").select("k", "ord", "name", "line", "private", "throws", F.array_join("refs", ",").alias("refs"))


@query(
    """, f AS (
  SELECT k, 'p' || i AS name, i + 1 AS line, 1 AS complexity, 2 AS depth, 8 AS forms, 1 AS params FROM (SELECT k, unnest(range(1, n + 1)) AS i FROM s)
  UNION ALL SELECT k, 'f', n + 2, 1, 4, 16, 2 FROM s UNION ALL SELECT k, 'g', n + 3, 4, 4, 28, 1 FROM s
  UNION ALL SELECT k, 'h', n + 7, 1, 3, 9, 0 FROM s UNION ALL SELECT k, 'u', n + 8, 1, 4, 12, 0 FROM s)
SELECT k, name, line::INT AS line, complexity, depth, line::INT AS depth_line, forms, params FROM f"""
)
def source_functions(spark, sf_dir):
    return _each(spark, sf_dir, "functions").select("k", "name", "line", "complexity", "depth", "depth_line", "forms", "params")


@query(
    """SELECT k, (n + 2)::INT AS line, 'throw' AS what, 'typed' AS kind FROM s UNION ALL SELECT k, n + 3, 'throw', 'rethrow' FROM s UNION ALL SELECT k, n + 7, 'throw', 'host' FROM s UNION ALL SELECT k, n + 8, 'throw', 'untyped' FROM s
UNION ALL SELECT k, n + 3, 'broad Exception', 'logs' FROM s UNION ALL SELECT k, n + 3, 'Foo', 'rethrows' FROM s UNION ALL SELECT k, n + 3, 'broad Throwable', 'continues' FROM s"""
)
def source_errors(spark, sf_dir):
    thrown = F.transform("throws", lambda x: F.struct(x["line"].alias("line"), F.lit("throw").alias("what"), x["kind"].alias("kind")))
    caught = F.transform("catches", lambda x: F.struct(x["line"].alias("line"), F.concat(F.when(x["broad"], "broad ").otherwise(""), x["class"]).alias("what"), x["handling"].alias("kind")))
    return _facts(spark, sf_dir, False).select(F.col("file").cast("long").alias("k"), F.inline(F.concat(thrown, caught)))  # files are parsed once


@query(
    """SELECT k, (n + 4)::INT AS line, 'state' AS name, 'atom' AS kind FROM s UNION ALL SELECT k, n + 5, '*d*', 'dynamic' FROM s UNION ALL SELECT k, n + 6, '#''state', 'alter-var-root' FROM s"""
)
def source_state(spark, sf_dir):
    return _each(spark, sf_dir, "mutable_state").select("k", "line", "name", "kind")


@query(
    """SELECT k, unnest(['a', 'lib.pre.one/y', 'q/r', 'top.c.core/z', 'top.s' || k || '.core/own', 'x']) AS keyword, 'top.s' || k || '.core' AS ns, 1::BIGINT AS interop FROM s
UNION ALL SELECT k, 'type', 'top.s' || k || '.core', 1 FROM s"""
)
def source_keywords(spark, sf_dir):
    return _facts(spark, sf_dir, False).select(F.col("file").cast("long").alias("k"), F.explode("keywords").alias("keyword"), "ns", "interop")


@query(
    """SELECT k, (i + 1)::INT AS line, 't' || i AS name, 17 AS forms, 2 AS assertions, NULL AS hazard FROM (SELECT k, unnest(range(1, n + 1)) AS i FROM s)
UNION ALL SELECT k, n + 2, NULL, NULL, NULL, 'with-redefs' FROM s UNION ALL SELECT k, n + 3, NULL, NULL, NULL, 'sleep' FROM s UNION ALL SELECT k, n + 4, NULL, NULL, NULL, 'atom' FROM s"""
)
def source_tests(spark, sf_dir):
    none = F.lit(None)
    tests = F.transform("tests", lambda x: F.struct(x["line"].alias("line"), x["name"].alias("name"), x["forms"].alias("forms"), x["assertions"].alias("assertions"), none.cast("string").alias("hazard")))
    hazards = F.transform("hazards", lambda x: F.struct(x["line"].alias("line"), none.cast("string").alias("name"), none.cast("int").alias("forms"), none.cast("int").alias("assertions"), x["kind"].alias("hazard")))
    return _facts(spark, sf_dir, True).select(F.col("file").cast("long").alias("k"), F.inline(F.concat(tests, hazards)))  # files are parsed once


@query("""SELECT k, unnest(['a/run', 'a/x']) AS symbol FROM s""")
def source_test_references(spark, sf_dir):
    found = _facts(spark, sf_dir, True).select(F.col("file").cast("long").alias("k"), F.explode("test_refs").alias("symbol"))
    return found.filter(F.col("symbol").startswith("a/"))


@query(
    """SELECT 28 AS forms, count(*) AS files, min(k) AS first_file FROM s UNION ALL SELECT 23, count(*), min(k) FROM s
UNION ALL SELECT 32, count(*), min(k) FROM s GROUP BY k % 5"""
)
def source_fragments(spark, sf_dir):
    """Equal content has one hash, whatever its layout and file."""
    return _each(spark, sf_dir, "fragments").groupBy("hash", "forms").agg(F.count("*").alias("files"), F.min("k").alias("first_file")).drop("hash")
