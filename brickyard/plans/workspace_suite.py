"""The engine itself (tables, resolution, metrics, findings, display rows) over a workspace made of the relational tables.

A brick is a nation (those of region 0 are bases), a source file and a test file belong to each supplier. A third of the
source files are interfaces. Definitions and references are what a supplier's line items make of them; requires, keywords
and tests are the parts, nations and orders that it sells more than usual of. The flat tables in FLAT are SQL that both engines read; what is made of them is the engine's work on one side and SQL on the other.
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.functions.facts import SCHEMA
from brickyard.plans import thresholds
from brickyard.plans.analysis import Workspace
from brickyard.plans.config import merge_config
from brickyard.session import kept
from brickyard.sources.workspace import Settings

QUERIES: dict = {}
ORACLES: dict = {}
TABLES = ("nation", "supplier", "customer", "orders", "lineitem")



def _large(keys: str, times: float) -> str:
    """Of groups of line items those whose quantity is so many times that of the usual one."""
    names = ", ".join(k.rpartition(" AS ")[2] for k in keys.split(", "))
    grouped = f"SELECT {keys}, sum(q) AS q FROM line GROUP BY ALL"
    return f"SELECT {names} FROM ({grouped}) g WHERE q > {times} * (SELECT avg(q) FROM ({grouped}) h)"


FLAT = {
    "brick": """SELECT CAST(n_nationkey AS INT) AS ord, n_name AS brick, CASE WHEN n_regionkey = 0 THEN 'base' ELSE 'component' END AS type,
  'parts/' || n_name AS dir, lower(replace(n_name, ' ', '-')) AS seg FROM nation""",
    "src": """SELECT s_suppkey AS k, brick, type, dir, seg, 'src/' || lpad(CAST(s_suppkey AS STRING), 9, '0') AS file,
  'top.' || seg || CASE WHEN s_suppkey % 3 = 0 THEN '.interface' ELSE '.core' END AS ns, s_suppkey % 50 + 10 AS forms, s_suppkey % 4 AS interop,
  'test/' || lpad(CAST(s_suppkey AS STRING), 9, '0') AS test_file, 'top.' || seg || '.t' || CAST(s_suppkey AS STRING) AS test_ns FROM supplier JOIN brick ON s_nationkey = ord""",
    "line": """SELECT l_suppkey AS k, l_partkey % 40 AS p, l_orderkey AS o, c_nationkey AS t, l_quantity AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "req": f"""SELECT k, CAST(t AS INT) AS ord, 'top.' || seg || '.interface' AS target, 'a' || CAST(t AS STRING) AS alias FROM ({_large("k, t", 1.4)}) x JOIN brick ON t = ord""",
    "lib": f"""SELECT k, CAST(100 + p AS INT) AS ord, 'org.lib' || CAST(p % 9 AS STRING) || '.x.part' || CAST(p AS STRING) AS target FROM ({_large("k, p", 1.5)}) x""",
    "def": """SELECT DISTINCT k, CAST(p AS INT) AS p, 'p' || CAST(p AS STRING) AS name, p % 7 = 0 AS private, p % 11 = 3 AND k % 5 = 0 AS throws FROM line""",
    "ref": """SELECT DISTINCT k, CAST(p AS INT) AS p, CASE WHEN o % 3 = 0 THEN 'p' || CAST(o % 40 AS STRING) WHEN o % 17 = 0 THEN 'zz/p1' ELSE 'a' || CAST(t AS STRING) || '/p' || CAST(o % 40 AS STRING) END AS symbol FROM line""",
    "word": f"""SELECT k, 'w/' || CAST(w AS STRING) AS keyword FROM ({_large("k, o % 900 AS w", 2)}) x""",
    "tested": f"""SELECT k, 'me/p' || CAST(w AS STRING) AS symbol FROM ({_large("k, o % 40 AS w", 1.3)}) x""",
    "reach": f"""SELECT k, CAST(t AS INT) + 1 AS ord, 'top.' || seg || CASE WHEN t % 2 = 0 THEN '.core' ELSE '.interface' END AS target FROM ({_large("k, t", 1.5)}) x JOIN brick ON t = ord""",
    "test": f"""SELECT k, CAST(p AS INT) AS p, CAST(p % 5 AS INT) AS assertions FROM ({_large("k, p", 1.1)}) x""",
}


def flat(*names: str) -> str:
    """The WITH clause of these tables and those they are made of."""
    wanted = [n for n in FLAT if n in names or n in ("brick", "src", "line")]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({FLAT[n]})" for n in wanted)


def query(sql: str, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"{flat(*names)}{sql}"
        return f

    return add


def _tables(spark: SparkSession, sf_dir: str):
    """A function from names of flat tables to these; line items are read and joined once, and dealt by supplier once for all that is grouped from them."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def of(wanted: list[str], name: str, given: dict[str, DataFrame]) -> DataFrame:
        shown = ", ".join(f"{t} AS (SELECT * FROM {{{t}}})" for t in given)
        made = ", ".join(f"{n} AS ({FLAT[n]})" for n in wanted)
        return spark.sql(f"WITH {shown}, {made} SELECT * FROM {name}", **given)

    made = {name: of(["brick", "src", "line"], name, tables) for name in ("brick", "src", "line")}
    shared = {name: kept(df.repartition(parts, "k") if name == "line" else df) for name, df in made.items()}
    return lambda name: shared[name] if name in shared else of([name], name, shared)


_made: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The facts of all files, one row a file, as the source reader would give them; made once for the session's queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        _made.clear()
        _made[key] = _workspace(spark, sf_dir)
    made = _made[key]
    return Workspace(made.settings, made.bricks, made.facts)  # what is derived from the facts is each query's own


def _workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    t = _tables(spark, sf_dir)
    of = lambda df, what, out: df.groupBy("k").agg(F.sort_array(F.collect_list(what)).alias(out))
    no, null, one = F.lit(False), F.lit(None).cast("string"), F.lit(1)
    requires = lambda df, alias: df.select("k", F.struct("ord", "target", no.alias("is_js"), F.col("ord").alias("line"), alias.alias("alias"), null.alias("as_alias"), F.array().cast("array<string>").alias("refer")).alias("x"))
    refs = t("ref").groupBy("k", "p").agg(F.sort_array(F.collect_list("symbol")).alias("refs"))
    # What a supplier defines is grouped once, and what stands at these places is made of that.
    defs = of(t("def").join(refs, ["k", "p"]), F.struct("p", "name", "private", "throws", "refs"), "defs")
    each = lambda f, when=None: F.transform("defs" if when is None else F.filter("defs", lambda x: when(x["p"])), lambda x: f(x, x["p"]))
    named = lambda x, p: (p.alias("ord"), x["name"].alias("name"), (p + 1).alias("line"))
    kind = lambda p: F.when(p % 3 == 0, "atom").when(p % 3 == 1, "dynamic").otherwise("alter")
    shown = lambda p: F.when(p % 2 == 0, "logs").when(p % 4 == 1, "rethrows").otherwise("swallows")
    defined = defs.select(
        "k",
        each(lambda x, p: F.struct(*named(x, p), x["private"].alias("private"), x["throws"].alias("throws"), x["refs"].alias("refs"))).alias("definitions"),
        each(lambda x, p: F.struct(*named(x, p), (p % 13 + 1).alias("complexity"), (p % 9).alias("depth"), (p + 2).alias("depth_line"), (p * 5).alias("forms"), (p % 6).alias("params"))).alias("functions"),
        each(lambda x, p: F.struct(*named(x, p), kind(p).alias("kind")), lambda p: p % 5 == 0).alias("mutable_state"),
        each(lambda x, p: F.struct(p.alias("ord"), (p + 1).alias("line"), F.lit("Exception").alias("class"), (p % 8 == 1).alias("broad"), shown(p).alias("handling")), lambda p: p % 4 == 1).alias("catches"),
        F.sort_array(each(lambda x, p: F.struct((p % 13).cast("long").alias("hash"), (p * 4).alias("forms"), (p + 1).alias("line"), (p + 1 + p % 3 * 9).alias("end_line")))).alias("fragments"),
        each(lambda x, p: F.struct(p.alias("ord"), (p + 1).alias("line"), F.when(p % 12 == 2, "untyped").otherwise("typed").alias("kind")), lambda p: p % 6 == 2).alias("throws"),
    )
    made = [of(requires(t("req"), F.col("alias")).unionAll(requires(t("lib"), null)), "x", "requires"), of(t("word"), "keyword", "keywords"), defined]
    own = t("src")
    me = own.select("k", F.lit(0).alias("ord"), F.concat(F.lit("top."), "seg", F.lit(".interface")).alias("target"))
    p = F.col("p")
    tests = [
        of(requires(me, F.lit("me")).unionAll(requires(t("reach"), null)), "x", "requires"),
        of(t("test"), F.struct(p.alias("ord"), F.concat(F.lit("t"), p.cast("string")).alias("name"), (p + 1).alias("line"), (p + 10).alias("forms"), "assertions"), "tests"),
        of(t("test").filter("p % 3 = 0"), F.struct(p.alias("ord"), (p + 1).alias("line"), F.when(p % 2 == 0, "sleep").otherwise("with-redefs").alias("kind")), "hazards"),
        of(t("tested"), "symbol", "test_refs"),
    ]
    fields = {x.name: x.dataType for x in spark.createDataFrame([], SCHEMA).schema}
    fill = lambda df: df.select(*[(F.coalesce(F.col(n).cast(k), F.array().cast(k)) if k.typeName() == "array" else F.col(n).cast(k)).alias(n) if n in df.columns else (F.array() if k.typeName() == "array" else F.lit(None)).cast(k).alias(n) for n, k in fields.items()])
    joined = lambda df, parts: reduce(lambda a, b: a.join(b, "k", "left"), parts, df)
    sources = joined(own.withColumn("is_test", no).withColumn("ord", one), made)
    checks = joined(own.select("k", "brick", "type", "dir", F.col("test_file").alias("file"), F.col("test_ns").alias("ns"), (F.col("k") % 30).alias("forms"), F.lit(True).alias("is_test"), one.alias("ord")), tests)
    return Workspace(Settings("top"), t("brick").select("ord", "brick", "type", "dir"), kept(fill(sources).unionAll(fill(checks))))


# What SQL makes of the flat tables.
MORE = {
    "edge": """e0 AS (SELECT s.brick AS f, r.target, s.file, r.ord AS line, row_number() OVER (PARTITION BY s.brick, r.target ORDER BY s.file, r.ord) AS n, split_part(r.target, '.', 2) AS interface, s.seg FROM req r JOIN src s ON r.k = s.k),
edge AS (SELECT f AS src, b.brick AS dst, interface, file, CAST(line AS BIGINT) AS line FROM e0 JOIN brick b ON b.seg = interface AND b.type = 'component' AND EXISTS (SELECT 1 FROM src WHERE src.brick = b.brick) WHERE n = 1 AND interface <> e0.seg)""",
    "deps": """deps AS (SELECT brick, (SELECT count(DISTINCT src) FROM edge WHERE dst = brick) AS ca, (SELECT count(DISTINCT interface) FROM edge WHERE src = brick) AS ce FROM brick)""",
    "resolved": """resolved AS (
  SELECT s.brick, s.seg, s.ns, s.file, 'p' || r.p AS def_name, coalesce(q.target, s.ns) AS to_ns, split_part(symbol, 'p', 2) AS x, 'p' || split_part(symbol, 'p', 2) AS to_name
  FROM ref r JOIN src s ON r.k = s.k LEFT JOIN req q ON q.k = r.k AND symbol LIKE 'a%' AND q.alias = split_part(symbol, '/', 1)
  LEFT JOIN def d ON d.k = r.k AND symbol = d.name
  WHERE q.target IS NOT NULL OR d.name IS NOT NULL)""",
    "facade": """facade AS (SELECT s.brick, s.type, s.seg, s.ns, s.file, d.name, d.p FROM def d JOIN src s ON s.k = d.k WHERE NOT d.private AND s.ns LIKE '%.interface')""",
    "untested": """seen AS (SELECT DISTINCT 'top.' || s.seg || '.interface' AS ns, split_part(t.symbol, '/', 2) AS name FROM tested t JOIN src s ON s.k = t.k),
untested AS (SELECT f.* FROM facade f WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.ns = f.ns AND seen.name = f.name))""",
    "throwing": """throwing AS (SELECT DISTINCT s.ns, d.name FROM def d JOIN src s ON s.k = d.k WHERE d.throws
  UNION SELECT r.ns, r.def_name FROM throwing t JOIN (SELECT DISTINCT ns, def_name, to_ns, to_name FROM resolved) r ON r.to_ns = t.ns AND r.to_name = t.name)""",
}


def _more(*names: str) -> str:
    return "".join(f",\n{MORE[n]}" for n in names) + "\n"


@query(_more("edge") + "SELECT src, dst, interface, file, line FROM edge", "req")
def workspace_edges(spark, sf_dir):
    e = workspace(spark, sf_dir).edges
    return e.select(F.col("from").alias("src"), F.col("to").alias("dst"), "interface", "file", F.col("line").cast("long").alias("line"))


@query(_more("resolved") + "SELECT brick, def_name, to_ns, to_name, count(*) AS n FROM resolved GROUP BY ALL", "req", "ref", "def")
def workspace_references(spark, sf_dir):
    return workspace(spark, sf_dir).calls.groupBy("brick", "def_name", "to_ns", "to_name").agg(F.sum("n").alias("n"))


@query(_more("facade", "untested") + "SELECT brick, file, name FROM untested", "def", "tested")
def workspace_untested(spark, sf_dir):
    return workspace(spark, sf_dir).untested.select("brick", "file", "name")


@query(_more("resolved", "throwing") + "SELECT ns, name FROM throwing", "req", "ref", "def")
def workspace_throwing(spark, sf_dir):
    return workspace(spark, sf_dir).throwing.select("ns", "name")


@query(
    _more("resolved")
    + """, used AS (SELECT DISTINCT split_part(to_ns, '.', 2) AS seg, to_name AS name FROM resolved WHERE split_part(to_ns, '.', 2) <> seg)
SELECT s.brick, s.file, d.name, (d.p % 6)::DOUBLE AS value FROM def d JOIN src s ON s.k = d.k JOIN used u ON u.seg = s.seg AND u.name = d.name WHERE s.type = 'component' AND s.ns LIKE '%.interface'""",
    "req", "ref", "def",
)
def workspace_positional(spark, sf_dir):
    return workspace(spark, sf_dir)._positional().select("brick", "file", F.col("loc_name").alias("name"), "value")


@query(
    """
SELECT s.brick, s.test_file || ' ' || r.target AS subject, r.ord::BIGINT AS line, 'this test reaches past the interface of ' || split_part(r.target, '.', 2) || ' into ' || r.target AS message
FROM reach r JOIN src s ON s.k = r.k WHERE split_part(r.target, '.', 2) <> s.seg AND r.target NOT LIKE '%.interface'""",
    "reach",
)
def workspace_crossings(spark, sf_dir):
    return workspace(spark, sf_dir)._crossings().select("brick", "subject", F.col("line").cast("long").alias("line"), "message")


@query(
    """
SELECT s.brick, 'mutable-state' AS metric, s.file, d.p + 1 AS line, CASE d.p % 3 WHEN 0 THEN 'holds state in an atom' WHEN 1 THEN 'rebinds state through a dynamic var' ELSE 'replaces the root value of ' || d.name END
  || CASE WHEN s.ns LIKE '%.interface' THEN ' (part of the interface: all users see its changes)' ELSE ' (internal: results depend on what was called before)' END AS message
FROM def d JOIN src s ON s.k = d.k WHERE d.p % 5 = 0
UNION ALL SELECT s.brick, 'broad-catches', s.file, d.p + 1, 'a handler for Exception' || CASE WHEN d.p % 2 = 0 THEN ' only writes a log entry' ELSE ' drops the error' END || ', so callers never learn of the failure'
FROM def d JOIN src s ON s.k = d.k WHERE d.p % 8 = 1 AND (d.p % 2 = 0 OR d.p % 4 <> 1)
UNION ALL SELECT s.brick, 'untyped-errors', s.file, d.p + 1, 'the data of this ex-info has no :type to dispatch on' FROM def d JOIN src s ON s.k = d.k WHERE d.p % 12 = 2""",
    "def",
)
def workspace_code_findings(spark, sf_dir):
    w = workspace(spark, sf_dir)
    found = w._state().unionByName(w._catches()).unionByName(w._untyped())
    return found.select("brick", "metric", "file", F.col("line").cast("int").alias("line"), "message")


@query(
    _more("edge", "deps")
    + """SELECT src AS brick, dst AS subject, round(b.i - a.i, 6) AS value FROM edge JOIN (SELECT brick, ce::DOUBLE / nullif(ca + ce, 0) AS i FROM deps) a ON a.brick = src JOIN (SELECT brick, ce::DOUBLE / nullif(ca + ce, 0) AS i FROM deps) b ON b.brick = dst WHERE b.i - a.i > 0""",
    "req",
)
def workspace_unstable(spark, sf_dir):
    return workspace(spark, sf_dir)._unstable().select("brick", "subject", F.round("value", 6).alias("value"))


@query(
    """, l AS (SELECT s.brick, 'org.lib' || split_part(substr(target, 8), '.', 1) AS name, target FROM lib JOIN src s ON s.k = lib.k),
m AS (SELECT split_part(target, '.', 1) || '.' || split_part(target, '.', 2) || '.' || split_part(target, '.', 3) AS key, brick, target FROM l),
c AS (SELECT key, count(DISTINCT brick) AS n, count(DISTINCT target) AS targets, min(target) AS sole FROM m GROUP BY key)
SELECT DISTINCT CASE WHEN targets = 1 THEN sole ELSE key END AS library, brick, n AS n_bricks FROM m JOIN c USING (key)""",
    "lib",
)
def workspace_libraries(spark, sf_dir):
    return workspace(spark, sf_dir).libraries.select("library", "brick", "n_bricks")


@query(
    _more("edge", "deps", "resolved", "facade", "untested", "throwing")
    + """, w AS (SELECT DISTINCT s.brick, keyword FROM word JOIN src s ON s.k = word.k),
m AS (SELECT b.ord, b.brick, b.type, (SELECT coalesce(sum(forms), 0) FROM src WHERE src.brick = b.brick) AS forms, (SELECT coalesce(sum(interop), 0) FROM src WHERE src.brick = b.brick) AS interop,
  (SELECT coalesce(sum(k % 30), 0) FROM src WHERE src.brick = b.brick) AS test_forms,
  (SELECT count(*) FROM def d JOIN src s ON s.k = d.k WHERE s.brick = b.brick) AS definitions, (SELECT avg(p % 13 + 1) FROM def d JOIN src s ON s.k = d.k WHERE s.brick = b.brick) AS complexity, (SELECT avg(p % 9) FROM def d JOIN src s ON s.k = d.k WHERE s.brick = b.brick) AS depth,
  (SELECT count(*) FROM test t JOIN src s ON s.k = t.k WHERE s.brick = b.brick) AS tests, (SELECT avg(assertions) FROM test t JOIN src s ON s.k = t.k WHERE s.brick = b.brick) AS asserts, (SELECT avg(p + 10) FROM test t JOIN src s ON s.k = t.k WHERE s.brick = b.brick) AS test_size,
  (SELECT count(*) FROM test t JOIN src s ON s.k = t.k WHERE s.brick = b.brick AND p % 3 = 0) AS hazards,
  (SELECT count(*) FROM facade f WHERE f.brick = b.brick) AS facade, (SELECT count(*) FROM untested f WHERE f.brick = b.brick) AS untested,
  (SELECT count(*) FROM facade f JOIN throwing t ON t.ns = f.ns AND t.name = f.name WHERE f.brick = b.brick) AS throwing,
  (SELECT count(*) FROM resolved r WHERE r.brick = b.brick) AS refs, (SELECT count(*) FROM resolved r WHERE r.brick = b.brick AND split_part(to_ns, '.', 2) = r.seg) AS inside,
  (SELECT count(*) FROM w WHERE w.brick = b.brick AND EXISTS (SELECT 1 FROM w x WHERE x.keyword = w.keyword AND x.brick <> w.brick)) AS shared,
  (SELECT count(DISTINCT split_part(target, '.', 2)||split_part(target, '.', 3)) FROM lib JOIN src s ON s.k = lib.k WHERE s.brick = b.brick) AS libraries, ca, ce
  FROM brick b JOIN deps ON deps.brick = b.brick),
v AS (SELECT *, ce::DOUBLE / nullif(ca + ce, 0) AS instability, CASE WHEN type = 'component' AND definitions > 0 THEN 1.0::DOUBLE - facade::DOUBLE / definitions END AS abstractness, type = 'component' AS c FROM m)
SELECT brick, forms::BIGINT AS forms, definitions::BIGINT AS functions, round(complexity, 6) AS mean_complexity, round(depth, 6) AS mean_depth, tests::BIGINT AS tests, round(asserts, 6) AS assertions, round(test_size, 6) AS forms_per_test,
  hazards::BIGINT AS hazards, shared::BIGINT AS shared_keywords, libraries::BIGINT AS libraries, ca::BIGINT AS afferent, ce::BIGINT AS efferent, round(instability, 6) AS instability, round(abstractness, 6) AS abstractness,
  round(abs(abstractness + instability - 1), 6) AS distance, CASE WHEN c THEN round(inside::DOUBLE / nullif(refs, 0), 6) END AS cohesion, round(interop * 100.0::DOUBLE / nullif(forms, 0), 6) AS interop_density,
  round(test_forms::DOUBLE / nullif(forms, 0), 6) AS test_ratio, CASE WHEN c THEN round(throwing::DOUBLE / nullif(facade, 0), 6) END AS error_surface, CASE WHEN c THEN round(untested::DOUBLE / nullif(facade, 0), 6) END AS untested_interface,
  CASE WHEN c THEN refs::BIGINT END AS workspace_references FROM v""",
    "req", "lib", "def", "ref", "word", "tested", "test",
)
def workspace_brick_metrics(spark, sf_dir):
    m = workspace(spark, sf_dir).brick_metrics
    c = lambda key: F.col(f"`{key}`")
    r = lambda key: F.round(c(key), 6)
    return m.select(
        "brick", "forms", "functions", r("mean-function-complexity").alias("mean_complexity"), r("mean-function-depth").alias("mean_depth"), "tests", r("assertions-per-test").alias("assertions"), r("forms-per-test").alias("forms_per_test"),
        c("isolation-hazards").alias("hazards"), c("shared-keywords").alias("shared_keywords"), "libraries", "afferent", "efferent", r("instability").alias("instability"), r("abstractness").alias("abstractness"),
        r("main-sequence-distance").alias("distance"), r("cohesion").alias("cohesion"), r("interop-density").alias("interop_density"), r("test-ratio").alias("test_ratio"), r("error-surface").alias("error_surface"),
        r("untested-interface").alias("untested_interface"), c("workspace-references").alias("workspace_references"),
    )


@query(
    """, f AS (SELECT s.brick, s.type, s.file, s.ns || '/' || d.name AS subject, d.p, unnest([{'m': 'function-complexity', 'v': d.p % 13 + 1, 'o': 10, 'l': 'error'}, {'m': 'function-depth', 'v': d.p % 9, 'o': 8, 'l': 'warning'},
  {'m': 'function-forms', 'v': d.p * 5, 'o': 150, 'l': 'warning'}, {'m': 'function-params', 'v': d.p % 6, 'o': 4, 'l': 'warning'}]) AS x FROM def d JOIN src s ON s.k = d.k)
SELECT x.m AS metric, brick, file, subject, x.v::DOUBLE AS value, x.l AS level, x.v || ' is over the limit of ' || x.o AS message FROM f WHERE x.v > x.o""",
    "def",
)
def workspace_function_violations(spark, sf_dir):
    w = workspace(spark, sf_dir)
    registry, settings = thresholds.registry_frame(spark), thresholds.settings_frame(spark, merge_config())
    return thresholds.function_violations(w.functions, registry, settings).select("metric", "brick", "file", "subject", "value", "level", "message")


@query(
    """, h AS (SELECT s.brick, CASE WHEN p % 2 = 0 THEN 'sleep' ELSE 'with-redefs' END AS kind, count(*) AS n FROM test t JOIN src s ON s.k = t.k WHERE p % 3 = 0 GROUP BY 1, 2)
SELECT brick, string_agg(kind || ': ' || n, ', ' ORDER BY kind) AS kinds FROM h GROUP BY brick""",
    "test",
)
def workspace_hazard_kinds(spark, sf_dir):
    found = workspace(spark, sf_dir).brick_metrics.select("brick", F.map_entries("hazard-kinds").alias("x")).filter("x is not null")
    return found.select("brick", F.array_join(F.transform("x", lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), ", ").alias("kinds"))


FRAGMENTS = """, frag AS (SELECT s.brick, s.file, d.p % 13 AS hash, d.p * 4 AS forms, d.p + 1 AS line, d.p + 1 + d.p % 3 * 9 AS end_line FROM def d JOIN src s ON s.k = d.k WHERE d.p * 4 > 30),
dup AS (SELECT * FROM frag WHERE hash IN (SELECT hash FROM frag GROUP BY hash HAVING count(DISTINCT brick) > 1)),
outer_ AS (SELECT * FROM dup d WHERE NOT EXISTS (SELECT 1 FROM dup o WHERE o.file = d.file AND o.forms > d.forms AND o.line <= d.line AND o.end_line >= d.end_line)),
by_brick AS (SELECT hash, brick, min(file || ':' || lpad(line::VARCHAR, 3, '0')) AS at FROM frag GROUP BY 1, 2)"""


@query(
    FRAGMENTS
    + """SELECT o.brick, o.file, o.line::INT AS line, o.forms::DOUBLE AS value, 'the same ' || o.forms || ' forms stand in ' || string_agg(b.brick, ', ' ORDER BY b.brick)
  || ', for instance at ' || split_part(min(b.at), ':', 1) || ':' || split_part(min(b.at), ':', 2)::INT AS message
FROM outer_ o JOIN by_brick b ON b.hash = o.hash AND b.brick <> o.brick GROUP BY o.brick, o.file, o.line, o.forms, o.hash""",
    "def",
)
def workspace_duplicates(spark, sf_dir):
    return workspace(spark, sf_dir)._duplicates(30).select("brick", "file", "line", "value", "message")


# Findings and functions of the workspace that the default thresholds are applied to.
FOUND = """, f AS (SELECT s.brick, s.type, d.p FROM def d JOIN src s ON s.k = d.k),
found AS (
  SELECT brick, type, 'mutable-state' AS metric FROM f WHERE p % 5 = 0 UNION ALL SELECT brick, type, 'broad-catches' FROM f WHERE p % 8 = 1 AND (p % 2 = 0 OR p % 4 <> 1)
  UNION ALL SELECT brick, type, 'untyped-errors' FROM f WHERE p % 12 = 2
  UNION ALL SELECT s.brick, s.type, 'boundary-crossings' FROM reach r JOIN src s ON s.k = r.k WHERE split_part(r.target, '.', 2) <> s.seg AND r.target NOT LIKE '%.interface'),
past AS (SELECT brick, 'function-complexity' AS metric, 'error' AS level FROM f WHERE p % 13 + 1 > 10 UNION ALL SELECT brick, 'function-depth', 'warning' FROM f WHERE p % 9 > 8
  UNION ALL SELECT brick, 'function-forms', 'warning' FROM f WHERE p * 5 > 150 UNION ALL SELECT brick, 'function-params', 'warning' FROM f WHERE p % 6 > 4)"""
COUNTED = "('function-complexity'), ('function-depth'), ('function-forms'), ('function-params'), ('mutable-state'), ('broad-catches'), ('untyped-errors'), ('boundary-crossings')"


def _checked(spark, sf_dir):
    w = workspace(spark, sf_dir)
    wide = w.bricks.join(w.sources.groupBy("brick").agg(F.sum("forms").alias("forms")), "brick", "left").fillna(0, ["forms"])
    findings = kept(w._state().unionByName(w._catches()).unionByName(w._untyped()).unionByName(w._crossings()))
    return wide, findings, thresholds.check(wide, w.functions, findings, merge_config())


@query(
    FOUND
    + """SELECT metric, brick, level, count(*) AS n FROM (SELECT * FROM past UNION ALL SELECT brick, metric, 'warning' FROM found WHERE type = 'component' OR metric = 'boundary-crossings') x GROUP BY ALL""",
    "def", "reach",
)
def workspace_check(spark, sf_dir):
    return _checked(spark, sf_dir)[2].groupBy("metric", "brick", "level").agg(F.count("*").alias("n"))


@query(
    FOUND
    + f"""SELECT b.brick, m.metric, ((SELECT count(*) FROM past p WHERE p.brick = b.brick AND p.metric = m.metric) + (SELECT count(*) FROM found f WHERE f.brick = b.brick AND f.metric = m.metric))::DOUBLE AS value
FROM brick b, (VALUES {COUNTED}) m(metric)""",
    "def", "reach",
)
def workspace_filled_values(spark, sf_dir):
    wide, findings, violations = _checked(spark, sf_dir)
    values = thresholds.filled_values(wide, findings, violations, merge_config())
    return values.filter(F.col("metric").isin(*COUNTED.replace("(", "").replace(")", "").replace("'", "").split(", "))).select("brick", "metric", "value")
