"""The engine's operators as queries over relational tables, each with its SQL.

Analogies: a brick is a nation (or a part brand), a commit an order, a file a document, a fragment a
line of text, a library a host name; the base snapshot is orders before a date, the head all of them.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickyard.functions import trees
from brickyard.functions.facts import extract
from brickyard.operators import code, graph, order, paths, stats
from brickyard.plans import baseline, display, thresholds
from brickyard.plans.config import SETTINGS
from brickyard.session import dropped, kept

QUERIES: dict = {}
ORACLES: dict = {}
REGISTRY = "metric string, direction string, checks array<string>, kind string, metric_ord int, section string"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- edges between nations: where a nation's customers buy most abroad -------------------------------

EDGES = """flow AS (
  SELECT c_nationkey AS f, s_nationkey AS t, sum(l_quantity) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
usual AS (SELECT f, t, q, avg(q) OVER (PARTITION BY f) AS m FROM flow),
edges AS (
  SELECT a.n_name AS src, b.n_name AS dst, r_name AS area FROM usual JOIN nation a ON f = a.n_nationkey
  JOIN nation b ON t = b.n_nationkey JOIN region ON b.n_regionkey = r_regionkey WHERE q > 1.25::DOUBLE * m),
ca AS (SELECT dst AS brick, count(DISTINCT src) AS n FROM edges GROUP BY 1),
ce AS (SELECT src AS brick, count(DISTINCT area) AS n FROM edges GROUP BY 1),
deps AS (
  SELECT n_name AS brick, coalesce(ca.n, 0) AS afferent, coalesce(ce.n, 0) AS efferent,
         coalesce(ce.n, 0)::DOUBLE / nullif(coalesce(ca.n, 0) + coalesce(ce.n, 0), 0) AS instability
  FROM nation LEFT JOIN ca ON ca.brick = n_name LEFT JOIN ce ON ce.brick = n_name)"""


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the nations of customer and supplier."""
    nation = _t(spark, sf_dir, "nation")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    names = lambda key, out: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(out))
    lines = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(names("c_nationkey", "src"), "c_nationkey").join(names("s_nationkey", "dst"), "s_nationkey")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nation").select(F.col("n_name").alias("brick"), F.when(F.col("n_regionkey") == 0, "base").otherwise("component").alias("type"), F.col("n_nationkey").alias("ord"))


def _edges(spark: SparkSession, sf_dir: str, sales: DataFrame | None = None) -> DataFrame:
    """from, to, interface: nations from which a nation's customers buy a quarter more than from the usual foreign one."""
    sales = _sales(spark, sf_dir) if sales is None else sales
    flow = sales.filter("c_nationkey <> s_nationkey").groupBy("src", "dst").agg(F.sum("l_quantity").alias("q"))
    large = flow.withColumn("m", F.avg("q").over(Window.partitionBy("src"))).filter(F.col("q") > 1.25 * F.col("m"))
    area = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("dst"), F.col("r_name").alias("interface"))
    return large.join(area, "dst").select(F.col("src").alias("from"), F.col("dst").alias("to"), "interface")


@query(f"WITH {EDGES} SELECT brick, afferent, efferent, round(instability, 6) AS instability FROM deps")
def dependency_metrics(spark, sf_dir):
    m = graph.dependency_metrics(_nodes(spark, sf_dir), _edges(spark, sf_dir))
    return m.withColumn("instability", F.round("instability", 6))


@query(
    f"""WITH {EDGES},
sales AS (
  SELECT a.n_name AS src, b.n_name AS dst, l_orderkey, l_linenumber, l_shipdate,
         row_number() OVER (PARTITION BY a.n_name, b.n_name ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey)
SELECT src, dst, l_orderkey AS first_order, l_linenumber::BIGINT AS first_line FROM sales JOIN edges USING (src, dst) WHERE r = 1"""
)
def first_edge_location(spark, sf_dir):
    sales = _sales(spark, sf_dir)
    first = graph.first_of(sales.select("src", "dst", "l_orderkey", "l_linenumber", "l_shipdate"), ["src", "dst"], [F.asc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    e = _edges(spark, sf_dir, sales).select(F.col("from").alias("src"), F.col("to").alias("dst"))
    return first.join(e, ["src", "dst"]).select("src", "dst", F.col("l_orderkey").alias("first_order"), F.col("l_linenumber").cast("long").alias("first_line"))


@query(f"WITH {EDGES} SELECT src, dst, round(b.instability - a.instability, 6) AS gap FROM edges JOIN deps a ON a.brick = src JOIN deps b ON b.brick = dst WHERE b.instability - a.instability > 0.1")
def unstable_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)
    found = graph.unstable_edges(e, graph.dependency_metrics(_nodes(spark, sf_dir), e), 0.1)
    return found.select(F.col("from").alias("src"), F.col("to").alias("dst"), F.round("gap", 6).alias("gap"))


@query(
    f"""WITH {EDGES},
sole AS (SELECT dst AS brick, min(src) AS dependent FROM edges GROUP BY 1 HAVING count(DISTINCT src) = 1),
size AS (SELECT n_name AS brick, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT sole.brick, dependent, round(a.n::DOUBLE / b.n, 6) AS share FROM sole JOIN size a ON a.brick = sole.brick JOIN size b ON b.brick = dependent"""
)
def merge_candidates(spark, sf_dir):
    size = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("brick")).agg(F.count("*").alias("n"))
    other = size.select(F.col("brick").alias("dependent"), F.col("n").alias("m"))
    return graph.sole_dependents(_edges(spark, sf_dir)).join(size, "brick").join(other, "dependent").select("brick", "dependent", F.round(F.col("n").cast("double") / F.col("m"), 6).alias("share"))


PAIRS = """touched AS (SELECT DISTINCT l_orderkey AS c, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
small AS (SELECT * FROM touched WHERE c IN (SELECT c FROM touched GROUP BY c HAVING count(*) <= 5)),
n AS (SELECT b, count(*) AS n FROM small GROUP BY b),
both_ AS (SELECT x.b AS a, y.b AS b, count(*) AS shared FROM small x JOIN small y ON x.c = y.c AND x.b < y.b GROUP BY 1, 2),
pairs AS (
  SELECT CASE WHEN na.n <= nb.n THEN a ELSE both_.b END AS fewer, CASE WHEN na.n <= nb.n THEN both_.b ELSE a END AS more, shared, least(na.n, nb.n) AS changes
  FROM both_ JOIN n na ON na.b = a JOIN n nb ON nb.b = both_.b)"""


def _pairs(spark, sf_dir):
    touched = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("commit"), F.col("p_brand").alias("brick"))
    return graph.co_changes(touched, 5)


@query(f"WITH {PAIRS} SELECT fewer, more, shared, changes, round(shared::DOUBLE / changes, 6) AS strength FROM pairs")
def co_change_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("strength", F.round("strength", 6))


@query(f"WITH RECURSIVE {EDGES}, reach AS (SELECT src, dst FROM edges UNION SELECT reach.src, edges.dst FROM reach JOIN edges ON reach.dst = edges.src) SELECT src, dst FROM reach")
def reachability(spark, sf_dir):
    paths = graph.closure(_edges(spark, sf_dir).select(F.col("from").alias("a"), F.col("to").alias("b")))
    return paths.select(F.col("a").alias("src"), F.col("b").alias("dst"))


@query(f"WITH RECURSIVE {EDGES}, hit AS (SELECT n_name AS brick FROM nation WHERE n_regionkey = 1 UNION SELECT src FROM edges JOIN hit ON dst = brick) SELECT brick FROM hit")
def taint_fixpoint(spark, sf_dir):
    seeds = _t(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("node"))
    e = _edges(spark, sf_dir).select(F.col("from").alias("a"), F.col("to").alias("b"))
    return graph.reach_back(e, seeds).select(F.col("node").alias("brick"))


@query(
    f"""WITH {EDGES} SELECT n_name AS brick, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT dst AS x FROM edges WHERE src = n_name)), '') AS depends_on,
coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT src AS x FROM edges WHERE dst = n_name)), '') AS depended_on_by FROM nation"""
)
def neighbors(spark, sf_dir):
    found = graph.neighbors(_nodes(spark, sf_dir), _edges(spark, sf_dir))
    return found.select("brick", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("depended_on_by", ",").alias("depended_on_by"))


@query(f"WITH {EDGES}, ids AS (SELECT n_name, 'b' || (row_number() OVER (ORDER BY n_nationkey) - 1)::VARCHAR AS id FROM nation) SELECT '  ' || a.id || ' --> ' || b.id AS line FROM (SELECT DISTINCT src, dst FROM edges) e JOIN ids a ON a.n_name = src JOIN ids b ON b.n_name = dst")
def mermaid_edges(spark, sf_dir):
    return display.edge_lines(_nodes(spark, sf_dir), _edges(spark, sf_dir)).select("line")


# -- texts and hosts -------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT DISTINCT source, unnest(string_split(lower(text), ' ')) AS token FROM documents), u AS (SELECT * FROM w WHERE length(token) > 3),
m AS (SELECT token FROM u GROUP BY token HAVING count(*) > 1)
SELECT source, count(*) FILTER (WHERE token IN (SELECT token FROM m)) AS shared FROM u GROUP BY source"""
)
def shared_tokens(spark, sf_dir):
    words = _t(spark, sf_dir, "documents").select("source", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("token")).filter(F.length("token") > 3)
    return code.shared_counts(words, "source", "token")


LINES = """lines AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
frag AS (SELECT source, doc_id, md5(line) AS hash, length(line) AS forms, n AS line, n AS end_line FROM lines WHERE length(line) > 30
  UNION ALL SELECT a.source, a.doc_id, md5(a.line || chr(10) || b.line), length(a.line) + length(b.line) + 1, a.n, b.n FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.n = a.n + 1),
dup AS (SELECT * FROM frag WHERE forms > 30 AND hash IN (SELECT hash FROM frag WHERE forms > 30 GROUP BY hash HAVING count(DISTINCT source) > 1))"""


def _fragments(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("brick"), F.col("doc_id").alias("file"), F.split("text", "\n").alias("lines"))
    lines = d.select("brick", "file", "lines", F.posexplode("lines").alias("i", "text"))
    one = lines.filter(F.length("text") > 30).select("brick", "file", F.md5("text").alias("hash"), F.length("text").alias("forms"), (F.col("i") + 1).alias("line"), (F.col("i") + 1).alias("end_line"))
    both = F.concat_ws("\n", "text", F.get("lines", F.col("i") + 1))
    two = lines.filter(F.col("i") + 1 < F.size("lines")).select("brick", "file", F.md5(both).alias("hash"), F.length(both).alias("forms"), (F.col("i") + 1).alias("line"), (F.col("i") + 2).alias("end_line"))
    return one.unionByName(two)


@query(f"WITH {LINES} SELECT source, doc_id, hash, line::BIGINT AS line FROM dup WHERE line = end_line")
def duplicate_fragments(spark, sf_dir):
    f = _fragments(spark, sf_dir).filter("line = end_line")
    return code.duplicates(f, 30).select(F.col("brick").alias("source"), F.col("file").alias("doc_id"), "hash", F.col("line").cast("long").alias("line"))


@query(
    f"""WITH {LINES} SELECT source, doc_id, hash, forms::BIGINT AS forms, line::BIGINT AS line FROM dup d
WHERE NOT EXISTS (SELECT 1 FROM dup o WHERE o.doc_id = d.doc_id AND o.forms > d.forms AND o.line <= d.line AND o.end_line >= d.end_line)"""
)
def duplicate_maximal(spark, sf_dir):
    found = code.duplicates(_fragments(spark, sf_dir), 30)
    return found.select(F.col("brick").alias("source"), F.col("file").alias("doc_id"), "hash", F.col("forms").cast("long").alias("forms"), F.col("line").cast("long").alias("line"))


HOSTS = """req AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/]*)', 1) AS brick FROM pages),
rev AS (SELECT page_id, brick, array_to_string(list_reverse(string_split(host, '.')), '.') AS target FROM req),
keyed AS (SELECT *, string_split(target, '.') AS p, array_to_string(string_split(target, '.')[1:2], '.') AS k FROM rev),
named AS (
  SELECT k, count(DISTINCT brick) AS n_bricks, min(p) AS lo, max(p) AS hi FROM keyed GROUP BY k),
libs AS (
  SELECT k, n_bricks, array_to_string(lo[1:coalesce(nullif(list_position(list_transform(range(1, greatest(len(lo), len(hi)) + 1), lambda i: lo[i] IS NOT DISTINCT FROM hi[i]), false), 0) - 1, len(lo))], '.') AS library
  FROM named)"""


def _requires(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([^/]*)", 1).alias("brick"))
    return p.select("page_id", "brick", F.array_join(F.reverse(F.split("host", r"\.")), ".").alias("target"))


@query(f"WITH {HOSTS} SELECT library, n_bricks FROM libs")
def library_names(spark, sf_dir):
    r = _requires(spark, sf_dir).withColumn("p", F.split("target", r"\.")).withColumn("k", F.array_join(F.slice("p", 1, 2), "."))
    g = r.groupBy("k").agg(F.countDistinct("brick").alias("n_bricks"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    return g.select(code.common_prefix(F.col("lo"), F.col("hi")).alias("library"), "n_bricks")


@query(
    """WITH req AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/]*)', 1) AS brick, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
r AS (SELECT *, string_split(host, '.') AS p FROM req), k AS (SELECT *, p[1] AS key FROM r),
n AS (SELECT key, count(DISTINCT brick) AS n_bricks FROM k GROUP BY key)
SELECT key AS library_key, k.brick, n_bricks, min(page_id) AS first_page FROM k JOIN n USING (key) WHERE n_bricks > 1 GROUP BY 1, 2, 3"""
)
def library_spread(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://[^/]+/([^/]*)", 1).alias("brick"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("target"), F.lit("").alias("file"), F.col("page_id").alias("line"), F.col("page_id").alias("ord"), F.lit(False).alias("is_js"))
    found = code.libraries(p).filter("n_bricks > 1")
    return found.select(F.split_part("library", F.lit("."), F.lit(1)).alias("library_key"), "brick", "n_bricks", F.col("line").alias("first_page"))


# Requires of every kind: own namespaces, the language's, the toolkit's, libraries by namespace and by package.
KINDS = """req AS (SELECT l_suppkey AS file, l_partkey % 50 AS n, l_partkey AS p, l_orderkey AS o FROM lineitem),
named AS (SELECT DISTINCT file, CASE n % 10 WHEN 0 THEN 'clojure.string' WHEN 1 THEN 'clojure.core' || n WHEN 2 THEN 'goog' WHEN 3 THEN 'goog.dom.' || n WHEN 4 THEN 'top.part' || n WHEN 5 THEN 'topless.x' || n
  WHEN 6 THEN 'google.x' || n WHEN 7 THEN 'react-' || n WHEN 8 THEN 'com.acme.lib' || n || '.core' ELSE '@scope/pack' || n || '/sub' END AS target, n % 10 IN (7, 9) AS is_js FROM req)"""


@query(f"WITH {KINDS} SELECT target, count(*) AS files FROM named WHERE is_js OR NOT (target IN ('clojure.string', 'goog', 'top') OR starts_with(target, 'goog.') OR starts_with(target, 'top.')) GROUP BY 1")
def external_targets(spark, sf_dir):
    sold = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 50).alias("n")).distinct()
    t, kind = F.col("n").cast("string"), F.col("n") % 10
    shapes = [F.lit("clojure.string"), F.concat(F.lit("clojure.core"), t), F.lit("goog"), F.concat(F.lit("goog.dom."), t), F.concat(F.lit("top.part"), t), F.concat(F.lit("topless.x"), t), F.concat(F.lit("google.x"), t), F.concat(F.lit("react-"), t), F.concat(F.lit("com.acme.lib"), t, F.lit(".core")), F.concat(F.lit("@scope/pack"), t, F.lit("/sub"))]
    named = sold.select("file", F.element_at(F.array(*shapes), (kind + 1).cast("int")).alias("target"), kind.isin(7, 9).alias("is_js")).distinct()
    return named.filter(code.is_external(F.col("target"), F.col("is_js"), "top")).groupBy("target").agg(F.count("*").alias("files"))


@query("SELECT source, count(*) FILTER (WHERE l.doc_id IS NULL) AS untested, round(count(*) FILTER (WHERE l.doc_id IS NULL)::DOUBLE / count(*), 6) AS share FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source")
def untested_items(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "source")
    left = d.join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("untested"))
    return d.groupBy("source").agg(F.count("*").alias("n")).join(left, "source", "left").fillna(0, ["untested"]).select("source", "untested", F.round(F.col("untested").cast("double") / F.col("n"), 6).alias("share"))


@query("SELECT p_brand, count(*) AS used FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey AND s_nationkey = 3) GROUP BY p_brand")
def semi_used_items(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    used = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(s, "l_suppkey", "left_semi").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return _t(spark, sf_dir, "part").join(used, "p_partkey", "left_semi").groupBy("p_brand").agg(F.count("*").alias("used"))


@query("SELECT n_name AS brick, round(count(*) FILTER (WHERE c_nationkey = s_nationkey)::DOUBLE / count(*), 6) AS cohesion FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def cohesion_share(spark, sf_dir):
    found = stats.share(_sales(spark, sf_dir), ["src"], F.col("c_nationkey") == F.col("s_nationkey"), "cohesion")
    return found.select(F.col("src").alias("brick"), F.round("cohesion", 6).alias("cohesion"))


@query(
    """WITH u AS (SELECT user_id, event_type AS alias, min(event_id) AS first_at FROM events GROUP BY 1, 2),
s AS (SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 'click' WHEN user_id % 3 = 1 THEN 'purchase' ELSE 'no' END AS symbol FROM events)
SELECT s.user_id, symbol, coalesce(o.first_at, (SELECT min(first_at) FROM u WHERE u.user_id = s.user_id AND alias = 'view')) AS target
FROM s LEFT JOIN u o ON o.user_id = s.user_id AND o.alias = symbol"""
)
def alias_resolution(spark, sf_dir):
    u = _t(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("alias")).agg(F.min("event_id").alias("at"))
    m = F.col("user_id") % 3
    s = u.select("user_id").distinct().withColumn("symbol", F.when(m == 0, "click").when(m == 1, "purchase").otherwise("no"))
    own = u.select("user_id", F.col("alias").alias("symbol"), F.col("at").alias("a"))
    other = u.filter("alias = 'view'").select("user_id", F.col("at").alias("b"))
    return s.join(own, ["user_id", "symbol"], "left").join(other, "user_id", "left").select("user_id", "symbol", F.coalesce("a", "b").alias("target"))


@query(
    """WITH n AS (SELECT c_mktsegment AS k, n_name AS v, count(*) AS n, min(c_custkey) AS f FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, f) AS r FROM n) SELECT k AS brick, v AS own FROM r WHERE r = 1"""
)
def own_segment_mode(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("brick"), F.col("n_name").alias("own"), "c_custkey")
    return graph.mode_first(c, "brick", "own", "c_custkey")


# -- statistics and thresholds ---------------------------------------------------------------------

VALUES = """vals AS (
  SELECT n_name AS brick, CASE WHEN n_regionkey = 0 THEN 'base' ELSE 'component' END AS type, 'revenue' AS metric, avg(l_extendedprice * (1 - l_discount)) AS value, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2
  UNION ALL SELECT n_name, CASE WHEN n_regionkey = 0 THEN 'base' ELSE 'component' END, 'balance', avg(c_acctbal), count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
loo AS (SELECT a.metric, a.brick, a.type, a.value, avg(b.value) AS mean, stddev_samp(b.value) AS sd, count(b.value) AS peers FROM vals a JOIN vals b ON a.metric = b.metric AND a.brick <> b.brick GROUP BY 1, 2, 3, 4)"""


def _values(spark, sf_dir):
    nation = _nodes(spark, sf_dir).withColumnRenamed("ord", "k")
    lines = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("k"))
    a = lines.groupBy("brick", "type").agg(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"), F.count("*").alias("n")).withColumn("metric", F.lit("revenue"))
    b = _t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("k")).groupBy("brick", "type").agg(F.avg("c_acctbal").alias("value"), F.count("*").alias("n")).withColumn("metric", F.lit("balance"))
    return a.unionByName(b)


@query(f"WITH {VALUES} SELECT metric, brick, round(value, 3) AS value FROM (SELECT metric, brick, value FROM vals UNION ALL SELECT metric, NULL, avg(value) FROM vals GROUP BY metric)")
def section_average(spark, sf_dir):
    return stats.with_average(_values(spark, sf_dir).select("metric", "brick", "value")).withColumn("value", F.round("value", 3))


@query(f"WITH {VALUES} SELECT metric, brick, round((value - mean) / sd, 5) AS z, peers FROM loo WHERE sd > 0 AND peers >= 3 AND (value - mean) / sd >= 1.5")
def leave_one_out_outliers(spark, sf_dir):
    v = _values(spark, sf_dir).select("metric", "brick", "value")
    kinds = spark.createDataFrame([("revenue", "max"), ("balance", "max")], "metric string, direction string")
    return stats.outliers(v, kinds, 1.5).select("metric", "brick", F.round("z", 5).alias("z"), "peers")


def _registry(spark, kind):
    rows = [("revenue", "max", ["base", "component"], kind, 0, "money"), ("balance", "min", ["component"], kind, 1, "money")]
    return spark.createDataFrame(rows, REGISTRY)


def _settings(spark, rows):
    return spark.createDataFrame(rows, SETTINGS)


@query(
    f"""WITH {VALUES} SELECT metric, brick, 'warning' AS level, round(mean + k * sd, 4) AS "limit" FROM (SELECT *, CASE WHEN metric = 'revenue' THEN 1.0 ELSE -1.2 END AS k FROM loo)
WHERE peers >= 3 AND ((metric = 'revenue' AND value > mean + k * sd) OR (metric = 'balance' AND value < mean + k * sd))"""
)
def std_dev_violations(spark, sf_dir):
    v = _values(spark, sf_dir).withColumn("applies", F.lit(True))
    s = _settings(spark, [("revenue", "warning", 1, None, 1.0, 3), ("balance", "warning", 1, None, 1.2, 3)])
    return thresholds.brick_violations(v, _registry(spark, "brick"), s).select("metric", "brick", "level", F.round("limit", 4).alias("limit"))


LIMITS = f"""{VALUES}, hit AS (
  SELECT metric, brick, type, value, CASE WHEN metric = 'revenue' THEN CASE WHEN value > 36500 THEN 'error' WHEN value > 35500 THEN 'warning' END ELSE CASE WHEN value < 4200 THEN 'error' WHEN value < 4600 THEN 'warning' END END AS level
  FROM vals WHERE metric = 'revenue' OR type = 'component')"""


def _limit_hits(spark, sf_dir):
    v = _values(spark, sf_dir).withColumn("applies", (F.col("metric") == "revenue") | (F.col("type") == "component"))
    s = _settings(spark, [("revenue", "error", 0, 36500.0, None, None), ("revenue", "warning", 1, 35500.0, None, None), ("balance", "error", 0, 4200.0, None, None), ("balance", "warning", 1, 4600.0, None, None)])
    return thresholds.brick_violations(v, _registry(spark, "brick"), s)


@query(f"WITH {LIMITS} SELECT metric, brick, level FROM hit WHERE level IS NOT NULL")
def limit_violations(spark, sf_dir):
    return _limit_hits(spark, sf_dir).select("metric", "brick", "level")


# Suppliers as bricks, with measures that say which of their metrics count.
@query(
    """WITH w AS (SELECT s_name AS brick, CASE WHEN s_nationkey % 5 = 0 THEN 'base' ELSE 'component' END AS type, s_suppkey % 9 AS functions, s_suppkey % 17 AS refs, s_suppkey % 23 AS tests, s_acctbal AS v FROM supplier)
SELECT brick, metric, value, applies FROM (
  SELECT brick, 'mean-function-complexity' AS metric, v AS value, functions >= 5 AS applies FROM w UNION ALL SELECT brick, 'cohesion', v, type = 'component' AND refs >= 10 FROM w
  UNION ALL SELECT brick, 'assertions-per-test', v, type = 'component' AND tests >= 10 FROM w UNION ALL SELECT brick, 'afferent', CASE WHEN type = 'component' THEN refs::DOUBLE END, type = 'component' FROM w
  UNION ALL SELECT brick, 'functions', functions::DOUBLE, true FROM w UNION ALL SELECT brick, 'tests', tests::DOUBLE, true FROM w)"""
)
def gated_values(spark, sf_dir):
    key, v = F.col("s_suppkey"), F.col("s_acctbal")
    wide = _t(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("brick"), F.when(F.col("s_nationkey") % 5 == 0, "base").otherwise("component").alias("type"), (key % 9).alias("functions"), (key % 17).alias("workspace-references"), (key % 23).alias("tests"),
        (key % 17).alias("afferent"), v.alias("mean-function-complexity"), v.alias("cohesion"), v.alias("assertions-per-test"),
    )
    return thresholds.metric_values(wide).select("brick", "metric", "value", "applies")


# Display rows: functions are parts (a part is one row, whatever it exceeds), bricks are brands.
ROWS = """bricks AS (SELECT p_brand AS brick, row_number() OVER (ORDER BY p_brand) AS ord FROM (SELECT DISTINCT p_brand FROM part)),
v AS (
  SELECT 'size' AS section, 0 AS mo, 'function-complexity' AS metric, p_brand AS brick, p_partkey AS ord, 0 AS lo, (p_size - 40) / 40.0::DOUBLE AS excess FROM part WHERE p_size > 40
  UNION ALL SELECT 'size', 2, 'function-forms', p_brand, p_partkey, 1, (length(p_name) - 10) / 10.0::DOUBLE FROM part WHERE length(p_name) > 10
  UNION ALL SELECT 'price', 4, 'price', p_brand, p_partkey, CASE WHEN p_retailprice > 990 THEN 0 ELSE 1 END, (p_retailprice - CASE WHEN p_retailprice > 990 THEN 990 ELSE 950 END) / CASE WHEN p_retailprice > 990 THEN 990 ELSE 950 END FROM part WHERE p_retailprice > 950),
g AS (SELECT section, brick, ord, min(mo) AS mo, min(lo) AS lo, coalesce(max(excess) FILTER (WHERE lo = 0), max(excess)) AS excess, string_agg(metric, ',' ORDER BY mo) AS metrics FROM v GROUP BY section, brick, ord),
rows_ AS (SELECT section, g.brick, g.ord, CASE lo WHEN 0 THEN 'error' ELSE 'warning' END AS level, metrics, row_number() OVER (ORDER BY lo, excess DESC, g.brick, mo, bricks.ord, g.ord) AS rank FROM g JOIN bricks ON g.brick = bricks.brick)"""


def _display_rows(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    brands = part.select(F.col("p_brand").alias("brick")).distinct().select("brick", F.lit("component").alias("type"), F.concat(F.lit("parts/"), "brick").alias("dir"))
    bricks = order.numbered(brands, [F.asc("brick")], "ord")
    registry = spark.createDataFrame([(k, "max", ["component"], "function", i, "size") for i, k in enumerate(("function-complexity", "function-depth", "function-forms", "function-params"))] + [("price", "max", ["component"], "finding", 4, "price")], REGISTRY)
    limits = _settings(spark, [("function-complexity", "error", 0, 40.0, None, None), ("function-forms", "warning", 1, 10.0, None, None), ("price", "error", 0, 990.0, None, None), ("price", "warning", 1, 950.0, None, None)])
    own = F.col("p_brand").alias("brick"), F.lit("component").alias("type"), F.col("p_partkey").alias("ord")
    name = F.col("p_partkey").cast("string")
    functions = part.select(*own, F.lit("f").alias("file"), name.alias("id"), name.alias("name"), F.col("p_partkey").cast("int").alias("line"), F.lit(1).alias("depth_line"), F.col("p_size").alias("complexity"), F.lit(0).alias("depth"), F.length("p_name").alias("forms"), F.lit(0).alias("params"))
    findings = part.select(*own, F.lit("price").alias("metric"), name.alias("subject"), F.col("p_retailprice").alias("value"), F.lit("costs much").alias("message"))
    found = thresholds.shaped(thresholds.function_violations(functions, registry, limits), registry)
    found = found.unionByName(thresholds.shaped(thresholds.finding_violations(findings, registry, limits), registry))
    return thresholds.rows(found, bricks)


def _row_columns():
    first = F.col("violations")[0]
    return "section", first["brick"].alias("brick"), F.col("subject").cast("long").alias("part"), "level"


@query(f"WITH {ROWS} SELECT rank, section, brick, ord AS part, level, metrics FROM rows_")
def violation_rows_ranked(spark, sf_dir):
    rows = _display_rows(spark, sf_dir)
    return rows.select("rank", *_row_columns(), F.array_join(F.transform("violations", lambda v: v["metric"]), ",").alias("metrics"))


@query(f"WITH {ROWS} SELECT section, brick, ord AS part, level, row_number() OVER (PARTITION BY section ORDER BY rank) <= 20 AS is_shown FROM rows_")
def top20_per_section(spark, sf_dir):
    return display.with_shown(_display_rows(spark, sf_dir)).select(*_row_columns(), "is_shown")


@query(f"WITH {ROWS} SELECT rank, section, brick, ord AS part, level FROM rows_ WHERE rank <= 20")
def top20_rows(spark, sf_dir):
    return _display_rows(spark, sf_dir).filter("rank <= 20").select("rank", *_row_columns())


@query(f"WITH {ROWS}, x AS (SELECT v.metric, r.level FROM rows_ r JOIN v ON v.section = r.section AND v.brick = r.brick AND v.ord = r.ord) SELECT metric, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings FROM x GROUP BY metric")
def summary_grid(spark, sf_dir):
    return display.grid(_display_rows(spark, sf_dir)).select("metric", "errors", "warnings")


@query(f"WITH {ROWS}, x AS (SELECT v.metric, r.brick, r.level FROM rows_ r JOIN v ON v.section = r.section AND v.brick = r.brick AND v.ord = r.ord) SELECT brick, metric, CASE WHEN bool_or(level = 'error') THEN 'error' ELSE 'warning' END AS level FROM x GROUP BY brick, metric")
def worst_level_per_cell(spark, sf_dir):
    return display.worst(_display_rows(spark, sf_dir))


@query("SELECT p_brand AS brick, avg(p_size)::DOUBLE AS size, round(avg(p_retailprice), 6) AS price, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), ())")
def brick_means(spark, sf_dir):
    means = stats.means(_t(spark, sf_dir, "part"), "p_brand", {"size": F.col("p_size"), "price": F.col("p_retailprice")})
    return means.select(F.col("p_brand").alias("brick"), "size", F.round("price", 6).alias("price"), "n")


# Paths as suppliers have them: folders of bricks lie in others.
PATHS = """bricks AS (SELECT n_name AS brick, n_nationkey AS ord, CASE WHEN n_nationkey % 3 = 0 THEN 'world/' || r_name WHEN n_nationkey % 3 = 1 THEN 'world/' || r_name || '/' || n_name ELSE 'world/' || r_name || '/' || n_name || '/src/deep' END AS dir FROM nation JOIN region ON n_regionkey = r_regionkey),
files AS (SELECT s_suppkey, 'world/' || r_name || '/' || n_name || CASE s_suppkey % 4 WHEN 0 THEN '/src/deep/src/' WHEN 1 THEN '/test/' WHEN 2 THEN '/src/' ELSE '-not/src/' END || s_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _paths(spark, sf_dir):
    region = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nation = _t(spark, sf_dir, "nation").join(region, "n_regionkey")
    top = F.concat(F.lit("world/"), "r_name")
    third, own = F.col("n_nationkey") % 3, F.concat(top, F.lit("/"), "n_name")
    bricks = nation.select(F.col("n_name").alias("brick"), F.col("n_nationkey").alias("ord"), F.when(third == 0, top).when(third == 1, own).otherwise(F.concat(own, F.lit("/src/deep"))).alias("dir"))
    kind = F.col("s_suppkey") % 4
    part = F.when(kind == 0, "/src/deep/src/").when(kind == 1, "/test/").when(kind == 2, "/src/").otherwise("-not/src/")
    files = _t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(own, part, "s_name").alias("path"))
    return files, bricks


@query(f"WITH {PATHS} SELECT s_suppkey, arg_min(brick, ord) AS brick FROM files JOIN bricks ON starts_with(path, dir || '/') GROUP BY 1")
def path_owners(spark, sf_dir):
    files, bricks = _paths(spark, sf_dir)
    return paths.owners(files, bricks).select("s_suppkey", "brick")


@query(f"WITH {PATHS} SELECT DISTINCT brick FROM files JOIN bricks ON starts_with(path, dir || '/src/')")
def changed_folders(spark, sf_dir):
    files, bricks = _paths(spark, sf_dir)
    return baseline.changed_bricks(bricks, files)


# A supplier leads an order whose first line it serves, and through it reaches the order's other suppliers of its region, and
# all parts of the order: some 10^5 edges at 60,000 line items, whose closure would be far larger.
LED = """sup AS (SELECT s_suppkey AS s, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey),
lines AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, s, r FROM lineitem JOIN sup ON l_suppkey = s),
lead AS (SELECT o, s, r FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n, s) AS i FROM lines) WHERE i = 1),
near AS (SELECT DISTINCT 's' || s AS src, 'o' || o AS dst FROM lead UNION SELECT 'o' || o, 'p' || p FROM lines
  UNION SELECT 'o' || l.o, 's' || l.s FROM lines l JOIN lead d ON l.o = d.o AND l.r = d.r AND l.s <> d.s),
touched AS (SELECT DISTINCT o AS c, 's' || s AS b FROM lines), small AS (SELECT * FROM touched WHERE c IN (SELECT c FROM touched GROUP BY c HAVING count(*) <= 3)),
n AS (SELECT b, count(*) AS n FROM small GROUP BY b),
both_ AS (SELECT x.b AS a, y.b AS b, count(*) AS shared FROM small x JOIN small y ON x.c = y.c AND x.b < y.b GROUP BY 1, 2),
pairs AS (SELECT CASE WHEN na.n <= nb.n THEN a ELSE both_.b END AS fewer, CASE WHEN na.n <= nb.n THEN both_.b ELSE a END AS more, shared FROM both_ JOIN n na ON na.b = a JOIN n nb ON nb.b = both_.b)"""


@query(
    f"""WITH RECURSIVE {LED},
hops AS (SELECT DISTINCT a.src, b.dst FROM near a JOIN near b ON a.dst = b.src WHERE a.src LIKE 's%' AND b.dst LIKE 's%'),
reach AS (SELECT src, dst FROM hops UNION SELECT reach.src, hops.dst FROM reach JOIN hops ON reach.dst = hops.src)
SELECT fewer, more, shared FROM pairs WHERE NOT EXISTS (SELECT 1 FROM reach WHERE (src = fewer AND dst = more) OR (src = more AND dst = fewer))"""
)
def co_change_hidden(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r"))
    sup = _t(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "r")
    lines = _t(spark, sf_dir, "lineitem").join(sup, "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "r")
    lead = F.min(F.struct("l_linenumber", "l_suppkey", "r")).over(Window.partitionBy("l_orderkey"))
    lines = lines.withColumn("lead", lead).filter("l_orderkey is not null").withColumn("near", F.expr("r = lead.r and l_suppkey <> lead.l_suppkey"))
    lines = kept(lines.select("l_orderkey", "l_suppkey", "l_partkey", F.col("lead.l_suppkey").alias("lead"), "near"))  # dealt by order once, in numbers
    dropped(spark)
    name = lambda kind, c: F.concat(F.lit(kind), c)
    edge = lambda df, a, b: df.select(a.alias("from"), b.alias("to"))
    o = name("o", "l_orderkey")
    edges = edge(lines.select("lead", "l_orderkey").distinct(), name("s", "lead"), o).union(edge(lines, o, name("p", "l_partkey")))
    edges = edges.union(edge(lines.filter("near"), o, name("s", "l_suppkey")))
    pairs = graph.co_changes(lines.select(F.col("l_orderkey").alias("commit"), name("s", "l_suppkey").alias("brick")), 3)
    return graph.unconnected(pairs, "fewer", "more", edges).select("fewer", "more", "shared")


@query(
    """WITH f AS (SELECT 'revenue' AS metric, n_name AS brick, CASE WHEN n_regionkey = 0 THEN 'base' ELSE 'component' END AS type, s_suppkey AS ord FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000),
n AS (SELECT brick, count(*) AS n FROM f GROUP BY brick)
SELECT brick, ord, n::DOUBLE AS value FROM f JOIN n USING (brick) WHERE n > 1"""
)
def count_violations(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").filter("s_acctbal > 5000").join(_nodes(spark, sf_dir).withColumnRenamed("ord", "k"), F.col("s_nationkey") == F.col("k"))
    f = s.select(F.lit("revenue").alias("metric"), "brick", "type", F.col("s_suppkey").alias("ord"), F.lit("owes much").alias("message"))
    found = thresholds.count_violations(f, _registry(spark, "count"), _settings(spark, [("revenue", "warning", 1, 1.0, None, None)]))
    return found.select("brick", "ord", "value")


@query("SELECT o_orderkey AS ord, CASE WHEN o_totalprice > 400000 THEN 'error' ELSE 'warning' END AS level FROM orders WHERE o_totalprice > 350000")
def finding_violations(spark, sf_dir):
    f = _t(spark, sf_dir, "orders").select(F.lit("revenue").alias("metric"), F.lit("component").alias("type"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ord"), F.lit("costs much").alias("message"))
    found = thresholds.finding_violations(f, _registry(spark, "finding"), _settings(spark, [("revenue", "error", 0, 400000.0, None, None), ("revenue", "warning", 1, 350000.0, None, None)]))
    return found.select("ord", "level")


@query(
    """WITH f AS (SELECT p_partkey, p_brand, p_size AS complexity, length(p_name) AS forms FROM part)
SELECT 'function-complexity' AS metric, p_partkey AS ord, complexity::DOUBLE AS value FROM f WHERE complexity > 40
UNION ALL SELECT 'function-forms', p_partkey, forms::DOUBLE FROM f WHERE forms > 10"""
)
def function_violations(spark, sf_dir):
    f = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("brick"), F.lit("component").alias("type"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.lit(1).alias("line"), F.lit(1).alias("depth_line"), F.col("p_size").alias("complexity"), F.lit(0).alias("depth"), F.length("p_name").alias("forms"), F.lit(0).alias("params"))
    rows = [(k, "max", ["component"], "function", i, "s") for i, k in enumerate(("function-complexity", "function-depth", "function-forms", "function-params"))]
    s = _settings(spark, [("function-complexity", "error", 0, 40.0, None, None), ("function-forms", "warning", 1, 10.0, None, None)])
    return thresholds.function_violations(f, spark.createDataFrame(rows, REGISTRY), s).select("metric", "ord", "value")


@query(
    """WITH v AS (SELECT n_name AS brick, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), h AS (SELECT brick, n::DOUBLE AS value FROM v)
SELECT brick, CASE WHEN value % 2 = 0 THEN value::BIGINT::VARCHAR || ' is over the limit of 1' ELSE (value::BIGINT)::VARCHAR || ' is over the limit of 1' END AS message FROM h WHERE value > 1"""
)
def conditional_message(spark, sf_dir):
    v = _t(spark, sf_dir, "customer").join(_nodes(spark, sf_dir).withColumnRenamed("ord", "k"), F.col("c_nationkey") == F.col("k")).groupBy("brick", "type").agg(F.count("*").cast("double").alias("value"))
    v = v.withColumns({"metric": F.lit("revenue"), "applies": F.lit(True)})
    return thresholds.brick_violations(v, _registry(spark, "brick"), _settings(spark, [("revenue", "warning", 1, 1.0, None, None)])).select("brick", "message")


# -- snapshots -------------------------------------------------------------------------------------

SNAP = """sold AS (SELECT p_brand AS brick, l_returnflag || l_linestatus || l_linenumber AS subject, l_quantity AS q, l_discount AS d, o_orderdate AS day FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
head AS (SELECT brick, subject, avg(d) AS value FROM sold GROUP BY 1, 2 HAVING avg(d) > 0.051),
base AS (SELECT brick, subject, avg(d) AS value FROM sold WHERE day < TIMESTAMP '1997-01-01' GROUP BY 1, 2 HAVING avg(d) > 0.051)"""


def _snapshots(spark, sf_dir):
    """Head: subjects of all line items whose mean discount is large; base: those of orders before a date."""
    lines = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.withColumn("subject", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")))

    def of(rows):
        g = rows.groupBy(F.col("p_brand").alias("brick"), "subject").agg(F.avg("l_discount").alias("value")).filter("value > 0.051D")
        null = F.lit(None)
        return g.select("brick", F.lit("discount").alias("metric"), "subject", "value", F.lit("finding").alias("kind"), F.lit("max").alias("direction"), null.cast("boolean").alias("historical"), F.lit("m").alias("message"))

    return of(lines), of(lines.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")))


@query(
    f"""WITH {SNAP} SELECT h.brick, h.subject, CASE WHEN b.brick IS NOT NULL THEN 'existing' WHEN h.brick LIKE '%1' THEN 'new' ELSE 'indirect' END AS status
FROM head h LEFT JOIN base b ON h.brick = b.brick AND h.subject = b.subject"""
)
def snapshot_status(spark, sf_dir):
    head, base = _snapshots(spark, sf_dir)
    changed = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("brick")).filter("brick like '%1'").distinct()
    values = base.select("brick", "metric", "value")
    functions = spark.createDataFrame([], "brick string, id string, complexity int, depth int, forms int, params int")
    return baseline.compare(head, base, changed, values, functions).select("brick", "subject", "status")


@query(f"WITH {SNAP} SELECT b.brick, b.subject FROM base b WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.brick = b.brick AND h.subject = b.subject)")
def resolved(spark, sf_dir):
    head, base = _snapshots(spark, sf_dir)
    return baseline.resolved(base, head).select("brick", "subject")


# Functions are parts, whose base measures were smaller for two of three; findings are prices, some of them historical.
@query(
    """SELECT p_partkey AS part, 'function-complexity' AS metric, CASE WHEN p_partkey % 3 = 0 THEN 'existing' ELSE 'new' END AS status, (p_size - p_partkey % 3)::DOUBLE AS base_value,
  p_size || ' is over the limit of 40' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' (was ' || (p_size - p_partkey % 3) || ')' END AS message FROM part WHERE p_size > 40
UNION ALL SELECT p_partkey, 'price', CASE WHEN p_partkey % 2 = 0 THEN 'existing' WHEN p_brand LIKE '%1' THEN 'new' ELSE 'indirect' END, NULL, 'costs much (over the limit of 950)' FROM part WHERE p_retailprice > 950"""
)
def worsened_status(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    own = F.col("p_brand").alias("brick"), F.lit("component").alias("type"), F.col("p_partkey").alias("ord")

    def measured(complexity):
        return part.select(*own, key.alias("id"), key.alias("name"), F.lit("f").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("depth_line"), complexity.alias("complexity"), F.lit(0).alias("depth"), F.lit(0).alias("forms"), F.lit(0).alias("params"))

    registry = spark.createDataFrame([("function-complexity", "max", ["component"], "function", 0, "s"), ("price", "max", ["component"], "finding", 1, "s")], REGISTRY)
    limits = _settings(spark, [("function-complexity", "error", 0, 40.0, None, None), ("price", "warning", 1, 950.0, None, None)])
    was = measured((F.col("p_size") - F.col("p_partkey") % 3).cast("int"))
    found = part.select(*own, F.lit("price").alias("metric"), key.alias("subject"), F.col("p_retailprice").alias("value"), F.lit("costs much").alias("message"), (F.col("p_partkey") % 2 == 0).alias("historical"))
    head = thresholds.shaped(thresholds.function_violations(measured(F.col("p_size")), registry, limits), registry)
    head = head.unionByName(thresholds.shaped(thresholds.finding_violations(found, registry, limits), registry))
    base = thresholds.shaped(thresholds.function_violations(was, registry, limits), registry)
    changed = part.select(F.col("p_brand").alias("brick")).filter("brick like '%1'").distinct()
    values = base.select("brick", "metric", "value").limit(0)
    return baseline.compare(head, base, changed, values, was).select(F.col("subject").cast("long").alias("part"), "metric", "status", "base_value", "message")


OLD_EDGES = EDGES[: EDGES.index("ca AS")].rstrip().rstrip(",")


@query(
    f"""WITH {OLD_EDGES}, old_flow AS (
  SELECT c_nationkey AS f, s_nationkey AS t, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1, 2),
old_usual AS (SELECT f, t, q, avg(q) OVER (PARTITION BY f) AS m FROM old_flow),
old AS (SELECT a.n_name AS src, b.n_name AS dst FROM old_usual JOIN nation a ON f = a.n_nationkey JOIN nation b ON t = b.n_nationkey WHERE q > 1.25::DOUBLE * m)
SELECT src, dst, NOT EXISTS (SELECT 1 FROM old WHERE old.src = edges.src AND old.dst = edges.dst) AS is_new FROM edges"""
)
def new_edges(spark, sf_dir):
    sales = _sales(spark, sf_dir)
    old = _edges(spark, sf_dir, sales.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")))
    return baseline.new_edges(_edges(spark, sf_dir, sales), old).select(F.col("from").alias("src"), F.col("to").alias("dst"), "is_new")


# -- source facts ----------------------------------------------------------------------------------


@query(
    """SELECT n_name AS brick, (3 + 13 * count(s_suppkey))::BIGINT AS forms, count(s_suppkey)::BIGINT AS functions, (3 * count(s_suppkey))::BIGINT AS complexity
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"""
)
def source_facts(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("s_suppkey").cast("int").alias("n"))
    body = F.concat(F.lit("(ns top.own) ; facts\n"), F.expr("repeat('(defn f [x y] #_skipped (when x (and x y)))\n', n)"))
    null = F.lit(None).cast("string")
    files = n.select(F.col("n_name").alias("brick"), null.alias("type"), null.alias("dir"), F.col("n_name").alias("file"), F.lit(False).alias("is_test"), F.lit(0).alias("ord"), body.alias("source"))
    total = F.aggregate(F.transform("functions", lambda f: f["complexity"]), F.lit(0), lambda a, x: a + x)
    return extract(files).select("brick", "forms", F.size("functions").cast("long").alias("functions"), total.cast("long").alias("complexity"))


# Seven shapes of forms with sizes from the data: nested conditions, clauses, connectives, arities, modifiers, cases, threads.
SHAPES = """shape AS (SELECT s_suppkey AS k, s_nationkey % 7 AS kind, s_suppkey % 9 + 1 AS n FROM supplier),
counted AS (SELECT k, CASE kind
  WHEN 0 THEN 5 + 3 * n WHEN 1 THEN 9 + 2 * n WHEN 2 THEN 7 + n WHEN 3 THEN 3 + 4 * n WHEN 4 THEN 11 + 2 * n WHEN 5 THEN 10 + 4 * n ELSE 8 + 2 * n END AS forms,
  CASE kind WHEN 0 THEN 1 + n WHEN 1 THEN 1 + n WHEN 2 THEN greatest(n, 1) WHEN 3 THEN n WHEN 4 THEN 1 + n WHEN 5 THEN 1 + 2 * n ELSE 1 + n END AS complexity FROM shape)"""


@query(f"WITH {SHAPES} SELECT k AS file, (7 + forms)::BIGINT AS file_forms, forms::BIGINT AS forms, complexity::BIGINT AS complexity FROM counted")
def token_tree_forms(spark, sf_dir):
    rep = lambda text: F.expr(f"repeat('{text}', n)")
    two = lambda before, middle, after: F.concat(F.lit(before), middle, F.lit(after))
    shapes = [
        F.concat(F.lit("(defn f [] "), rep("(if x "), F.lit("1"), rep(")"), F.lit(")")),
        two("(defn f [x] (cond ", rep("x 1 "), ":else 2))"),
        two("(defn f [x] (and ", rep("x "), "))"),
        two("(defn f ", rep("([x] x) "), ")"),
        two("(defn f [x] (for [y x ", rep(":when y "), "] y))"),
        F.concat(F.lit("(defn f [x] (do 1 "), rep("(if-not (while) "), F.lit("2"), rep(")"), F.lit(" 3))")),
        two("(defn f [x] (cond-> x ", rep("x inc "), "))"),
    ]
    text = shapes[-1]
    for i, s in enumerate(shapes[:-1]):
        text = F.when(F.col("kind") == i, s).otherwise(text)
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_nationkey") % 7).alias("kind"), (F.col("s_suppkey") % 9 + 1).cast("int").alias("n"))
    table = kept(trees.nodes(rows.select("file", F.concat(F.lit("(ns a.b) ; the file\n(def x 1)\n"), text).alias("source"))))
    found = trees.function_measures(table).join(trees.file_forms(table).withColumnRenamed("forms", "file_forms"), "file")
    return found.select("file", "file_forms", F.col("forms").cast("long").alias("forms"), "complexity")
