"""Workspaces end to end, thresholds, comparison, reports and the command line."""

import os
import subprocess

import pytest

from brickyard import cli
from brickyard.operators import code, graph, stats
from brickyard.plans import baseline, display, report, source_suite, suite, thresholds, workspace_suite
from brickyard.plans.config import ConfigError, SETTINGS, merge_config, settings_frame
from brickyard.plans.registry import METRICS, Metric, register_metric
from brickyard.sources.workspace import Tree

FILES = {
    "workspace.edn": '{:top-namespace "top"}',
    "components/store/src/top/store/interface.clj": "(ns top.store.interface (:require [top.store.core :as core]))\n(defn save [a b c d e] (core/save a))\n(defn- hidden [] 1)\n(def limit 3)",
    "components/store/src/top/store/core.clj": '(ns top.store.core (:require [next.jdbc :as jdbc] [next.jdbc.sql]))\n(def state (atom {}))\n(defn save [x] (throw (ex-info "no" {})))\n(defn load [x] (try x (catch Exception e nil)))',
    "components/store/test/top/store/core_test.clj": "(ns top.store.core-test (:require [top.store.interface :as store] [clojure.test :refer [deftest is]]))\n(deftest saves (is (store/save 1 2 3 4 5)))",
    "components/store/notes.txt": "not code",
    "components/user/src/top/user/interface.clj": "(ns top.user.interface (:require [top.store.interface :as store] [next.jdbc :as j] [clojure.string :as str]))\n(defn add [x] (store/save 1 2 3 4 5) :user/added)",
    "components/user/test/top/user/reach_test.clj": "(ns top.user.reach-test (:require [top.store.core :as inner]))\n(deftest reach (is inner/state))",
    "components/empty/deps.edn": "{}",
    "bases/web/src/top/web/main.clj": "(ns top.web.main (:require [top.user.interface :as user]))\n(defn -main [x] (if x (user/add x) :user/added))",
}


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("ws")
    write(folder, FILES)
    return str(folder)


@pytest.fixture(scope="module")
def measured(spark, root):
    return cli.Measured(Tree(spark, root), merge_config())


def test_edges_and_metrics(measured):
    edges = {(r["from"], r["to"], r["interface"], r["line"]) for r in measured.tables.edges.collect()}
    assert edges == {("user", "store", "store", 1), ("web", "user", "user", 1)}
    m = {r["brick"]: r.asDict() for r in measured.wide.collect()}
    assert set(m) == {"web", "empty", "store", "user"}
    assert (m["store"]["afferent"], m["store"]["efferent"], m["store"]["instability"]) == (1, 0, 0.0)
    assert m["web"]["instability"] == 1.0 and m["empty"]["instability"] is None and m["empty"]["forms"] == 0
    assert m["store"]["definitions"] == 6 and m["store"]["abstractness"] == pytest.approx(1 - 2 / 6)
    assert m["store"]["error-surface"] == 0.5 and m["user"]["error-surface"] == 1.0  # through the alias, across bricks
    assert m["store"]["untested-interface"] == 0.5 and m["web"]["untested-interface"] is None
    assert m["user"]["shared-keywords"] == 1 and m["store"]["shared-keywords"] == 0
    assert m["store"]["libraries"] == 1 and m["user"]["libraries"] == 1
    assert m["store"]["cohesion"] == 1.0 and m["user"]["cohesion"] == 0.0
    assert m["store"]["tests"] == 1 and m["store"]["assertions-per-test"] == 1.0


def test_libraries(measured):
    rows = {(r["library"], r["brick"], r["n_bricks"]) for r in measured.tables.libraries.collect()}
    assert rows == {("next.jdbc", "store", 2), ("next.jdbc", "user", 2)}


def test_findings_and_violations(measured):
    found = {(r["metric"], r["brick"], r["subject"]): r["message"] for r in measured.findings.collect()}
    assert found["positional-interface", "store", "save"] == "callers in other bricks must know the order of its 5 arguments; named ones in a map would bind them less"
    assert found["mutable-state", "store", "state"] == "holds state in an atom (internal: results depend on what was called before)"
    assert ("boundary-crossings", "user", "components/user/test/top/user/reach_test.clj top.store.core") in found
    assert found["merge-candidate", "store", "user"].startswith("serves user alone and has ")
    assert found["library-spread", "user", "next.jdbc"] == "next.jdbc is used here and by store"
    hit = {(r["metric"], r["brick"]): r for r in measured.violations.collect()}
    assert hit["function-params", "store"]["subject"] == "top.store.interface/save" and hit["function-params", "store"]["message"] == "5 is over the limit of 4"
    assert hit["mutable-state", "store"]["value"] == 1 and ("library-spread", "user") not in hit
    assert {("untyped-errors", "store"), ("broad-catches", "store"), ("boundary-crossings", "user"), ("positional-interface", "store")} <= set(hit)
    values = {(r["brick"], r["metric"]): (r["value"], r["subject"]) for r in measured.values.collect()}
    assert values["store", "mutable-state"] == (1.0, None) and values["web", "positional-interface"] == (None, None)
    assert values["store", "merge-candidate"][1] == "user" and values["user", "duplicate-code"] == (0.0, None)


def test_cli_text_and_exit(spark, root, capsys):
    assert cli.run(["-w", root, "-f", "text"], {}, spark) == 0
    out = capsys.readouterr().out
    assert out.startswith("brickyard: 4 bricks checked, 0 errors, ") and out.endswith("warnings left out (use --warnings)\n")
    strict = os.path.join(root, "strict.edn")
    write(root, {"strict.edn": "{:complexity {:function-complexity {:error 1}}}"})
    assert cli.run(["-w", root, "-c", strict, "-f", "text"], {}, spark) == 1
    out = capsys.readouterr().out
    assert out.startswith("Complexity (2)\n") and "bases/web/src/top/web/main.clj:2: error: Functions: -main: complexity 2 (at most 1)\n" in out
    assert cli.run(["-w", root, "-c", strict, "-f", "text", "--no-fail"], {}, spark) == 0
    capsys.readouterr()


def test_cli_errors(spark, root, tmp_path, capsys):
    assert cli.run(["-w", str(tmp_path)], {}, spark) == 2
    assert cli.run(["-w", root, "-c", "missing.edn"], {}, spark) == 2
    assert cli.run(["-w", root, "-f", "pdf"], {}, spark) == 2
    assert cli.run(["--help"], {}, spark) == 0
    write(root, {"bad.edn": "{:complexity {:no-such {:error 1}}}"})
    assert cli.run(["-w", root, "-c", os.path.join(root, "bad.edn")], {}, spark) == 2
    assert "complexity / no-such: no metric has this name" in capsys.readouterr().err


def test_cli_github_and_html(spark, root, tmp_path, capsys):
    summary, page = tmp_path / "summary.md", tmp_path / "out" / "page.html"
    args = ["-w", root, "-f", "github", "-f", "html", "-o", str(page), "--warnings"]
    assert cli.run(args, {"GITHUB_STEP_SUMMARY": str(summary)}, spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert any(x.startswith("::warning file=components/store/src/top/store/core.clj,line=2,title=component store%3A Mutable state::") for x in lines)
    assert any(x.startswith("::warning file=components/store/deps.edn,line=1,title=component store%3A Merge into::") for x in lines) or not any("Merge into" in x for x in lines)
    text = summary.read_text()
    assert "```mermaid\ngraph TD\n" in text and "| **Average** |" in text and "next.jdbc" in text
    html = page.read_text()
    assert "<h1>" in html and "class=\"mermaid\"" in html and "Thresholds" in html


def test_cli_base(spark, tmp_path, capsys):
    write(tmp_path, FILES)
    git(tmp_path, "init", "-q", "-b", "main")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "one")
    git(tmp_path, "branch", "start")
    worse = FILES["bases/web/src/top/web/main.clj"].replace("(if x (user/add x) :user/added)", "(if x (if x (user/add x) 2) 3)")
    write(tmp_path, {"bases/web/src/top/web/main.clj": worse, "brickyard.edn": "{:complexity {:function-complexity {:error 1}}}", "components/store/src/top/store/more.clj": "(ns top.store.more) (def other (ref 1))"})
    assert cli.run(["-w", str(tmp_path), "-b", "start", "-f", "text", "--warnings"], {}, spark) == 1
    out = capsys.readouterr().out
    assert "-main: complexity 3 (at most 1)" in out and "more.clj" in out and "core.clj:2: warning: Mutable state" not in out
    assert "checked against start" in out and "older findings left out" in out
    assert cli.run(["-w", str(tmp_path), "-b", "no-such-ref", "-f", "text"], {}, spark) == 2
    capsys.readouterr()


# -- operators -------------------------------------------------------------------------------------


def test_closure_and_reach(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "a string, b string")
    paths = {tuple(r) for r in graph.closure(e).collect()}
    assert paths == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "b"), ("c", "b"), ("c", "c"), ("d", "a"), ("d", "b"), ("d", "c")}
    seeds = spark.createDataFrame([("c",)], "node string")
    assert {r.node for r in graph.reach_back(e, seeds).collect()} == {"a", "b", "c", "d"}


def test_mode_takes_the_first_seen(spark):
    df = spark.createDataFrame([("k", "z", 1), ("k", "a", 2), ("k", "a", 3), ("k", "z", 4), ("j", None, 1)], "k string, v string, o int")
    assert [tuple(r) for r in graph.mode_first(df, "k", "v", "o").collect()] == [("k", "z")]


def test_co_change(spark):
    commits = [(i, b) for i in range(5) for b in "ab"] + [(5, "a"), (6, "a"), (7, "a"), (7, "b"), (7, "c"), (7, "d"), (7, "e"), (7, "f")]
    touched = spark.createDataFrame(commits, "commit long, brick string")
    pairs = graph.co_changes(touched, 5).collect()
    assert [tuple(r) for r in pairs] == [("b", "a", 5, 5, 1.0)]
    linked = spark.createDataFrame([("a", "x"), ("x", "b")], "from string, to string")
    assert graph.unconnected(graph.co_changes(touched, 5), "fewer", "more", linked).count() == 0


def test_spread_keeps_its_last_step_only(spark):
    from brickyard.session import kept

    kept(spark.range(1))
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    left = lambda: {f for f in os.listdir(folder) if f.startswith("rdd-")}
    edges = spark.range(8).selectExpr("id AS a", "id + 1 AS b")
    before = left()
    known = graph._spread(edges, spark.range(9).selectExpr("id AS node", "id AS v"), {"v": True})
    assert len(left() - before) == 1
    assert {tuple(r) for r in known.collect()} == {(i, 8) for i in range(9)}


def test_co_change_counts_a_commits_bricks_once(spark):
    rows = [(1, b) for b in "abcabcabc"] + [(2, b) for b in "abcd"] + [(None, "a"), (None, "b"), (3, "a"), (3, None)]
    pairs = graph.co_changes(spark.createDataFrame(rows, "commit long, brick string"), 3).collect()
    assert sorted((r.fewer, r.more, r.shared, r.changes) for r in pairs) == [("b", "a", 1, 1), ("b", "c", 1, 1), ("c", "a", 1, 1)]


def test_library_names(spark):
    from pyspark.sql import functions as F

    cases = {"clojure.java.io": "clojure.java.io", "clojure.core.async.impl": "clojure.core.async", "babashka.fs.x": "babashka.fs", "com.acme.lib.core": "com.acme.lib", "rewrite-clj.node": "rewrite-clj"}
    df = spark.createDataFrame([(k, False, v) for k, v in cases.items()] + [("@mui/material/Button", True, "@mui/material"), ("react-dom/client", True, "react-dom")], "t string, js boolean, want string")
    assert df.filter(code.library_key(F.col("t"), F.col("js")) != F.col("want")).count() == 0
    p = spark.createDataFrame([(["next", "jdbc"], ["next", "jdbc", "sql"], "next.jdbc"), (["a", "b"], ["a", "c"], "a"), (["q"], ["q"], "q")], "lo array<string>, hi array<string>, want string")
    assert p.filter(code.common_prefix(F.col("lo"), F.col("hi")) != F.col("want")).count() == 0
    x = spark.createDataFrame([("clojure.string", False), ("goog.x", False), ("top.a", False), ("top", False), ("topper.a", False), ("top", True)], "t string, js boolean")
    assert [r[0] for r in x.select(code.is_external(F.col("t"), F.col("js"), "top")).collect()] == [False, False, False, False, True, True]


def test_duplicates_drop_what_is_inside(spark):
    rows = [("a", "f", 1, 50, 1, 9), ("b", "g", 1, 50, 3, 12), ("a", "f", 2, 31, 2, 5), ("b", "g", 2, 31, 4, 7), ("c", "h", 2, 31, 1, 4), ("a", "f", 3, 40, 20, 30), ("a", "f", 3, 40, 40, 50), ("c", "h", 9, 20, 1, 2), ("d", "i", 9, 20, 1, 2)]
    df = spark.createDataFrame(rows, "brick string, file string, hash long, forms int, line int, end_line int")
    assert {(r.brick, r.hash) for r in code.duplicates(df, 30).collect()} == {("a", 1), ("b", 1), ("c", 2)}


def test_leave_one_out(spark):
    v = spark.createDataFrame([("m", f"b{i}", float(x)) for i, x in enumerate([1, 1, 2, 2, 1, 2, 9])], "metric string, brick string, value double")
    kinds = spark.createDataFrame([("m", "max")], "metric string, direction string")
    (one,) = stats.outliers(v, kinds).collect()
    assert one.brick == "b6" and one.mean == 1.5 and one.z == pytest.approx(13.693, abs=1e-3) and one.peers == 6


def _check(spark, values, settings, direction="max", checks=("base", "component")):
    v = spark.createDataFrame([(f"b{i}", "component", "m", float(x), True) for i, x in enumerate(values)], "brick string, type string, metric string, value double, applies boolean")
    registry = spark.createDataFrame([("m", direction, list(checks), "brick", 0, "s")], "metric string, direction string, checks array<string>, kind string, metric_ord int, section string")
    return {r.brick: (r.level, r.message) for r in thresholds.brick_violations(v, registry, spark.createDataFrame(settings, SETTINGS)).collect()}


def test_brick_thresholds(spark):
    both = [("m", "error", 0, 10.0, None, None), ("m", "warning", 1, 5.0, None, None)]
    assert _check(spark, [5, 5.255, 11], both) == {"b1": ("warning", "5.26 is over the limit of 5"), "b2": ("error", "11 is over the limit of 10")}
    assert _check(spark, [0.5, 0.2], [("m", "warning", 1, 0.5, None, None)], "min") == {"b1": ("warning", "0.2 is under the least value of 0.5")}
    spread = [("m", "warning", 1, None, 2.0, 3)]
    hit = _check(spark, [4, 5, 6, 5, 20], spread, checks=("component",))
    assert hit == {"b4": ("warning", "20 lies above the mean 5 of the other 4 components by 18.4 times their deviation of 0.82 (allowed: 2)")}
    assert _check(spark, [4, 5, 20], spread) == {}
    assert _check(spark, [5, 5, 5, 5, 7], spread)["b4"][1] == "7 lies above the value that each other brick has, 5"


def test_rows_group_and_order(spark, measured):
    rows = [r.asDict(recursive=True) for r in display.with_texts(thresholds.rows(measured.violations, measured.tables.bricks)).orderBy("rank").collect()]
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    (function,) = [r for r in rows if r["group"] == "function-rows"]
    assert function["what"] == "params 5 (at most 4)" and function["locations"] == [{"file": "components/store/src/top/store/interface.clj", "line": 2, "name": "save"}]


def test_config():
    merged = merge_config({"complexity": {"function-depth": {"warning": None, "error": 9}, "function-forms": None}, "tests": {"forms-per-test": {"warning": {"std-devs": 3}}}})
    assert merged["function-depth"] == {"warning": None, "error": 9} and merged["function-forms"] is None and merged["co-change"]["min-shared"] == 5
    for bad in ({"x": {}}, {"tests": []}, {"tests": {"forms": {}}}, {"tests": {"nope": {}}}, {"complexity": {"forms": 3}}, {"complexity": {"forms": {"x": 1}}}, {"complexity": {"forms": {"error": "a"}}}, {"complexity": {"function-depth": {"error": {"std-devs": 2}}}}):
        with pytest.raises(ConfigError):
            merge_config(bad)
    assert len(METRICS) == 34


def test_metrics_can_be_registered(spark):
    register_metric(Metric("my-metric", "tests", "Mine", "a new one", default={"error": 1}))
    try:
        assert settings_frame(spark, merge_config()).filter("metric = 'my-metric'").count() == 1
    finally:
        del METRICS["my-metric"]


def test_comparison(spark):
    cols = "brick string, metric string, subject string, value double, kind string, direction string, historical boolean, message string"
    head = spark.createDataFrame([("a", "m", None, 1.0, "brick", "max", None, "x"), ("a", "n", "s", 1.0, "finding", "max", None, "x"), ("b", "n", "s", 1.0, "finding", "max", None, "x"), ("b", "function-depth", "f", 12.0, "function", "max", None, "12 is"), ("b", "co-change", "a", 1.0, "finding", "max", True, "x")], cols)
    base = spark.createDataFrame([("a", "m", None, 1.0, "brick", "max", None, "x"), ("b", "function-depth", "f", 9.0, "function", "max", None, "x"), ("c", "n", "gone", 1.0, "finding", "max", None, "x")], cols)
    functions = spark.createDataFrame([("b", "f", 1, 9, 1, 1)], "brick string, id string, complexity int, depth int, forms int, params int")
    out = baseline.compare(head, base, spark.createDataFrame([("a",)], "brick string"), base.select("brick", "metric", "value"), functions)
    got = {(r.brick, r.metric): (r.status, r.message) for r in out.collect()}
    assert got == {("a", "m"): ("existing", "x"), ("a", "n"): ("new", "x"), ("b", "n"): ("indirect", "x"), ("b", "function-depth"): ("new", "12 is (was 9)"), ("b", "co-change"): ("existing", "x")}
    assert [r.brick for r in baseline.resolved(base, head).collect()] == ["c"]
    bricks = spark.createDataFrame([("a", "components/a"), ("ab", "components/ab"), ("w", "bases/w")], "brick string, dir string")
    paths = spark.createDataFrame([("components/a/src/x.clj",), ("components/ab/test/x.clj",), ("bases/w/deps.edn",)], "path string")
    assert [r.brick for r in baseline.changed_bricks(bricks, paths).collect()] == ["a"]


def test_mermaid():
    bricks = [{"brick": "w", "type": "base"}, {"brick": "c", "type": "component"}, {"brick": "d", "type": "component"}]
    edges = [{"from": "w", "to": "c", "is_new": True}, {"from": "c", "to": "d"}, {"from": "c", "to": "d"}]
    r = report.Report("ws", bricks, report.Listing.none(None), edges, {}, ends={"unstable-dependencies": [("c", "d")], "co-change": [("d", "w")]})
    assert report.mermaid(r).splitlines() == [
        "graph TD", '  b0(["w"])', '  b1["c"]', '  b2["d"]', "  b0 -.-> b1", "  b1 --> b2", "  b2 -.- b0", "  linkStyle 1 stroke:#d1242f,stroke-width:2px",
        "  linkStyle 2 stroke:#b26b00,stroke-width:2px,stroke-dasharray:2 4",
    ]


def test_picture():
    import xml.etree.ElementTree as ET

    from brickyard.plans import picture

    names = ["w", "c", "d", "x&y", "p", "q"]
    assert picture.layers(names, [("w", "c"), ("w", "d"), ("c", "d"), ("d", "x&y"), ("p", "q"), ("q", "p"), ("c", "c"), ("gone", "w")]) == {"w": 0, "c": 1, "d": 2, "x&y": 3, "p": 0, "q": 1}
    bricks = [{"brick": n, "type": "base" if n == "w" else "component"} for n in names]
    edges = [{"from": "w", "to": "c", "is_new": True}, {"from": "c", "to": "d"}, {"from": "c", "to": "d"}, {"from": "d", "to": "x&y"}]
    drawn = ET.fromstring(picture.svg(bricks, edges, {"unstable-dependencies": [("c", "d")], "co-change": [("p", "q")]}))
    lines = [(x.get("data-from"), x.get("data-to"), x.get("class")) for x in drawn.iter("line")]
    assert lines == [("w", "c", "new"), ("c", "d", "unstable"), ("d", "x&y", ""), ("p", "q", "hidden")]
    places = {x.get("data-brick"): (x[0].get("x"), x[0].get("y")) for x in drawn.iter("g") if x.get("data-brick")}
    assert set(places) == set(names) and len(set(places.values())) == len(names)
    assert ET.fromstring(picture.svg([], [], {})).tag == "svg"


def test_formats():
    assert report.format_value("instability", 0.125) == "0.13" and report.format_value("merge-candidate", 0.146) == "15%"
    assert report.format_value("forms", 3) == "3" and report.format_value("forms", None) == "–" and report.format_value("mean-function-depth", 2.25) == "2.3"
    assert report.threshold_text("cohesion", 0.5) == "< 0.5" and report.threshold_text("forms-per-test", {"std-devs": 2}) == "> mean + 2σ"
    assert report.describe(merge_config(), "function-depth") == "warning > 8"


# -- queries ---------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


def _compare(spark, query, sql):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = query(spark, SF)
    cols = sorted(df.columns)
    want = db.sql(sql)
    assert sorted(want.columns) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.select(*cols).collect()), key=key) == sorted(want.select(*[f'"{c}"' for c in cols]).fetchall(), key=key)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(suite.ORACLES))
def test_queries_match_sql(spark, name):
    _compare(spark, suite.QUERIES[name], suite.ORACLES[name])


def _lines(spark, parts):
    return "\n".join(r.line for r in report.assembled(spark, parts).orderBy("part", "ord").collect())


def test_report_legends_counts_and_tiles(spark, measured):
    rows = thresholds.rows(measured.violations.filter("metric = 'mutable-state'"), measured.tables.bricks)
    r = report.Report("ws", [{"brick": "store", "type": "component"}, {"brick": "a", "type": "base"}], report.Listing(rows), [{"from": "a", "to": "store"}], {("store", "isolation-hazards"): (2.0, None)}, hazards={"store": {"sleep": 2}})
    assert report.tiles(r) == [("Bricks", 2), ("Dependencies", 1), ("Errors", 0), ("Warnings", 1)]
    for parts in (report.summary(r), report.html(r)):
        page = _lines(spark, parts)
        assert METRICS["cohesion"].about in page and "Mutable state (1)" in page and "none found" in page and "holds state in an atom" in page
    assert 'title="sleep: 2"' in _lines(spark, report.html(r))


def test_lines_of_rows(spark, tmp_path):
    """Escapes, folded rows, rows without places, and a file written by many tasks."""
    at = "array<struct<file:string,line:int,name:string>>"
    v = "array<struct<n:int,metric:string,value:double,limit:double,message:string,brick:string,type:string,dir:string,at:struct<file:string,line:int,name:string>,own_line:int,direction:string>>"
    one = lambda metric, message, folder, line: (1, metric, 3.0, 2.0, message, "b", "component", folder, None, line, "max")
    rows = [(i, "mutable-state", "io", "mutable-state", None, None, "warning", "indirect" if i == 2 else None, ["b"], [("a,b.clj", i, "n")], [one("mutable-state", f"100% <{i}>|\nx", "components/b", i)]) for i in range(1, 25)]
    rows += [(25, "function-rows", "complexity", "function-complexity", "f", 3.0, "error", None, ["b"], [("f.clj", 4, "f")], [one("function-complexity", "m", "d", 4), one("function-depth", "m", "d", 9)]), (26, "merge-candidate", "tests", "merge-candidate", "c", 1.0, "error", None, ["b"], [], [one("merge-candidate", "m", "components/b", None)]), (27, "co-change", "tests", "co-change", "c", 1.0, "error", None, ["b"], [], [one("co-change", "m", None, None)])]
    df = spark.createDataFrame(rows, f"rank long, `group` string, section string, metric string, subject string, value double, level string, status string, bricks array<string>, locations {at}, violations {v}").repartition(4)
    listing = report.Listing(df)
    assert listing.every == {"io": 24, "complexity": 1, "tests": 2} and listing.old == 1 and listing.levels == {"warning": 23, "error": 3}
    assert listing.grid["function-depth"] == (1, 0, 0) and listing.worst["b", "function-depth"] == "error"
    notes = _lines(spark, [display.annotation_lines(listing.rows)]).split("\n")
    assert notes[0] == "::warning file=a%2Cb.clj,line=1,title=component b%3A Mutable state::Mutable state 100%25 <1>|%0Ax (n)" and notes[1].startswith("::notice") and notes[1].endswith(" (n) [indirect]")
    assert notes[24] == "::error file=f.clj,line=4,title=component b%3A Functions::Functions complexity 3 (at most 2); depth 3 (at most 2, in line 9) (f)"
    assert notes[25].startswith("::error file=components/b/deps.edn,line=1,title=") and notes[26].startswith("::error title=component b%3A ")
    shown = display.with_shown(listing.rows)
    assert sorted(r["rank"] for r in shown.filter("not is_shown").collect()) == [21, 22, 23, 24]
    assert "<b>Mutable state</b> 100% &lt;3&gt;|" in _lines(spark, [display.html_lines(shown)]) and "100% <3>\\| x" in _lines(spark, [display.markdown_lines(shown)])
    from brickyard.sources.lines import write_lines

    path = tmp_path / "new folder" / "out.txt"
    for _ in range(2):  # the second run takes the first one's place
        write_lines(spark.range(1000).selectExpr("id", "concat('line ', id) AS line").repartition(7), str(path), "id")
        assert path.read_text() == "".join(f"line {i}\n" for i in range(1000)) and os.listdir(path.parent) == ["out.txt"]


def test_leave_one_out_against_pairs(spark):
    import random
    import statistics

    rng = random.Random(2)
    made = {"a": [5.0, 5, 5, 9], "b": [1e9 + 0.1, 1e9 + 0.2, 1e9 + 0.4], "c": [3.0], "d": [0.1 * 3, 0.3, 0.3, 7], "e": [rng.gauss(0, 4) for _ in range(30)], "f": [2.0, 2.0]}
    df = spark.createDataFrame([(m, f"b{i}", v) for m, vs in made.items() for i, v in enumerate(map(float, vs))] + [("a", "none", None)], "metric string, brick string, value double")
    got = {(r.metric, r.brick): r for r in stats.leave_one_out(df).collect()}
    for m, values in made.items():
        for i in range(len(values)):
            others = values[:i] + values[i + 1 :]
            r = got[m, f"b{i}"]
            assert r.peers == len(others)
            if others:
                assert r.mean == pytest.approx(statistics.fmean(others), rel=1e-12)
            if len(others) > 1:
                assert r.std_dev == pytest.approx(statistics.stdev(others), rel=1e-6, abs=1e-9)
                assert (r.std_dev == 0) == (len(set(others)) == 1)
    assert got["a", "none"].peers == 4


@pytest.mark.parametrize("depth", [30_000])
def test_forms_nested_to_any_depth(depth):
    from brickyard.functions.facts import file_facts

    facts = file_facts("(defn f [x] " + "(if x " * depth + "1" + ")" * depth + ")", False)
    assert facts["forms"] > 3 * depth
    assert facts["functions"][0]["depth"] == depth + 1  # the definition counts


@pytest.mark.parametrize("name", sorted(source_suite.ORACLES))
def test_source_suite(spark, name):
    _compare(spark, source_suite.QUERIES[name], source_suite.ORACLES[name])


@pytest.mark.parametrize("name", sorted(workspace_suite.ORACLES))
def test_workspace_suite(spark, name):
    _compare(spark, workspace_suite.QUERIES[name], workspace_suite.ORACLES[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_sources_are_parsed_in_many_tasks(spark):
    """The table of suppliers is one small file; its texts aren't one task's."""
    assert source_suite._facts(spark, SF, False).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert source_suite.QUERIES["source_errors"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_workspace_is_grouped_and_resolved_once(spark, monkeypatch):
    """Definitions meet their references once, however many columns are made of them; calls aren't resolved again each round."""
    plans, keep = [], workspace_suite.kept
    monkeypatch.setattr(workspace_suite, "kept", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    w = workspace_suite._workspace(spark, SF)
    assert plans[-1].count("AS refs#") == 1
    assert "Join" not in w.calls._jdf.queryExecution().optimizedPlan().toString()
    assert w.calls.agg({"n": "sum"}).first()[0] == w.references.count()
