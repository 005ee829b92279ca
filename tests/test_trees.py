"""Trees as tables against the facts that are read from trees in memory."""

import pytest
from pyspark.sql import functions as F

from brickyard.functions import trees
from brickyard.functions.facts import decisions, file_facts
from brickyard.session import kept
from brickyard.sources.reader import read_source

SOURCES = {
    "empty": "",
    "shapes": """(ns a.b) ; a comment
(defn one [x] (if x (when (and x 1 2) 3) (cond x 1 (or x 2 3 4) 2 :else 3)))
(defn two ([x] x) ([x y] (for [a x :when a b y :while (if a b)] [a #(if % 1 2)])) ([x y z] (doseq [a x :let [b (if a 1)] :when b] b)))
(defn- three [x] (case x 1 2 3 4 5) (condp = x 1 2 3 4 5) (cond-> x 1 inc 2 dec) (try x (catch Exception e (if-let [y x] y))))
(defmacro four [x] `(if ~x ~@[1 2] #_(if a b) {:k (cond)}))
(defmethod five :x [y] (cond y 1 true 2))
(def six (fn ([a] a) ([a b] (while a b))))
(defn seven [] #?(:clj (if 1 2) :cljs 3))""",
    "nested": "(defn f [x] " + "(if x " * 500 + "1" + ")" * 500 + ")",
    "odd": "(cond a) (cond) (and) (for) (defn) (fn) () [] (cond :else 1) (cond a 1 b)",
    "broken": "(defn f [x",
}


@pytest.fixture(scope="module")
def table(spark):
    files = spark.createDataFrame(list(SOURCES.items()), "file string, source string")
    return kept(trees.nodes(files))


def readable():
    return {k: v for k, v in SOURCES.items() if k != "broken"}


def test_nested_sets(table):
    for name, source in readable().items():
        want = [n for f in read_source(source) for n in f.walk()]
        rows = table.filter(F.col("file") == name).orderBy("pre").collect()
        assert [(r.tag, r.head, r.row, r.last - r.pre + 1) for r in rows] == [(n.tag, n.head, n.row, sum(1 for _ in n.walk())) for n in want]
        assert [r.pre for r in rows] == list(range(len(rows)))
    assert [(r.file, r.pre) for r in table.filter("error is not null").collect()] == [("broken", -1)]


def test_counts_equal_the_facts(table):
    facts = {k: file_facts(v, False) for k, v in readable().items()}
    assert {r.file: r.forms for r in trees.file_forms(table).collect()} == {k: f["forms"] for k, f in facts.items() if f["forms"]}
    got = sorted((r.file, r.ord, r.line, r.forms, r.complexity) for r in trees.function_measures(table).collect())
    assert got == sorted((k, x["ord"], x["line"], x["forms"], x["complexity"]) for k, f in facts.items() for x in f["functions"])


def test_subtree_sums(table):
    out = trees.subtree_sums(table.filter("error is null"), trees.decisions(), "n")
    for name, source in readable().items():
        want = [sum(decisions(x) for x in n.walk()) for f in read_source(source) for n in f.walk()]
        rows = out.filter(F.col("file") == name).orderBy("pre").collect()
        # The bindings of a comprehension hold its own modifiers; all other nodes agree.
        assert [r.n for r in rows if not (r.parent_head in ("for", "doseq") and r.slot == 1)] == [n for n, r in zip(want, rows, strict=True) if not (r.parent_head in ("for", "doseq") and r.slot == 1)]
