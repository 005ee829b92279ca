"""The reader and the facts of single files."""

import pytest

from brickyard.functions.facts import deepest, file_facts
from brickyard.sources.reader import Keyword, ReadError, read_edn, read_source


def fn(body: str) -> dict:
    return file_facts(f"(ns a.b) {body}", False)["functions"][0]


@pytest.mark.parametrize(
    "body,complexity",
    [
        ("(defn f [] 1)", 1),
        ("(defn f [x] (if x (when x 1) 2))", 3),
        ("(defn f [x] (cond x 1 (odd? x) 2 :else 3))", 3),
        ("(defn f [x] (cond x 1 (odd? x) 2))", 3),
        ("(defn f [x] (cond x 1 true 2))", 2),
        ("(defn f [x] (case x 1 :a 2 :b 3 :c))", 2),
        ("(defn f [x] (condp = x 1 :a 2 :b :none))", 3),
        ("(defn f [a b c] (and a b c (or a b)))", 5),
        ("(defn f [x] (try x (catch Exception e e)))", 2),
        ("(defn f [xs] (for [x xs :when x :let [y x] :while y] y))", 3),
        ("(defn f ([] 1) ([x] 2) ([x y] 3))", 3),
        ("(defn f [] (fn ([] 1) ([x] 2)))", 2),
        ("(defn f [x] (cond-> x x inc (odd? x) dec))", 3),
        ("(defn f [x] #(if % 1 2))", 1),
        ("(defn f [x] #(do (if % 1 2)))", 2),
        ("(defn f [x] (my/if x 1 2))", 2),
        ("(defn f [x] #_(if x 1 2) x) ; (when x)", 1),
        ("(defmethod f :k ([] 1) ([x] 2))", 1),
    ],
)
def test_complexity(body, complexity):
    assert fn(body)["complexity"] == complexity


@pytest.mark.parametrize(
    "form,depth",
    [
        ("x", 0),
        ("(f x)", 1),
        ("(f (g [x]))", 3),
        ("(let [a (f (g 1))] (h a))", 2),
        ("(let [a (f (g (h 1)))] a)", 3),
        ("(defn f [x] (g x))", 2),
        ("(defn f \"doc\" {:a {:b 1}} [x] x)", 1),
        ("(fn ([x] (g x)) ([x y] y))", 3),
        ("'(a (b))", 2),
        ("@(f x)", 1),
        ("^{:k [[1]]} (f)", 1),
        ("(letfn [(g [x] (h (i x)))] (g 1))", 3),
        ("(for [x xs :let [y (f (g (h x)))]] y)", 3),
        ("(defmethod m [:a [:b]] [x] x)", 1),
    ],
)
def test_depth(form, depth):
    assert deepest(read_source(form)[0])[0] == depth


def test_function_record():
    f = file_facts("(ns a.b)\n\n(defn ^:private g\n  [a b & more]\n  (h\n    (i a)))", False)["functions"][0]
    assert (f["name"], f["line"], f["params"], f["depth"], f["depth_line"], f["forms"]) == ("g", 3, 2, 3, 6, 15)
    assert fn("(defn f ([a] a) ([a b c] a))")["params"] == 3
    assert fn("(defmethod area :square [{:keys [side]}] side)")["name"] == "area :square"


def test_requires():
    source = """(ns ^{:doc "x"} my.app
  (:require [a.b :as b :refer [x y]] c.d ["react-dom/client" :as rd]
            (pre [one :as o] two) #?@(:clj [[e.f :as-alias ef]] :cljs [[g.h]]))
  (:use [u.v]) (:import [java.io File]))"""
    facts = file_facts(source, False)
    got = [(r["target"], r["alias"], r["as_alias"], r["refer"], r["is_js"], r["line"]) for r in facts["requires"]]
    assert facts["ns"] == "my.app"
    assert got == [
        ("a.b", "b", None, ["x", "y"], False, 2), ("c.d", None, None, [], False, 2), ("react-dom/client", "rd", None, [], True, 2), ("pre.one", "o", None, [], False, 3),
        ("pre.two", None, None, [], False, 3), ("e.f", None, "ef", [], False, 3), ("g.h", None, None, [], False, 3), ("u.v", None, None, [], False, 4),
    ]
    assert file_facts("(def x 1)", False)["ns"] is None


def test_definitions():
    source = "(ns n) (def ^:private a 1) (defn- b [] (a)) (def ^{:private true} c (x/y a)) (defn d [] (throw (e))) (def ^:x ^:y e 1) (s/def :k int?) (defonce g (atom {}))"
    found = {d["name"]: (d["private"], d["throws"], d["refs"]) for d in file_facts(source, False)["definitions"]}
    assert found["a"][0] and found["b"][0] and found["c"][0] and not found["d"][0]
    assert found["d"][1] and not found["a"][1] and found["c"][2] == ["a", "x/y"]
    assert "e" not in found and set(found) == {"a", "b", "c", "d", "g"}


def test_keywords():
    source = "(ns n (:require [other :as o])) (f :plain ::own ::o/k :x/y :else #:p{:q 1 :_/r 2 :s/t 3}) #_:gone"
    assert file_facts(source, False)["keywords"] == sorted(["plain", "n/own", "other/k", "x/y", "p/q", "r", "s/t"])


def test_fragments_ignore_layout():
    body = "(defn f [a b] (let [c (+ a b) d (* c c)] (when (pos? d) (println a b c d) [a b c d])))"
    spread = body.replace(" ", "\n   ; note\n  ").replace("(when", "#_(skipped) (when")
    a, b = (file_facts(s, False)["fragments"] for s in (body, spread))
    assert a and [f["hash"] for f in a] == [f["hash"] for f in b]
    assert all(f["forms"] >= 20 for f in a) and b[-1]["end_line"] > b[-1]["line"] == 1


def test_errors():
    source = """(throw (ex-info "a" {:type :x})) (throw (ex-info "b" {})) (throw (ex-info "c" data)) (throw (IllegalStateException. "d"))
(throw e) (throw+ {:my/type 1}) (throw+ {:k 1}) (throw #?(:clj (Exception. "x") :cljs (js/Error. "x"))) (throw (new Foo))
(try (f) (catch Exception e (log/warn e)) (catch Throwable t (throw t)) (catch #?(:clj Exception :cljs :default) e nil) (catch ArithmeticException e 1))"""
    facts = file_facts(source, False)
    assert [t["kind"] for t in facts["throws"]] == ["typed", "untyped", "unknown", "host", "rethrow", "typed", "untyped", "host", "host", "rethrow"]
    assert [(c["broad"], c["handling"]) for c in facts["catches"]] == [(True, "logs"), (True, "rethrows"), (True, "continues"), (False, "continues")]


def test_interop_and_state():
    assert file_facts("(.foo x) (Foo. 1) (new Bar) (Math/abs 1) (js/alert 1) (.-x y) (a.b/c) (foo. 1) . (str \"Math/abs\")", False)["interop"] == 6
    source = "(def a (atom 1)) (defonce b (agent 1)) (def ^:dynamic *c* 1) (def d (inc 1)) (defn e [] (atom 1)) (alter-var-root #'a inc) (def ^:k ^:l f (volatile! 1))"
    found = [(m["name"], m["kind"]) for m in file_facts(source, False)["mutable_state"]]
    assert found == [("a", "atom"), ("b", "agent"), ("*c*", "dynamic"), ("f", "volatile"), ("#'a", "alter-var-root")]


def test_test_files():
    source = "(ns n-test) (def s (atom 1)) (deftest one (is (= 1 (f 1))) (are [x] (odd? x) 1)) (deftest ^:slow two (with-redefs [f g] (Thread/sleep 10)))"
    facts = file_facts(source, True)
    assert [(t["name"], t["assertions"]) for t in facts["tests"]] == [("one", 2), ("two", 0)]
    assert [h["kind"] for h in facts["hazards"]] == ["with-redefs", "sleep", "atom"]
    assert {"f", "g", "odd?"} <= set(facts["test_refs"])


def test_edn():
    assert read_edn('{:a [1 2.5 "x\\n" \\y] :b #{:k} :c nil :d true ; note\n}') == {Keyword("a"): [1, 2.5, "x\n", "y"], Keyword("b"): {"k"}, Keyword("c"): None, Keyword("d"): True}
    assert read_edn("") is None
    for bad in ("(a", "a)", '"open', "{:a}", "[1 2}"):
        with pytest.raises(ReadError):
            read_edn(bad)
            read_source(bad)


def test_files_that_cannot_be_read(spark):
    from brickyard.functions.facts import extract

    rows = [("a", "component", "components/a", "a.clj", False, 0, "(ns a) (def x"), ("b", "component", "components/b", "b.clj", False, 0, None)]
    df = spark.createDataFrame(rows, "brick string, type string, dir string, file string, is_test boolean, ord int, source string")
    found = {r.brick: r for r in extract(df).collect()}
    assert found["a"].error and found["a"].forms == 0 and found["b"].error is None and found["b"].forms == 0
