"""Operators against plain Python: sweeps, labelled search, global order, prefixes."""

import random

import pytest
from pyspark.sql import functions as F

from brickyard.operators import code, graph, order, paths


@pytest.mark.parametrize("seed", range(3))
def test_outermost_against_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(400):
        line = r.randrange(30)
        rows.append((r.choice("ab"), f"f{r.randrange(6)}", i, r.randrange(1, 12), line, line + r.choice([0, 0, 1, 3, 9])))
    df = spark.createDataFrame(rows, "brick string, file string, hash long, forms int, line int, end_line int").repartition(5)
    want = [x for x in rows if not any(o[1] == x[1] and o[3] > x[3] and o[4] <= x[4] and o[5] >= x[5] for o in rows)]
    out = code.outermost(df)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "Join" not in out._jdf.queryExecution().toString()


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    found = set()
    for a in out:
        todo, seen = [a], set()
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        found |= {(a, b) for b in seen}
    return found


def test_cycles(spark):
    r = random.Random(4)
    for n, m in ((25, 35), (12, 5)):
        edges = {(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(50, 51), (51, 52), (52, 50), (52, 53), (60, 60)}
        paths = reach(edges)
        want = {(a, b) for a, b in paths if a != b and (b, a) in paths}
        out = {x.node: x.comp for x in graph.cycles(spark.createDataFrame(list(edges), "a long, b long")).collect()}
        assert {(a, b) for a in out for b in out if a != b and out[a] == out[b]} == want and set(out) == {a for a, _ in want}
    assert graph.cycles(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_connected_against_closure(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range((25, 45, 90)[seed])]
    asked = [(f"n{r.randrange(45)}", f"n{r.randrange(45)}") for _ in range(150)]
    e = spark.createDataFrame(edges, "a string, b string")
    p = spark.createDataFrame(asked, "a string, b string")
    assert {tuple(x) for x in graph.connected(p, e).collect()} == set(asked) & reach(edges)
    assert {tuple(x) for x in graph.closure(e).collect()} == reach(edges)
    hidden = graph.unconnected(p, "a", "b", e.select(F.col("a").alias("from"), F.col("b").alias("to")))
    assert {tuple(x) for x in hidden.collect()} == {(a, b) for a, b in asked if (a, b) not in reach(edges) and (b, a) not in reach(edges)}
    assert graph.connected(p, e.limit(0)).count() == 0


def test_unconnected_on_many_edges(spark):
    """10^5 edges in bands: a closure would have some 2 * 10^8 rows; the search never holds more than it meets."""
    n = 20_000
    e = spark.range(n).select(F.explode(F.array(*[F.struct(F.col("id").alias("from"), (F.col("id") + k).alias("to")) for k in (10, 20, 30, 40, 50)])).alias("x")).select("x.*").filter(F.col("to") < n)
    assert e.count() > 99_000
    asked = spark.range(200).select((F.col("id") * 97).alias("a"), (F.col("id") * 97 + F.when(F.col("id") % 2 == 0, 30).otherwise(31)).alias("b")).filter(F.col("b") < n)
    hidden = {x.a for x in graph.unconnected(asked, "a", "b", e.filter(F.col("from") < 19_500).filter("from % 1000 < 900")).collect()}
    assert all((x.b - x.a) % 10 for x in asked.collect() if x.a in hidden and x.a % 1000 < 850) and hidden


def test_numbered_is_the_global_order(spark):
    r = random.Random(1)
    rows = [(r.randrange(5), i) for i in range(500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int").repartition(6)
    out = order.numbered(df, [F.desc("k"), F.asc("i")], "n")
    assert [(x.k, x.i) for x in sorted(out.collect(), key=lambda x: x.n)] == sorted(rows, key=lambda x: (-x[0], x[1]))
    assert sorted(x.n for x in out.collect()) == list(range(1, 501)) and order.numbered(df.limit(0), [F.asc("i")], "n").count() == 0


def test_owners_of_paths(spark):
    bricks = [("outer", "x", 2), ("inner", "x/y/z", 1), ("other", "x/yy", 3)]
    names = ["x/a", "x/y/z/src/b", "x/y/z", "x/yy/src/c", "xx/a", "a", "x/y/src/z/q", "x/src/src/q"]
    b = spark.createDataFrame(bricks, "brick string, dir string, ord int")
    p = spark.createDataFrame([(n,) for n in names], "path string")
    first = lambda n: next((x[0] for x in sorted(bricks, key=lambda x: x[2]) if n.startswith(x[1] + "/")), None)
    assert {tuple(x) for x in paths.owners(p, b).collect()} == {(n, first(n)) for n in names if first(n)}
    assert {x.brick for x in paths.under(p, b, "src").collect()} == {x[0] for x in bricks if any(n.startswith(x[1] + "/src/") for n in names)}


def test_dead_ends_are_left_out_of_the_search(spark):
    edges = spark.createDataFrame([("a", "m"), ("m", "b"), ("m", "x"), ("x", "y"), ("u", "m"), ("s", "s")], "a string, b string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("s", "s")], "a string, b string")
    assert {tuple(r) for r in graph._between(pairs, edges).collect()} == {("a", "m"), ("m", "b"), ("s", "s")}
    assert {tuple(r) for r in graph.connected(pairs, edges).collect()} == {("a", "b"), ("s", "s")}
