"""Graph operators over edge tables: dependency metrics, closures, neighbours, hidden co-change."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.session import dropped, kept


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def mode_first(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first seen."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return first_of(counts, [key], [F.desc("_n"), F.asc("_first")]).select(key, value)


def dependency_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(brick) and edges(from, to, interface) -> brick, afferent (distinct dependents), efferent (distinct
    interfaces used) and instability (null where both are 0)."""
    into = edges.groupBy(F.col("to").alias("brick")).agg(F.countDistinct("from").alias("afferent"))
    out = edges.groupBy(F.col("from").alias("brick")).agg(F.countDistinct("interface").alias("efferent"))
    df = nodes.select("brick").join(into, "brick", "left").join(out, "brick", "left").fillna(0, ["afferent", "efferent"])
    return df.withColumn("instability", F.try_divide(F.col("efferent").cast("double"), F.col("afferent") + F.col("efferent")))


def unstable_edges(edges: DataFrame, metrics: DataFrame, least_gap: float = 0.0) -> DataFrame:
    """Edges towards less stable nodes: from, to, gap (over least_gap)."""
    a = metrics.select(F.col("brick").alias("from"), F.col("instability").alias("i_from"))
    b = metrics.select(F.col("brick").alias("to"), F.col("instability").alias("i_to"))
    joined = edges.join(a, "from").join(b, "to").withColumn("gap", F.col("i_to") - F.col("i_from"))
    return joined.filter(F.col("gap") > least_gap)


def closure(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> every (a, b) joined by a path; a node reaches itself only on a cycle.

    Path lengths double each round, so the rounds follow the logarithm of the longest path.
    """
    known = kept(edges.select("a", "b").distinct())
    n = known.count()
    while True:
        longer = known.alias("x").join(known.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        known = kept(known.union(longer).distinct())
        now = known.count()
        if now == n:
            return known
        n = now


def reach_back(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """edges(a, b), seeds(node) -> the nodes from which a seed can be reached, seeds included: a frontier moves
    along the edges backwards until nothing is new."""
    seen = frontier = kept(seeds.select("node").distinct())
    rounds = 0
    while not frontier.isEmpty():
        callers = edges.join(frontier, edges["b"] == frontier["node"], "left_semi").select(F.col("a").alias("node")).distinct()
        frontier = kept(callers.join(seen, "node", "left_anti"))
        seen = seen.union(frontier)  # what is known isn't written again each round
        rounds += 1
        if rounds % 16 == 0:
            seen = kept(seen.coalesce(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return seen


def neighbors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """brick, depends_on, depended_on_by: sorted distinct names; empty lists stay."""
    none = F.array().cast("array<string>")
    out = edges.groupBy(F.col("from").alias("brick")).agg(F.sort_array(F.collect_set("to")).alias("depends_on"))
    into = edges.groupBy(F.col("to").alias("brick")).agg(F.sort_array(F.collect_set("from")).alias("depended_on_by"))
    df = nodes.select("brick").join(out, "brick", "left").join(into, "brick", "left")
    return df.select("brick", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("depended_on_by", none).alias("depended_on_by"))


def sole_dependents(edges: DataFrame) -> DataFrame:
    """brick, dependent: the bricks that exactly one other depends on."""
    return edges.groupBy(F.col("to").alias("brick")).agg(F.countDistinct("from").alias("_n"), F.min("from").alias("dependent")).filter("_n = 1").drop("_n")


def co_changes(touched: DataFrame, most: int) -> DataFrame:
    """touched(commit, brick) -> pairs that changed together: fewer, more, shared, changes, strength.

    Commits that touch more than ``most`` bricks are left out before anything is counted, so a
    commit's pairs are bounded by most * (most - 1) / 2. Rows are dealt by commit once; of a commit, as many bricks are gathered as
    show whether it stays.
    """
    ranked = touched.filter("commit is not null").select("commit", "brick", F.dense_rank().over(Window.partitionBy("commit").orderBy("brick")).alias("_rank"))
    first = ranked.filter(F.col("_rank") <= most + 1).groupBy("commit").agg(F.max("_rank").alias("_n"), F.collect_set("brick").alias("bricks"))
    small = kept(first.filter(F.col("_n") <= most).select("bricks"))
    dropped(small.sparkSession)
    counts = small.select(F.explode("bricks").alias("brick")).groupBy("brick").agg(F.count("*").alias("changes"))
    sides = small.select(F.explode("bricks").alias("a"), "bricks").select("a", F.explode("bricks").alias("b")).filter("a < b")
    shared = sides.groupBy("a", "b").agg(F.count("*").alias("shared"))
    x = shared.join(counts.select(F.col("brick").alias("a"), F.col("changes").alias("ca")), "a").join(counts.select(F.col("brick").alias("b"), F.col("changes").alias("cb")), "b")
    first: Column = F.col("ca") <= F.col("cb")  # a is the lesser name, so it also wins ties
    return x.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("fewer"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("more"), "shared",
        F.least("ca", "cb").alias("changes"), (F.col("shared").cast("double") / F.least("ca", "cb")).alias("strength"),
    )


LABELS = 4


def _spread(edges: DataFrame, start: DataFrame, best: dict[str, bool]) -> DataFrame:
    """start(node, ...) with, in each column of ``best``, the greatest (True) or least (False) value of all that a node reaches,
    itself included.

    Changes move backwards along the edges until there are none; the rounds follow the longest of the shortest paths.
    """
    known = moved = last = kept(start)
    while not moved.isEmpty():
        offers = [(F.max if most else F.min)(c).alias(f"_{c}") for c, most in best.items()]
        offered = edges.join(moved, edges["b"] == moved["node"]).groupBy("a").agg(*offers).withColumnRenamed("a", "_node")
        both = known.join(offered, known["node"] == offered["_node"], "left")
        better = {c: (F.greatest if most else F.least)(c, f"_{c}") for c, most in best.items()}
        changed = F.lit(False)
        for c, value in better.items():
            changed = changed | (value != F.col(c))
        step = kept(both.select("node", *[value.alias(c) for c, value in better.items()], changed.alias("_changed")))
        known, moved = step.drop("_changed"), step.filter("_changed").drop("_changed")
        dropped(step.sparkSession, last)
        last = step
    return known


def cycles(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """edges(a, b) -> node, comp: the nodes that lie on cycles, with their strongly connected component, named by one of its nodes.

    Every node takes the busiest node it reaches for its colour. A component has one colour, and those of a colour that its
    node reaches, by edges inside the colour, are that node's component. What is left goes on without the edges
    between colours; nodes without edges in and out are on no cycle. The first round finds the large components; with
    ``rounds`` the small ones that would take more are left out.
    """
    spark = edges.sparkSession
    left, found = kept(edges.filter("a <> b").select("a", "b").distinct()), None
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        ins = left.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("_in"))
        outs = left.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("_out"))
        busy = F.struct((F.col("_in") * F.col("_out")).alias("edges"), F.xxhash64("node").alias("hash"), F.col("node").alias("root"))
        nodes = kept(ins.join(outs, "node").select("node", busy.alias("colour")))
        left, spent = kept(left.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")), left
        dropped(spark, spent)
        if left.isEmpty():
            break
        colours = _spread(left, nodes, {"colour": True}).select("node", "colour.root")
        at_a, at_b = colours.select(F.col("node").alias("a"), F.col("root").alias("root")), colours.select(F.col("node").alias("b"), F.col("root").alias("_root"))
        inside = kept(left.join(at_a, "a").join(at_b, "b").filter("root = _root").select("a", "b", "root"))
        dropped(spark, left, nodes)
        seen = frontier = kept(colours.filter("node = root"))
        steps = [seen]
        while not frontier.isEmpty():
            met = inside.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"), "root").distinct()
            frontier = kept(met.join(seen, "node", "left_anti"))
            seen = seen.union(frontier)
            steps.append(frontier)
            dropped(spark)
        seen = kept(seen)
        dropped(spark, *steps)
        many = seen.groupBy("root").agg(F.count("*").alias("_n")).filter("_n > 1").select("root")
        comps = kept(seen.join(many, "root", "left_semi").select("node", F.col("root").alias("comp")))
        found = comps if found is None else found.union(comps)
        left = kept(inside.join(seen.select(F.col("node").alias("a")), "a", "left_anti").join(seen.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
        dropped(spark, inside, seen)
    none = edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0)
    return none if found is None else found


def labels(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, lo0, hi0, lo1, ...: for a few hash functions the least and the greatest hash of what a node reaches,
    itself included. A node's intervals hold those of all it reaches, so intervals that don't hold another's rule a path out.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    best = {f"{side}{i}": side == "hi" for i in range(LABELS) for side in ("lo", "hi")}
    return _spread(edges, nodes.withColumns({c: F.xxhash64("node", F.lit(int(c[2:]))) for c in best}), best)


def _may_reach(a: str, b: str) -> Column:
    """Whether the intervals under prefix ``a`` hold those under ``b``."""
    fits = F.lit(True)
    for i in range(LABELS):
        fits = fits & (F.col(f"{a}lo{i}") <= F.col(f"{b}lo{i}")) & (F.col(f"{a}hi{i}") >= F.col(f"{b}hi{i}"))
    return fits


def _between(pairs: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Distinct edges without dead ends: a path from a to b goes only through nodes with edges in and out. Each round takes off one more
    step; large tables often end in nodes that lead nowhere. Ends go before starts are looked at, and before repeated edges are
    dealt, so the whole table is dealt once."""
    for i in range(rounds):
        to = edges.select(F.col("a").alias("b")).union(pairs.select("b")).distinct()
        edges, spent = kept(edges.join(to, "b", "left_semi").select("a", "b")), edges
        dropped(edges.sparkSession, spent if i else None)
        of = edges.select(F.col("b").alias("a")).union(pairs.select("a")).distinct()
        ends, edges = edges, edges.join(of, "a", "left_semi").select("a", "b")
        edges, spent = kept(edges if i else edges.distinct()), ends
        dropped(edges.sparkSession, spent)
    return edges


def connected(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(a, b) -> those with a path from a to b of an edge or more; edges(a, b).

    Large strongly connected components become single nodes, and labels rule most pairs of these out. For the others a search
    moves on from a, one edge a round for all pairs at once, only through nodes that may reach b, and a pair that is found
    searches no further. All that is ever held is what those searches met.
    """
    pairs, edges = kept(pairs.select("a", "b").distinct()), edges.select("a", "b")
    dropped(pairs.sparkSession)
    edges = _between(pairs, edges)
    comps = kept(cycles(edges, 1))
    of = lambda df, c: df.join(comps.select(F.col("node").alias(c), F.col("comp").alias("_comp")), c, "left").withColumn(f"c{c}", F.coalesce("_comp", c)).withColumn(f"_on{c}", F.col("_comp").isNotNull()).drop("_comp")
    named = kept(of(of(pairs, "a"), "b"))
    dropped(pairs.sparkSession)
    loops = edges.filter("a = b").select("a", "b")
    same = named.filter("ca = cb and _ona").select("a", "b").union(pairs.join(loops, ["a", "b"], "left_semi")).distinct()
    between = kept(of(of(edges, "a"), "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    open_ = named.filter("ca <> cb or a = b and not _ona")
    hit = _searched(open_.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), between)
    far = open_.join(hit.select(F.col("a").alias("ca"), F.col("b").alias("cb")), ["ca", "cb"], "left_semi").select("a", "b")
    return same.union(far).distinct()


def _searched(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs with a path of an edge or more."""
    marks = labels(edges)
    named = lambda prefix: marks.select(*[F.col(c).alias(f"{prefix}{c}") for c in marks.columns])
    asked = pairs.join(named("x_"), F.col("a") == F.col("x_node")).join(named("y_"), F.col("b") == F.col("y_node"))
    goal = ["a", "b", *[f"y_{c}" for c in marks.columns if c != "node"]]
    open_ = kept(asked.filter(_may_reach("x_", "y_")).select(*goal, F.col("a").alias("at")))
    seen = found = None
    step = edges.select(F.col("a").alias("_from"), F.col("b").alias("to"))
    while not open_.isEmpty():
        met = open_.join(step, F.col("at") == F.col("_from")).select(*goal, F.col("to").alias("at")).distinct()
        met = met.join(named("x_"), F.col("at") == F.col("x_node")).filter(_may_reach("x_", "y_")).select(*goal, "at")
        if seen is not None:
            met = met.join(seen, ["a", "b", "at"], "left_anti")
        met = kept(met)
        hit = met.filter("at = b").select("a", "b")
        found = hit if found is None else found.union(hit)
        seen = met.select("a", "b", "at") if seen is None else seen.union(met.select("a", "b", "at"))
        open_ = kept(met.join(hit, ["a", "b"], "left_anti"))
    return pairs.limit(0) if found is None else found.distinct()


def unconnected(pairs: DataFrame, a: str, b: str, edges: DataFrame) -> DataFrame:
    """The pairs without a path between them in either direction; edges(from, to)."""
    one, other = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")), pairs.select(F.col(b).alias("a"), F.col(a).alias("b"))
    paths = connected(one.union(other), edges.select(F.col("from").alias("a"), F.col("to").alias("b")))
    both = paths.select(F.col("a").alias(a), F.col("b").alias(b)).union(paths.select(F.col("b").alias(a), F.col("a").alias(b)))
    return pairs.join(both, [a, b], "left_anti")
