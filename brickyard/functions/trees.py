"""Source trees as tables: a nested-set row for each node, and subtree sums without recursion.

A table function reads a file's text to rows in reading order: ``pre`` is a node's place in it, ``last`` the place of the last
node below it, so a subtree is an interval of places. Everything after that is DataFrame work: decisions of a node are
an expression over it and its children's kinds, and sums over subtrees are differences of running sums.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.functions.facts import FN_HEADS, FUNCTION_HEADS, ONE_DECISION
from brickyard.sources.reader import Keyword, Node, ReadError, read_source

NODES = "pre int, last int, depth int, top int, slot int, parent_head string, tag string, head string, row int, end_row int, kids array<string>, words array<string>, error string"


def _word(node: Node) -> str | None:
    """What a child says to the counting of decisions: a keyword, or true."""
    value = node.value
    return f":{value}" if isinstance(value, Keyword) else "true" if value is True else None


def tree_rows(source: str | None) -> Iterator[tuple]:
    """A file's nodes as rows of NODES; one row with an error if it can't be read."""
    try:
        forms = read_source(source or "")
    except (ReadError, RecursionError) as e:
        yield (-1, -1, -1, -1, -1, None, "error", None, 0, 0, None, None, str(e))
        return
    rows: list[list] = []
    stack: list[tuple[Node | None, int, int, str | None, int]] = [(f, 0, i, None, -1) for i, f in reversed(list(enumerate(forms)))]
    while stack:
        node, depth, slot, above, top = stack.pop()
        if node is None:  # all below the row at ``slot`` has been read
            rows[slot][1] = len(rows) - 1
            continue
        pre, kids = len(rows), node.children or []
        top = pre if top < 0 else top
        rows.append([pre, pre, depth, top, slot, above, node.tag, node.head, node.row, node.end_row, [k.tag for k in kids], [_word(k) for k in kids], None])
        stack.append((None, 0, pre, None, 0))
        stack.extend((k, depth + 1, i, node.head, top) for i, k in reversed(list(enumerate(kids))))
    yield from map(tuple, rows)


def nodes(files: DataFrame) -> DataFrame:
    """files(file, source) -> file and NODES, a row a node."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=NODES, useArrow=True)
    class Tree:
        def eval(self, source: str):
            yield from tree_rows(source)

    return files.select("file", "source").lateralJoin(Tree(F.col("source").outer())).drop("source")


def decisions() -> Column:
    """Decision points that a node itself adds, over the columns of ``nodes``. The modifiers of a comprehension are counted at
    its bindings, which are its subtree all the same."""
    n = F.greatest(F.size("kids") - 1, F.lit(0))
    head = F.col("head")
    clauses = F.floor(n / 2).cast("int")
    named = F.get("words", 2 * clauses - 1)  # the test of the last clause
    otherwise = F.when((clauses > 0) & named.isNotNull(), 1).otherwise(0)
    vectors = F.size(F.filter(F.slice("kids", 2, 1_000_000), lambda k: k == "vector"))
    lists = F.size(F.filter(F.slice("kids", 2, 1_000_000), lambda k: k == "list"))
    modifiers = F.size(F.filter("words", lambda w: F.coalesce(w.isin(":when", ":while"), F.lit(False))))
    return (
        F.when(F.col("parent_head").isin("for", "doseq") & (F.col("slot") == 1), modifiers)
        .when(head.isin(*ONE_DECISION), 1)
        .when(head.isin("and", "or"), F.greatest(n - 1, F.lit(0)))
        .when(head.isin("cond->", "cond->>"), F.floor(F.greatest(n - 1, F.lit(0)) / 2))
        .when(head == "condp", F.floor(F.greatest(n - 2, F.lit(0)) / 2))
        .when(head == "cond", clauses - otherwise)
        .when(head.isin(*(FN_HEADS - {"defmethod"})) & (vectors == 0), F.greatest(lists - 1, F.lit(0)))
        .otherwise(0)
        .cast("long")
    )


def subtree_sums(table: DataFrame, measure: Column, name: str) -> DataFrame:
    """nodes with the sum of a measure over each one's subtree: the running sum at its last place less that before it.

    One equi-join on the place; no node meets those above it.
    """
    before = Window.partitionBy("file").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    summed = table.withColumn("_own", measure.cast("long")).withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0)))
    ends = summed.select(F.col("file").alias("_file"), F.col("pre").alias("_last"), (F.col("_before") + F.col("_own")).alias("_to"))
    joined = summed.join(ends, (F.col("file") == F.col("_file")) & (F.col("last") == F.col("_last")))
    return joined.withColumn(name, F.col("_to") - F.col("_before")).drop("_own", "_before", "_file", "_last", "_to")


def file_forms(table: DataFrame) -> DataFrame:
    """file, forms: how many nodes a file has."""
    return table.filter("error is null").groupBy("file").agg(F.count("*").alias("forms"))


def function_measures(table: DataFrame) -> DataFrame:
    """file, ord, line, forms, complexity of the functions at the top of each file."""
    inside = table.filter("error is null").select("file", "top", "depth", "pre", "last", "row", "head", decisions().alias("own"))
    tops = F.when((F.col("depth") == 0) & F.col("head").isin(*FUNCTION_HEADS), F.struct("pre", "last", "row"))
    found = inside.groupBy("file", "top").agg(F.max(tops).alias("at"), F.sum("own").alias("own")).filter("at is not null")
    number = F.row_number().over(Window.partitionBy("file").orderBy("top")) - 1
    return found.select("file", number.alias("ord"), F.col("at.row").alias("line"), (F.col("at.last") - F.col("at.pre") + 1).alias("forms"), (F.col("own") + 1).alias("complexity"))
