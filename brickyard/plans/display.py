"""What reports show, as tables: texts of rows, the first rows of sections, the summary grid, worst levels, lines of output.

All of it is made from display rows (``thresholds.rows``) by expressions and aggregation, so a report's size doesn't matter
to a task. Lines have an order (``ord``); ``sources.lines`` writes them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickyard.operators.order import numbered
from brickyard.plans.registry import METRICS
from brickyard.plans.thresholds import number_text

FUNCTIONS = "function-rows"

SHOWN = 20


def introduced() -> Column:
    return F.coalesce(F.col("status"), F.lit("new")) == "new"


def _by_metric(column: Column, value) -> Column:
    """A registry entry's text for the metric in a column."""
    pairs = [x for m in METRICS.values() if (text := value(m)) for x in (F.lit(m.key), F.lit(text))]
    return F.element_at(F.create_map(*pairs), column)


def _bound(v: Column) -> Column:
    return F.concat(F.when(v["direction"] == "max", "at most ").otherwise("at least "), number_text(v["limit"]))


def with_texts(rows: DataFrame) -> DataFrame:
    """rows with label, what (is wrong), place and name (of the function or definition there)."""
    first, at = F.col("violations")[0], F.get("locations", F.lit(0))
    names = F.array_join("bricks", ", ")

    def measure(v: Column) -> Column:
        elsewhere = F.when(v["own_line"] != at["line"], F.concat(F.lit(", in line "), v["own_line"].cast("string"))).otherwise("")
        return F.concat(_by_metric(v["metric"], lambda m: m.measure), F.lit(" "), number_text(v["value"]), F.lit(" ("), _bound(v), elsewhere, F.lit(")"))

    of_function = F.array_join(F.transform("violations", measure), "; ")
    spread = F.concat("subject", F.lit(" in "), names, F.lit(" ("), number_text(F.col("value")), F.lit(" bricks, "), _bound(first), F.lit(")"))
    repeated = F.concat(F.lit("repeated in "), names, F.lit(": "), number_text(F.col("value")), F.lit(" forms ("), _bound(first), F.lit(")"))
    what = F.when(F.col("group") == FUNCTIONS, of_function).when(F.col("group") == "library-spread", spread).when(F.col("group") == "duplicate-code", repeated).otherwise(first["message"])
    place = F.coalesce(F.concat(at["file"], F.lit(":"), at["line"].cast("string")), first["dir"], F.get("bricks", F.lit(0)))
    label = F.when(F.col("group") == FUNCTIONS, "Functions").otherwise(_by_metric(F.col("metric"), lambda m: m.label))
    return rows.withColumns({"label": label, "what": F.coalesce(what, F.lit("")), "place": place, "name": at["name"]})


def text_lines(rows: DataFrame) -> DataFrame:
    """section, ord, line: introduced rows of texts, as compilers print them."""
    named = F.when(F.col("group") == FUNCTIONS, F.concat("name", F.lit(": "))).otherwise("")
    line = F.concat("place", F.lit(": "), "level", F.lit(": "), "label", F.lit(": "), named, "what")
    return rows.filter(introduced()).select("section", F.col("rank").alias("ord"), line.alias("line"))


def _escaped(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


# What annotations and pages write for characters that mean something to them.
_DATA = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))
_PROPERTY = (*_DATA, (":", "%3A"), (",", "%2C"))
_HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
_CELL = (("|", "\\|"), ("\n", " "))


def annotation_lines(rows: DataFrame) -> DataFrame:
    """ord, line: a workflow command for each place of each row of texts; rows that aren't introduced are notices."""
    first = F.col("violations")[0]
    there = F.transform("locations", lambda x: F.struct(x["file"].alias("file"), x["line"].cast("string").alias("line")))
    folder = F.array(F.struct(F.concat(first["dir"], F.lit("/deps.edn")).alias("file"), F.when(first["dir"].isNotNull(), "1").alias("line")))
    each = rows.select("*", F.posexplode(F.when(F.size("locations") > 0, there).otherwise(folder)).alias("i", "at"))
    prop = lambda key, value: F.concat(F.lit(f"{key}="), _escaped(value, _PROPERTY))
    title = F.concat(F.col("violations")[0]["type"], F.lit(" "), F.get("bricks", F.lit(0)), F.lit(": "), "label")
    props = F.concat_ws(",", prop("file", F.col("at.file")), prop("line", F.col("at.line")), prop("title", title))
    old = ~introduced()
    said = F.concat("label", F.lit(" "), "what", F.when(F.col("name").isNotNull(), F.concat(F.lit(" ("), "name", F.lit(")"))).otherwise(""), F.when(old, F.concat(F.lit(" ["), "status", F.lit("]"))).otherwise(""))
    line = F.concat(F.lit("::"), F.when(old, "notice").otherwise(F.col("level")), F.lit(" "), props, F.lit("::"), _escaped(said, _DATA))
    return each.select((F.col("rank") * (1 << 20) + F.col("i")).alias("ord"), line.alias("line"))


def markdown_lines(rows: DataFrame) -> DataFrame:
    """section, is_shown, ord, line: rows of a table of level, metric, what and where."""
    where = F.array_join(F.transform("locations", lambda x: F.concat(x["file"], F.lit(":"), x["line"].cast("string"))), ", ")
    cells = [_escaped(c, _CELL) for c in (F.col("level"), F.col("label"), F.col("what"), where)]
    return rows.select("section", "is_shown", F.col("rank").alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def html_lines(rows: DataFrame) -> DataFrame:
    """section, is_shown, ord, line: list items."""
    html = lambda c: _escaped(F.col(c), _HTML)
    at = F.get("locations", F.lit(0))
    where = F.when(at.isNotNull(), F.concat(F.lit(" <code>"), html("place"), F.lit("</code>"))).otherwise("")
    badge = F.when(F.col("status").isNotNull(), F.concat(F.lit(" <em>"), "status", F.lit("</em>"))).otherwise("")
    line = F.concat(F.lit('<li class="'), "level", F.lit('"><b>'), html("label"), F.lit("</b> "), html("what"), where, badge, F.lit("</li>"))
    return rows.select("section", "is_shown", F.col("rank").alias("ord"), line.alias("line"))


def with_shown(rows: DataFrame, shown: int = SHOWN) -> DataFrame:
    """rows with ``is_shown``: of each section the first few; the others are folded away.

    Each task keeps its own first few of a section; from these comes the rank at which the section is cut.
    """
    first = Window.partitionBy("section").orderBy("rank")
    cut = rows.select("section", "rank").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= shown)
    last = cut.groupBy(F.col("section").alias("_section")).agg(F.max("rank").alias("_last"))
    joined = rows.join(F.broadcast(last), F.col("section").eqNullSafe(F.col("_section")))  # as many rows as sections
    return joined.withColumn("is_shown", F.col("rank") <= F.col("_last")).drop("_section", "_last")


def grid(rows: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """metric, errors, warnings, resolved; a function's row counts once for each of its metrics."""
    each = rows.filter(introduced()).select("level", F.explode(F.array_distinct(F.transform("violations", lambda v: v["metric"]))).alias("metric"))
    found = each.groupBy("metric").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    if resolved is None:
        return found.withColumn("resolved", F.lit(0).cast("long"))
    gone = resolved.groupBy("metric").agg(F.count("*").alias("resolved"))
    return found.join(gone, "metric", "full").fillna(0, ["errors", "warnings", "resolved"])


def worst(rows: DataFrame) -> DataFrame:
    """brick, metric, level: the worst level of the rows that a brick has a part in, whatever the metric of the part's own level."""
    each = rows.filter(introduced()).select("level", F.explode("violations").alias("v"))
    return each.groupBy("v.brick", "v.metric").agg(F.when(F.bool_or(F.col("level") == "error"), "error").otherwise("warning").alias("level"))


def node_ids(bricks: DataFrame) -> DataFrame:
    """brick, id: how the graph names bricks, by their order."""
    return numbered(bricks.select("brick", "ord"), [F.asc("ord"), F.asc("brick")], "n", 0).select("brick", F.concat(F.lit("b"), F.col("n").cast("string")).alias("id"))


def edge_lines(bricks: DataFrame, edges: DataFrame) -> DataFrame:
    """from, to, line: the graph's line for each pair of bricks; an edge that the base doesn't have (is_new) is dashed."""
    fresh = F.bool_or(F.col("is_new")) if "is_new" in edges.columns else F.lit(False)
    pairs = edges.groupBy("from", "to").agg(fresh.alias("fresh"))
    ids = node_ids(bricks)
    a, b = ids.select(F.col("brick").alias("from"), F.col("id").alias("_a")), ids.select(F.col("brick").alias("to"), F.col("id").alias("_b"))
    return pairs.join(a, "from").join(b, "to").select("from", "to", F.concat(F.lit("  "), "_a", F.when(F.col("fresh"), " -.-> ").otherwise(" --> "), "_b").alias("line"))
