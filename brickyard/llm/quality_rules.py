"""Quality rules: a threshold table compiled into one Spark projection.

Every statistic is a built-in expression over one document's own text, so the operator is
a narrow map: no shuffle, no user function, rows in equal rows out.

Defined results: a null or empty text has no words (all counts 0, base_failed true, kept
false); a null id stays null; repeated rows are judged each on its own; extra columns,
whatever their names, are kept by ``with_quality`` (its own columns sit in one struct,
``quality``, replaced if the input has one) and ignored by ``quality_report``. Texts of
any length are read whole; the only super-linear step is the sort of a text's five-word
windows, and it runs only for texts in which some window repeats.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm._shared import unused

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WINDOW = 5

# Frequent function words of the corpus languages.
STOP_WORDS = (
    "the be to of and that have with a in is it for was on as "
    "de la que el en y los se las del un por con no una "
    "le et les des du une est pour par dans ne qui sur "
    "der die und den von zu das sich mit auf für ist im dem nicht"
).split()


@dataclass(frozen=True)
class Rule:
    """Passes while low <= 1000 * numerator / denominator <= high (integers, so exact)."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None

    def passes(self, stats: Column) -> Column:
        top, below = stats[self.numerator] * 1000, stats[self.denominator]
        checks = F.lit(True)
        if self.low is not None:
            checks = checks & (top >= below * self.low)
        if self.high is not None:
            checks = checks & (top <= below * self.high)
        return checks

    def sql(self) -> str:
        top, parts = f"1000 * {self.numerator}", []
        if self.low is not None:
            parts.append(f"{top} >= {self.low} * {self.denominator}")
        if self.high is not None:
            parts.append(f"{top} <= {self.high} * {self.denominator}")
        return " AND ".join(parts)


RULES = (
    Rule("word_length", "word_chars", "n_words", 2000, 12000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 10, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
)


def _windows(words: Column, n: Column) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(n >= WINDOW, hashes)


def _statistics(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with a struct ``out`` of counts; helper columns carry names no input can clash with."""
    c = {k: unused(f"{out}_{k}", docs.columns) for k in ("t", "w", "n", "h", "s", "r", "l")}
    col = F.col
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_CHARS))
    df = docs.withColumn(c["t"], trimmed)
    df = df.withColumn(c["w"], F.when(col(c["t"]) == "", F.array().cast("array<string>")).otherwise(F.split(c["t"], SPACE)))
    df = df.withColumn(c["n"], F.size(c["w"]))
    df = df.withColumn(c["h"], _windows(col(c["w"]), col(c["n"])))
    # Only a text that repeats a window pays for the sort; neighbours with one hash are compared word by word.
    repeats = F.size(F.array_distinct(c["h"])) < F.size(c["h"])
    df = df.withColumn(c["s"], F.when(repeats, F.sort_array(F.transform(c["h"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    pairs, words = col(c["s"]), col(c["w"])

    def same(p: Column, q: Column) -> Column:
        return (p["h"] == q["h"]) & (F.slice(words, p["i"] + 1, WINDOW) == F.slice(words, q["i"] + 1, WINDOW))

    marked = F.transform(pairs, lambda p, j: F.when(F.coalesce(same(p, F.get(pairs, j - 1)), F.lit(False)) | F.coalesce(same(p, F.get(pairs, j + 1)), F.lit(False)), p["i"]))
    df = df.withColumn(c["r"], F.sort_array(F.filter(marked, lambda i: i.isNotNull())))
    starts = col(c["r"])
    covered = F.aggregate(F.transform(starts, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn(c["l"], F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    lines = col(c["l"])

    def lines_like(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")

    stop = F.lower(F.array_join(words, " "))
    stats = F.struct(
        col(c["n"]).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.size(F.split(F.coalesce(F.col(text), F.lit("")), r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(F.split(stop, " "), lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        lines_like(r"(\.\.\.|…)\s*$").alias("n_ellipsis_lines"),
        lines_like(r"^\s*[-*•]").alias("n_bullet_lines"),
    )
    return df.withColumn(out, stats).drop(*c.values())


def with_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_percent: int = 20, out: str = "quality") -> DataFrame:
    """docs with struct ``out``: the counts, base_failed, failed_rules (names) and kept."""
    df = _statistics(docs, text, out)
    s = F.col(out)
    base = (s["n_words"] < min_words) | (s["n_repeat_words"] * 100 > s["n_words"] * max_repeat_percent)
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.passes(s)
    failed = F.filter(F.array(*[F.when(~rule.passes(s), F.lit(rule.name)) for rule in rules]), lambda x: x.isNotNull())
    return df.withColumn(out, s.withField("base_failed", base).withField("failed_rules", failed).withField("kept", ~base & verdict))


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """The rows of docs that pass, with their columns as they were."""
    out = unused("quality", docs.columns)
    judged = with_quality(docs, text, rules, min_words, max_repeat_percent, out)
    # A row number beside the verdict keeps the optimizer from inlining all statistics into the filter.
    at = unused("at", judged.columns)
    judged = judged.withColumn(at, F.monotonically_increasing_id())
    return judged.filter(F.col(f"`{out}`.kept") & (F.col(f"`{at}`") >= 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the counts and the verdict."""
    df = with_quality(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text")
    return df.select("doc_id", "quality.*")


def oracle() -> str:
    verdict = " AND ".join(f"({r.sql()})" for r in RULES)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{space}+', '', 'g') <> '') AS l
  FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM k WHERE c > 1) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet_lines
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {verdict} AS kept
FROM b"""
