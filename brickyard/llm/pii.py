"""Personal data: spans by pattern, and sanitisation of the terms that give them away.

Base spans (email, ip, card, phone) come from one regular expression a kind, read leftmost and
without overlap; a match that fails its kind's test (parts up to 255, Luhn, numbers of digits) is
dropped. Every entity found is protected. The words of its texts are terms that may disclose it: the
corpus tells how strongly. With N different texts, a term in n_t of them, an entity in n_e and both in
n_te of them,

    disclosure = PMI / IC = log(N * n_te / (n_t * n_e)) / log(N / n_e)

is the part of the entity's information that the term gives away (1: the term never occurs
without it). Terms at ``threshold`` or more, seen with an entity in ``support`` different texts at
least, are spans of kind "term" wherever they stand, in texts with the entity or without;
``sanitise`` generalises base spans to their kind and removes terms. Copies of a text count once in
all four numbers, so copying a text neither discloses nor hides anything.

All of it is DataFrame expressions. Each text's distinct terms are kept once; only entities and terms
that can reach support and threshold (n_t at most N^(1-threshold) * n_e^threshold) are paired.

Defined results: a null or empty text has no spans; rows that repeat an id and a text share their
spans; null ids are allowed; an empty table gives an empty result; columns other than id and text
are ignored by ``find``. Offsets are in code points, ends exclusive.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickyard.llm._shared import checkpointed, named, unused

# The patterns as given, but for look-behinds that keep a failing run from being tried again at each of
# its characters, and possessive repeats, which neither change what matches first nor recurse.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = tuple(PATTERNS)
TERM = r"(?<![\p{L}\p{N}@._%+-])\p{L}++(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_CHUNK = 256
_FEW = 50_000
#: Of single numbers, 8 MB.
_NUMBERS = 1_000_000


def _luhn(digits: Column) -> Column:
    def value(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "email":
        return F.lit(True)
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone":
        return n.between(8, 15)
    return F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _located(df: DataFrame, text: str, pattern: str, when: Column | None, out: str, keep) -> DataFrame:
    """df with ``out``: (value, start) of each match whose value ``keep`` accepts.

    Starts are running sums of gap and match lengths, taken for the accepted matches alone and by chunks,
    so that texts with very many matches stay near linear.
    """
    m, g, n, t, h = (f"{out}_{k}" for k in "mgnth")
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn(m, found if when is None else F.when(when, found).otherwise(none))
    df = df.withColumn(h, F.filter(F.transform(m, lambda x, i: F.struct(x.alias("value"), i.alias("i"))), lambda x: keep(x["value"])))
    df = df.withColumn(g, F.when(F.size(h) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    # n: what lies between one start and the next.
    lengths = F.transform(m, lambda x, i: F.length(x) + F.length(F.get(F.col(g), i + 1)))
    df = df.withColumn(n, F.when(F.size(h) > 0, lengths).otherwise(F.array().cast("array<int>")))
    chunks = F.sequence(F.lit(0), F.floor(F.size(n) / _CHUNK).cast("int"))
    df = df.withColumn(t, F.transform(chunks, lambda c: _sum(F.slice(F.col(n), c * _CHUNK + 1, F.lit(_CHUNK)))))

    def start(i: Column) -> Column:
        chunk = F.floor(i / _CHUNK).cast("int")
        return F.length(F.get(F.col(g), F.lit(0))) + _sum(F.slice(F.col(t), F.lit(1), chunk)) + _sum(F.slice(F.col(n), chunk * _CHUNK + 1, i % _CHUNK))

    df = df.withColumn(out, F.transform(h, lambda x: F.struct(x["value"].alias("value"), start(x["i"]).alias("start"))))
    return df.drop(m, g, n, t, h)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, support: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, mark (hash of the text), and for each kind and "term" an array of (start, end)."""
    d = docs.select(named(doc_id).cast("long").alias("doc_id"), F.xxhash64(named(text)).alias("mark"), F.coalesce(named(text), F.lit("")).alias("text"))
    df = d
    for kind in KINDS:
        need = NEEDS[kind]
        when = F.col("text").rlike("[0-9]{4}") if need is None else F.contains("text", F.lit(need))
        if kind == "card":  # sixteen digits with single separators
            when = F.col("text").rlike("[0-9](?:[\\x20-]?[0-9]){15}")
        df = _located(df, "text", PATTERNS[kind], when, f"_{kind}", lambda value, kind=kind: _holds(kind, value))
    spans = [F.transform(f"_{k}", lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"))).alias(k) for k in KINDS]
    entities = F.array_distinct(F.concat(*[F.transform(f"_{k}", lambda m: F.concat(F.lit(f"{k}:"), F.lower(m["value"]))) for k in KINDS])).alias("entities")
    base = checkpointed(df.select("doc_id", "mark", *spans, entities))
    # Terms are hashed where they are counted, and read again rather than kept; rows that repeat a text are left out.
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda t: F.xxhash64(F.lower(t)))).alias("terms")
    told = _told(base.select("mark", "entities"), _single(d.select(F.monotonically_increasing_id().alias("row"), "mark", words)), threshold, support)
    base = base.drop("entities")
    holders = _located(d.join(told, "mark").dropDuplicates(["mark"]), "text", TERM, None, "_term", lambda value: F.array_contains("told", F.xxhash64(F.lower(value))))
    found = F.transform("_term", lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end")))
    by_text = holders.select(F.col("mark").alias("of"), found.alias("found"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return base.join(by_text, F.col("mark") == F.col("of"), "left").select("doc_id", "mark", *KINDS, F.coalesce("found", empty).alias("term"))


def _sized(table: DataFrame, few: int = _FEW) -> DataFrame:
    """A checkpointed table, broadcast if it has few rows; the optimizer doesn't know the size of these."""
    return F.broadcast(table) if table.count() <= few else table


def _single(lists: DataFrame) -> DataFrame:
    """(row, mark, terms) -> (mark, terms), one row a text. The lists themselves are shuffled only beyond _NUMBERS repeated rows."""
    copied = _sized(checkpointed(lists.groupBy("mark").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1").select("mark", "first")))
    again = checkpointed(lists.select("row", "mark").join(copied, "mark").filter("row <> first").select("row"))
    return lists.join(_sized(again, _NUMBERS), "row", "left_anti").select("mark", "terms")


def _told(held: DataFrame, texts: DataFrame, threshold: float, support: int) -> DataFrame:
    """(mark, entities) of rows and (mark, terms) of texts -> (mark, told): the texts that hold disclosing terms, and these."""
    n = texts.count()
    entities = held.select("mark", F.explode("entities").alias("entity")).distinct()
    n_e = checkpointed(entities.groupBy("entity").agg(F.count("*").alias("n_e")).filter((F.col("n_e") >= support) & (F.col("n_e") < n)))
    top = n_e.agg(F.max("n_e")).first()[0] or 0
    terms = texts.select("mark", F.explode("terms").alias("term"))
    most = lambda of: F.pow(F.lit(float(max(n, 1))), F.lit(1.0 - threshold)) * F.pow(of, F.lit(threshold)) * (1 + 1e-9)
    n_t = checkpointed(terms.groupBy("term").agg(F.count("*").alias("n_t")).filter((F.col("n_t") >= support) & (F.col("n_t") <= most(F.lit(float(top))))))
    of_entity = checkpointed(entities.join(_sized(n_e), "entity"))
    marks = _sized(checkpointed(of_entity.select("mark").distinct()))
    of_term = texts.join(marks, "mark", "left_semi").select("mark", F.explode("terms").alias("term")).join(_sized(n_t), "term")
    n_te = of_term.join(_sized(of_entity), "mark").filter(F.col("n_t") <= most(F.col("n_e"))).groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_te")).filter(F.col("n_te") >= support)
    disclosure = F.log(F.lit(n) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(n) / F.col("n_e"))
    told = checkpointed(n_te.filter(disclosure >= threshold).select("term").distinct())
    return _sized(checkpointed(terms.join(_sized(told), "term", "left_semi").groupBy("mark").agg(F.collect_list("term").alias("told"))))


def span_text(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    parts = [F.transform(F.array_sort(k), lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string"))) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, n_term, base_spans, spans."""
    return find(docs, doc_id, text).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "term")], span_text(KINDS).alias("base_spans"), span_text((*KINDS, "term")).alias("spans")
    )


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, support: int = 3) -> DataFrame:
    """docs with base spans replaced by their kind in brackets and disclosing terms removed.

    Of spans that overlap, the part of a later one that reaches beyond the earlier is replaced too. A null text stays null,
    an empty one empty; other columns, of whatever name, and repeated rows stay as they are.
    """
    spans = find(docs, doc_id, text, threshold, support)
    marked = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("" if k == "term" else f"[{k.upper()}]").alias("by"))) for k in (*KINDS, "term")])
    taken = docs.columns
    of, mark, cuts = unused("__id", taken), unused("__mark", taken), unused("__cuts", taken)
    by_row = spans.filter(F.size(F.concat(*KINDS, "term")) > 0).groupBy(F.col("doc_id").alias(of), F.col("mark").alias(mark)).agg(F.sort_array(F.first(marked)).alias(cuts))
    whole = named(text)
    rows = docs.join(by_row, named(doc_id).cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(whole) == F.col(mark)), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        part = F.concat(F.substring(whole, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), s["by"])
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts")))

    done = F.aggregate(cuts, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(whole, a["at"] + 1, F.length(whole))))
    new = F.when(F.col(cuts).isNull(), whole).otherwise(done)
    return rows.select(*[new.alias(n) if n == text else named(n) for n in docs.columns])
