"""How the sources of a language differ in their words: an audit of source against source, and against the language.

Integer-dictionary encoding. Tasks count the terms of their documents and pack the counts by language and bucket of
terms (a hash): one row has a bucket's sorted terms, in how many documents each is, and for each source the numbers of
its terms with their counts. Each bucket's rows meet in one task: the terms that enough documents have are its sorted
array, a row's terms become ids by searchsorted, and bincount adds each source's counts into a dense vector over those ids.
Ids ascend as the terms' UTF-8 bytes do, so a stable sort by value breaks ties by term. Vectors are kept in chunks of at
most ``cells`` counts; where few terms are kept, the vectors of many buckets are put together to one chunk. Every later step
goes over chunks: shares, differences between sources (summed), and the most over-represented terms of each source (merged
from each chunk's first ones, which are few beside its counts).

All arithmetic is in integers: p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)) by long division in base 1000, which is
exact while N + 5 * V is under 9 * 10^15.

Buckets follow spark.sql.shuffle.partitions. A frequent term adds one count a source and task, so it makes no hot
bucket; a language's or a source's share of the rows doesn't matter, as all tasks reduce theirs first.

Defined results: null text, lang or source are ''; a source without terms is there, with counts of 0; repeated rows count
each; a language with one source has no pairs; one without kept terms has pairs of value 0 and no term rows; an empty
table gives an empty result; other columns are ignored; terms of any length are kept whole.
"""

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickyard.llm._shared import checkpointed, named, release, small_batches

#: Entries of a task's tables before it packs them.
ENTRIES = 1_000_000
#: Counts in a dense chunk: sources times terms.
CELLS = 1_000_000
SCALE = 1_000_000_000
PRIOR = 5
_SHORT = 24
PACKED = "lang string, bucket int, terms binary, n_docs binary, sources array<string>, sizes binary, ids binary, counts binary"
CHUNKS = "lang string, bucket int, slice int, n_terms long, terms binary, sources array<string>, sums array<long>, counts binary"
PARTIAL = "lang string, part string, source string, item string, value long"
# A-Z to a-z, letters and bytes of other characters as they are, all else to a blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Terms:
    """A sorted array of terms and their ids in it; the few long ones stand apart, so that the others fit a fixed width."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        short = [i for i, t in enumerate(terms) if len(t) <= _SHORT]
        self.ids = np.array(short, np.int64)
        self.short = np.array([terms[i] for i in short], f"S{_SHORT}")

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """The id of each wanted term, -1 if it isn't there."""
        out = np.full(len(wanted), -1, np.int64)
        fits = np.array([len(t) <= _SHORT for t in wanted], bool)
        if len(self.short) and fits.any():
            keys = np.array([t for t in wanted if len(t) <= _SHORT], f"S{_SHORT}")
            at = np.minimum(np.searchsorted(self.short, keys), len(self.short) - 1)
            out[fits] = np.where(self.short[at] == keys, self.ids[at], -1)
        for i in np.flatnonzero(~fits).tolist():
            at = bisect_left(self.terms, wanted[i])
            if at < len(self.terms) and self.terms[at] == wanted[i]:
                out[i] = at
        return out


def _packed(lang: str, n_docs: Counter, counts: dict[str, Counter], buckets: int):
    """The counts of a language as a row a bucket."""
    by_bucket: dict[int, list[bytes]] = defaultdict(list)
    for term in n_docs:
        by_bucket[zlib.crc32(term) % buckets].append(term)
    number, where = {}, {}
    for bucket, terms in by_bucket.items():
        terms.sort()
        number.update((t, i) for i, t in enumerate(terms))
        where.update(dict.fromkeys(terms, bucket))
    sources = {b: [] for b in by_bucket}
    sizes, ids, values = ({b: [] for b in by_bucket} for _ in range(3))
    for source, counted in counts.items():
        place = np.fromiter(map(where.__getitem__, counted), np.int64, len(counted))
        term = np.fromiter(map(number.__getitem__, counted), np.int64, len(counted))
        count = np.fromiter(counted.values(), np.int64, len(counted))
        order = np.lexsort((term, place))
        place, term, count = place[order], term[order], count[order]
        cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = int(place[a])
            sources[at].append(source)
            sizes[at].append(b - a)
            ids[at].append(term[a:b].astype("<i4").tobytes())
            values[at].append(count[a:b].astype("<i8").tobytes())
    for b, terms in by_bucket.items():
        yield {"lang": lang, "bucket": b, "terms": b" ".join(terms), "n_docs": np.array([n_docs[t] for t in terms], "<i8").tobytes(), "sources": sources[b], "sizes": np.array(sizes[b], "<i8").tobytes(), "ids": b"".join(ids[b]), "counts": b"".join(values[b])}


def _count(buckets: int):
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("terms", pa.binary()), ("n_docs", pa.binary()), ("sources", pa.list_(pa.string())), ("sizes", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        n_docs: dict[str, Counter] = defaultdict(Counter)
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

        def flush():
            for lang, by_source in counts.items():
                rows = []
                for row in _packed(lang, n_docs[lang], by_source, buckets):
                    rows.append(row)
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
            n_docs.clear()
            counts.clear()

        for batch in batches:
            for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = Counter(text.encode().translate(_TERM_BYTES).split())
                n_docs[lang].update(found.keys())
                counts[lang][source].update(found)
            if sum(len(c) for by_source in counts.values() for c in by_source.values()) >= ENTRIES:
                yield from flush()
        yield from flush()
        release()

    return run


def _chunk(least: int, cells: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        terms = [r["terms"].split(b" ") for r in rows]
        n_docs: dict[bytes, int] = {}
        for row, own in zip(rows, terms, strict=True):
            for t, n in zip(own, np.frombuffer(row["n_docs"], "<i8").tolist(), strict=True):
                n_docs[t] = n_docs.get(t, 0) + n
        kept = Terms(sorted(t for t, n in n_docs.items() if n >= least))
        size = len(kept.terms)
        vectors: dict[str, np.ndarray] = {}
        for row, own in zip(rows, terms, strict=True):
            code = kept.find(own)
            ids, values = code[np.frombuffer(row["ids"], "<i4")], np.frombuffer(row["counts"], "<i8")
            ends = np.cumsum(np.frombuffer(row["sizes"], "<i8")).tolist()
            for source, a, b in zip(row["sources"], [0, *ends], ends, strict=False):
                known = ids[a:b] >= 0
                if known.any():  # sums of whole numbers under 2^53 are exact
                    found = np.bincount(ids[a:b][known], values[a:b][known], size).astype(np.int64)
                    vectors[source] = vectors[source] + found if source in vectors else found
        sources = sorted(vectors)
        out = []
        wide = max(1, cells // max(1, len(sources)))
        for number, a in enumerate(range(0, size, wide)):
            part = np.array([vectors[s][a : a + wide] for s in sources])
            out.append({"lang": rows[0]["lang"], "bucket": rows[0]["bucket"], "slice": number, "n_terms": part.shape[1], "terms": b" ".join(kept.terms[a : a + wide]), "sources": sources, "sums": part.sum(axis=1).tolist(), "counts": part.astype("<i8").tobytes()})
        schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("slice", pa.int32()), ("n_terms", pa.int64()), ("terms", pa.binary()), ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("counts", pa.binary())])
        return pa.Table.from_pylist(out, schema)

    return run


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + PRIOR) / total), exactly."""
    rest, out = counts + PRIOR, np.zeros_like(counts)
    for _ in range(3):  # SCALE is 1000^3
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _compare(top: int):
    """The vectors of a chunk, and its language's totals, to sums of differences and each source's first terms."""

    def run(parts: pa.Table, totals: pa.Table) -> pa.Table:
        about = totals.to_pylist()[0]
        groups = sorted((g["source"], g["n"]) for g in about["groups"])
        names, n = [s for s, _ in groups], np.array([x for _, x in groups], np.int64)
        at = {s: i for i, s in enumerate(names)}
        rows = parts.to_pylist()
        terms = [t for r in rows for t in r["terms"].split(b" ")]
        counts = np.zeros((len(names), len(terms)), np.int64)
        begin = 0
        for r in rows:
            counts[[at[s] for s in r["sources"]], begin : begin + r["n_terms"]] = np.frombuffer(r["counts"], "<i8").reshape(len(r["sources"]), -1)
            begin += r["n_terms"]
        order = sorted(range(len(terms)), key=terms.__getitem__)  # ids by the terms' bytes
        terms, counts = [terms[i].decode() for i in order], counts[:, order]
        p = shares(counts, (n + PRIOR * about["kept"])[:, None])
        q = shares(counts.sum(axis=0), n.sum() + PRIOR * about["kept"])
        out: list[tuple[str, str, str, int]] = []
        for i, source in enumerate(names):
            out += [("pair", source, o, int(v)) for o, v in zip(names[i + 1 :], np.abs(p[i + 1 :] - p[i]).sum(axis=1), strict=True)]
            over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = (p[i] - q)[over]
            first = np.argsort(-value, kind="stable")[:top]  # ties stay in the ids' order
            out += [("term", source, terms[j], v) for j, v in zip(over[first].tolist(), value[first].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({"lang": pa.array([about["lang"]] * len(out), pa.string()), "part": pa.array(columns[0], pa.string()), "source": pa.array(columns[1], pa.string()), "item": pa.array(columns[2], pa.string()), "value": pa.array(columns[3], pa.int64())})

    return run


def source_divergence(docs: DataFrame, least: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source", cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the other ones by how far their shares of
    the kept terms (in at least ``least`` documents of the language) differ in sum (part pair), and the ``top`` terms
    whose share is most above the language's (part term)."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*[F.coalesce(named(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    chunks = checkpointed(rows.mapInArrow(_count(buckets), PACKED).groupBy("lang", "bucket").applyInArrow(_chunk(least, cells), CHUNKS))
    kept = chunks.groupBy("lang").agg(F.sum("n_terms").alias("kept"))
    sums = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    totals = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "n")).alias("groups")).join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    number = F.greatest(F.lit(1), F.ceil(F.col("kept") * F.size("groups") / cells)).cast("int").alias("number")
    # One row a bucket, so that a large language's rows needn't meet in one task where this isn't broadcast.
    places = totals.select("lang", number, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    dealt = chunks.join(places, ["lang", "bucket"]).withColumn("chunk", ((F.col("bucket") + F.col("slice") * buckets) % F.col("number")).cast("int"))
    dealt = dealt.select("lang", "chunk", "n_terms", "terms", "sources", "counts")
    totals = totals.select("lang", "groups", "kept", F.explode(F.sequence(F.lit(0), number - 1)).alias("chunk"))
    found = checkpointed(dealt.groupBy("lang", "chunk").cogroup(totals.groupBy("lang", "chunk")).applyInArrow(_compare(top), PARTIAL))
    order = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    terms = found.filter("part = 'term'").withColumn("rank", order).filter(F.col("rank") <= top)
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    halves = found.filter("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    pairs = halves.select("lang", "part", sides.alias("x"), "value").select("lang", "x.source", "part", "x.item", "value").withColumn("rank", order)
    return pairs.unionByName(terms.select(*pairs.columns))
