"""Benchmark decontamination with a generalised suffix automaton of the test items.

Texts are lower-cased (A-Z) and cut to words of digits, letters a-z and bytes above 0x7F.
The items' word sequences build one automaton; each document is streamed through it, word by
word, keeping the longest match that ends at the word. A match of ``window`` words or more
makes its last ``window`` words a hit, and so does a whole item of fewer words.

Items are cut into blocks of about ``block_words`` words by hash. A task builds the automaton of a block
and packs it as arrays: transitions, suffix links, and the items at the places where the link tree puts
them, so what a state's items are is a range and nothing is stored twice. A packed block has 200,000 states
at most for 100,000 words, about 10 MB unpacked in a worker's arrays and 40 MB with its transitions as a
dictionary; blocks are written to the shared folder, broadcast one by one, and a worker unpacks one at a
time. No more than ``PASS`` blocks are in use at once: a larger benchmark takes several passes, each with
its results written before the next begins, so what is broadcast has a bound that no input moves. The
documents are never shuffled.

Defined results: null or empty texts, and texts without words, have no words and no hits;
items without words match nothing; a null item id is listed as "null"; repeated items are
counted once each; null document ids stay null; an empty benchmark leaves everything clean.
Extra columns pass through; ``spans`` columns are added under the names asked for, and an
input column of that name is replaced.
"""

import pickle
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickyard.llm._shared import checkpointed, new_path, small_batches, unused

WINDOW = 10
#: Blocks that are broadcast at the same time.
PASS = 16
#: Bytes of words keep (A-Z lower-cased); all others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """States of all substrings of several word sequences."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, nexts: dict[bytes, int], link: int) -> int:
        self.next.append(nexts)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A copy of q for the strings that end a transition of p's length."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another item has been here
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def build(self, items: list[tuple[str, list[bytes]]]) -> "SuffixAutomaton":
        items = [(name, words) for name, words in items if words]
        self.names = [name for name, _ in items]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.ends: list[list[int]] = [[] for _ in self.next]  # items with a prefix that ends in the state
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]  # whole items of fewer words than a window
        for item, (_, words) in enumerate(items):
            state = 0
            for word in words:
                state = self.next[state][word]
                self.ends[state].append(item)
            if len(words) < self.window:
                self.short[state].append((len(words), item))
        # The suffix of exactly window words lives in this state.
        self.cut = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.cut[s] = self.cut[up] if self.length[up] >= self.window else s
        return self

    def pack(self) -> bytes:
        """The automaton as arrays, compressed."""
        n = len(self.next)
        vocab = sorted({w for nexts in self.next for w in nexts})
        number = {w: i for i, w in enumerate(vocab)}
        edges = [(s * len(vocab) + number[w], t) for s, nexts in enumerate(self.next) for w, t in nexts.items()]
        # Places in the link tree: a state's own range holds those of all states below it.
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        below = [len(x) for x in self.ends]
        for s in reversed(by_length):
            below[self.link[s]] += below[s]
        at, free = [0] * n, [len(x) for x in self.ends]
        for s in by_length:
            up = self.link[s]
            at[s] = at[up] + free[up]
            free[up] += below[s]
        held = np.zeros(below[0], np.int32)
        for s, items in enumerate(self.ends):
            held[at[s] : at[s] + len(items)] = items
        marked = [0] * n  # the nearest state, from here up, at which short items end
        for s in by_length:
            marked[s] = s if self.short[s] else marked[self.link[s]]
        arrays = {"edge": np.array([e for e, _ in edges], np.int64), "to": np.array([t for _, t in edges], np.int32), "held": held}
        arrays |= {k: np.array(v, np.int32) for k, v in (("link", self.link), ("length", self.length), ("cut", self.cut), ("at", at), ("below", below), ("marked", marked))}
        short = {s: x for s, x in enumerate(self.short) if x}
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((self.window, vocab, self.names, short, arrays), protocol=5))


class PackedAutomaton:
    """A packed block, opened for matching."""

    def __init__(self, blob: bytes):
        self.window, vocab, self.names, self.short, x = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
        self.number = {w: i for i, w in enumerate(vocab)}
        self.to = dict(zip(x["edge"].tolist(), x["to"].tolist(), strict=True))
        self.link, self.length, self.cut, self.marked = (x[k].tolist() for k in ("link", "length", "cut", "marked"))
        self.held, self.at, self.below = x["held"], x["at"], x["below"]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words and the items whose windows occur."""
        get, link, length, marked, window, wide = self.to.get, self.link, self.length, self.marked, self.window, len(self.number)
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        found: set[int] = set()
        state = n = 0
        for i, word in enumerate(map(self.number.get, words)):
            if word is None:
                state = n = 0
                continue
            t = get(state * wide + word)
            while t is None and state:
                state = link[state]
                n = length[state]
                t = get(state * wide + word)
            if t is None:
                n = 0
                continue
            n += 1
            state = t
            reach = 0
            if n >= window:
                reach = window
                states.add(self.cut[state])
            s = marked[state]
            while s:
                for size, item in self.short[s]:
                    if size <= n:
                        found.add(item)
                        reach = max(reach, size)
                s = marked[link[s]]
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        for s in states:
            found.update(self.held[self.at[s] : self.at[s] + self.below[s]].tolist())
        return spans, {self.names[i] for i in found}


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _pack_block(window: int):
    def run(key, table):
        items = sorted(zip(table.column("item").to_pylist(), map(words_of, table.column("text").to_pylist()), strict=True))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([SuffixAutomaton(window).build(items).pack()], pa.binary())})

    return run


def packed_blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> tuple[DataFrame, int]:
    """(block, packed) in the shared folder, and their number."""
    d = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text}`").alias("text")).filter("text is not null").distinct()
    words = d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    number = -(-words // block_words)
    where = new_path(items.sparkSession, "automaton")
    block = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, number))).cast("int").alias("block")
    d.select(block, "item", "text").groupBy("block").applyInArrow(_pack_block(window), "block int, packed binary").write.parquet(where)
    return items.sparkSession.read.schema("block int, packed binary").parquet(where), number


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = 100_000, out: str = "hits") -> DataFrame:
    """docs with struct ``out``: n_words, n_hit, items (ids sorted as strings) and spans (word ranges)."""
    spark = docs.sparkSession
    small_batches(spark)
    df = docs.drop(out)
    names = df.columns
    at = names.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(out, HITS)])
    blocks, number = packed_blocks(items, item_id, item_text, window, block_words)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def scan(some, first):
        def run(batches):
            opened = PackedAutomaton(some[0].value) if len(some) == 1 else None
            for batch in batches:
                words = [words_of(v.as_py()) for v in batch.column(at)]
                known = [None] * batch.num_rows if first else batch.column(len(names)).to_pylist()
                spans = [[(s["start"], s["end"]) for s in k["spans"]] if k else [] for k in known]
                found = [set(k["items"]) if k else set() for k in known]
                for block in some:
                    automaton = opened or PackedAutomaton(block.value)
                    for i, w in enumerate(words):
                        more, named = automaton.match(w)
                        if more:
                            spans[i] = _merge(spans[i] + more)
                            found[i] |= named
                rows = [{"n_words": len(w), "n_hit": sum(e - s for s, e in x), "items": sorted(f), "spans": [{"start": s, "end": e} for s, e in x]} for w, x, f in zip(words, spans, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(rows, kind)], names=[*names, out])

        return run

    for begin in range(0, max(1, number), PASS):
        some = []
        for block in range(begin, min(begin + PASS, number)):
            row = blocks.filter(F.col("block") == block).select("packed").first()
            if row:
                some.append(spark.sparkContext.broadcast(bytes(row[0])))
        df = df.mapInArrow(scan(some, not begin), schema)
        if begin + PASS < number:  # this pass is done before the next one's blocks are sent
            df = checkpointed(df)
            for block in some:
                block.destroy()
    return df


def contamination_report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items, spans."""
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return with_hits(df, items, window=window).select("doc_id", "hits.*")


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    parts, start = [], 0
    for s, e in spans:
        parts.append(raw[start : at[s][0]])
        start = at[e - 1][1]
    return b"".join([*parts, raw[start:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, min_span: int = 1, max_coverage: float = 0.5) -> DataFrame:
    """docs without hit spans of min_span words or more, and without documents of which more than max_coverage is hit."""
    out = unused("hits", docs.columns)
    df = with_hits(docs, items, text=text, window=window, out=out)
    hit: Column = F.col(f"`{out}`")
    df = df.filter(hit["n_hit"] <= hit["n_words"] * F.lit(max_coverage))
    names, at, schema = docs.columns, docs.columns.index(text), docs.schema

    def rewrite(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, hits in enumerate(batch.column(len(names)).to_pylist()):
                spans = [(s["start"], s["end"]) for s in hits["spans"] if s["end"] - s["start"] >= min_span]
                if spans:
                    texts[i] = _cut(texts[i], spans)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(rewrite, schema)
