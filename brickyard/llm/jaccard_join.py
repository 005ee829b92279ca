"""N-gram Jaccard self-join with a token-group matrix.

A document's set is its distinct word shingles. Equal sets are one class from the start. Sets
whose Jaccard similarity is at least t differ in at most D tokens, D bounded by their sizes, so if
tokens are dealt to D + 1 + s parts, at least s + 1 parts are equal in both. Sets are banded by size and
announce the hashes of their parts that hold tokens; a set with more than s empty parts announces a
second dealing too, and so on until it has a dealing with s empty parts at most. Of two similar sets
one reaches its last dealing first: there at least one of the equal parts isn't empty, and both have
announced it. Sets that announce one hash belong to one partition of similar documents. Nothing is lost
by that, empty parts bring no sets together, and no pairs are made: a partition is found by its least
member.

A partition is cut into blocks of about ``block`` tokens, each checked in a task of its own. In a block,
sets form groups round a leader; a token-group matrix holds for each token the groups whose unions have
it. A query set's overlap with a group's union bounds its overlap with any member, so only groups with
bound >= t * |set| are opened, the leader first, and an opened group is left at the first link, as its
members are all of one class. Where a partition has several blocks, two rounds go across them: the first
set of each class of each block is held against the groups of the other blocks, and then each set that
is still outside its partition's largest class is, so that no two sets of different classes stay
uncompared. A partition of near copies of one text is settled by the first round, however many there are; one
of many sets in many classes costs, beyond a block, the square of its number of blocks.

Defined results: a text of fewer words than a shingle is one shingle; a null or empty text, or one
without words, has no shingles and is linked with nothing; rows that repeat an id are one class if
their sets are equal; a null id is not linked with anything and gets component null; columns other
than id and text are ignored; an empty table gives an empty result.
"""

import decimal
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickyard.llm._components import components
from brickyard.llm._shared import checkpointed, freed, named, release, small_batches
from brickyard.llm._words import shingle_hashes, signed, word_hashes
from brickyard.llm.perfect_hash import mix64

SEEN = 200_000
#: Tokens of a block: 32 MB of hashes, about 150 MB with their numbers, groups and matrix.
BLOCK = 4_000_000


def token_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), words))


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """126 bits that stand for the set: the low 64 as a signed number, and all of them."""
    with np.errstate(over="ignore"):
        pair = np.array([mix64(tokens, 21).sum() + np.uint64(len(tokens)), mix64(tokens, 22).sum()], np.uint64)
    low, high = mix64(pair, 23)
    return int(low.astype(np.int64)), (int(high) >> 2) << 64 | int(low)


def _decimals(keys: list[int | None]) -> pa.Array:
    return pa.array([None if k is None else decimal.Decimal(k) for k in keys], pa.decimal128(38, 0))


class Parts:
    """Part signatures for similarity of at least num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError(f"A similarity is over 0 and at most 1, not {num} / {den}")
        self.num, self.den = num, den
        self.starts = [1]  # sizes at which bands start; similar sets are in the same band or in adjacent ones
        self.shapes: dict[int, tuple[int, int]] = {}

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def shape(self, band: int) -> tuple[int, int]:
        """(parts, spare parts) for sets of this band and the next.

        Spare parts are as many as are empty on average in the band's smallest sets. Where similar sets may differ in
        so much that the smallest can't fill the parts, there are none (parts of -1), and each token is a part.
        """
        if band not in self.shapes:
            while len(self.starts) < band + 3:
                self.starts.append(self.starts[-1] * self.den // self.num + 1)
            least, most = self.starts[band], self.starts[band + 1] - 1
            differ = most * (self.den - self.num) // self.num
            spare = 1
            for _ in range(8):
                parts = differ + 1 + spare
                spare = max(1, math.ceil(parts * math.exp(-least / parts)))
            # More parts than tokens would leave some empty whatever the dealing.
            most_spare = max(1, least - differ - 1)
            fits = differ + 2 <= least and spare <= most_spare + most_spare // 8
            spare = min(spare, most_spare)
            self.shapes[band] = ((differ + 1 + spare, spare) if fits else (-1, 0)) if differ else (0, 0)
        return self.shapes[band]

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        """Hashes of the set's parts; their low six bits are the band they are for."""
        out, bands = [], []
        own = self.band(len(tokens))
        for band in (own - 1, own):
            parts, spare = self.shape(band) if band >= 0 else (0, 0)
            if not parts:
                continue  # sets that similar are equal
            if parts < 0:
                out.append(mix64(tokens ^ mix64(np.uint64([band]), 33), 34))
                bands.append(np.full(len(tokens), band, np.uint64))
                continue
            deal = 0
            while True:
                place = (mix64(tokens, 31 + 64 * deal) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                place = place[order]
                first = np.flatnonzero(np.diff(place, prepend=-1))
                with np.errstate(over="ignore"):
                    sums = np.add.reduceat(mix64(tokens, 32)[order], first)
                    tag = place[first].astype(np.uint64) * np.uint64(0x10001) + np.uint64((band << 40) + (deal << 48))
                    out.append(mix64(sums ^ mix64(tag, 33), 34))
                bands.append(np.full(len(first), band, np.uint64))
                if parts - len(first) <= spare:
                    break
                deal += 1
        if not out:
            return np.zeros(0, np.uint64)
        return np.concatenate(out) & ~np.uint64(63) | np.concatenate(bands) & np.uint64(63)


def shared_ids(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The sets' tokens that another set has too, as small numbers; others can't add to an overlap.

    Tokens are compared range by range, so memory is little more than the sets themselves.
    """
    ranges = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    cuts = [np.concatenate([[0], np.searchsorted(s, ranges), [len(s)]]) for s in sets]
    parts: list[list[np.ndarray]] = [[] for _ in sets]
    known = 0
    for r in range(16):
        sizes = [c[r + 1] - c[r] for c in cuts]
        flat = np.concatenate([s[c[r] : c[r + 1]] for s, c in zip(sets, cuts, strict=True)])
        if not len(flat):
            continue
        _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
        number = np.where(times > 1, known + np.cumsum(times > 1) - 1, -1)
        known += int((times > 1).sum())
        for out, ids in zip(parts, np.split(number[inverse], np.cumsum(sizes)[:-1]), strict=True):
            out.append(ids[ids >= 0])
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts], known


class TokenGroups:
    """Sets of one partition, their groups and the matrix of tokens and groups.

    ``known`` are classes found before (equal numbers: one class). Sets from ``asked`` on are only held
    against the groups of the others.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int, known: list[int] | None = None, asked: int | None = None):
        self.num, self.den = num, den
        self.asked = len(sets) if asked is None else asked
        self.sizes = np.array([len(s) for s in sets])
        self.sets, n_known = shared_ids(sets)
        self.rows: list[list[int]] = [[] for _ in range(n_known)]  # token -> groups whose union has it
        self.groups: list[list[int]] = []
        self.mark = np.zeros(n_known + 1, bool)
        self.none = np.array([n_known])
        self.root = list(range(len(sets)))
        self.known = known
        if known is not None:
            first: dict[int, int] = {}
            self.root = [first.setdefault(k, i) for i, k in enumerate(known)]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def _linked(self, query: int, members: list[int]) -> int:
        """The first of the members linked with the query (whose tokens are marked), or -1."""
        n = self.sizes[query]
        for at in range(0, len(members), 256):
            some = members[at : at + 256]
            sizes = self.sizes[some]
            # Each set ends with an unmarked token, so none is empty.
            held = np.array([len(self.sets[m]) + 1 for m in some])
            flat = np.concatenate([x for m in some for x in (self.sets[m], self.none)])
            both = np.add.reduceat(self.mark[flat].astype(np.int64), np.cumsum(held) - held)
            hit = np.flatnonzero(self.den * both >= self.num * (n + sizes - both))
            if len(hit):
                return some[hit[0]]
        return -1

    def _opened(self, q: int, tokens: list[int]) -> list[int]:
        """Groups whose unions may hold a set linked with q, the likeliest first."""
        need = -(-self.num * int(self.sizes[q]) // self.den)
        rows = [self.rows[t] for t in tokens]
        if len(rows) < need:
            return []
        # A union that misses so many of the tokens in the fewest groups can't have enough of the rest.
        fewest = sorted(map(len, rows))[: len(rows) - need + 1]
        if not fewest[-1]:
            return []
        near = [g for row in rows for g in row]
        overlap = np.bincount(near, minlength=len(self.groups))
        opened = np.flatnonzero(overlap >= need)
        return opened[np.argsort(-overlap[opened], kind="stable")].tolist()

    def _place(self, q: int, home: int, tokens: list[int]) -> None:
        if home < 0:
            home = len(self.groups)
            self.groups.append([])
        self.groups[home].append(q)
        for t in tokens:
            row = self.rows[t]
            if not row or home not in row:
                row.append(home)

    def _ask(self, q: int, tokens: list[int], home: int = -1) -> int:
        """Links q with the groups; returns the group whose leader is linked with it, or -1, unless a home is given."""
        self.mark[tokens] = True
        for g in self._opened(q, tokens):
            members = self.groups[g]
            same = self.find(q) == self.find(members[0])
            if same and home >= 0:
                continue
            by_leader = self._linked(q, members[:1]) >= 0
            if by_leader and home < 0:
                home = g
            if not same and (by_leader or self._linked(q, members[1:]) >= 0):
                self.root[self.find(q)] = self.find(members[0])
        self.mark[tokens] = False
        return home

    def run(self) -> list[int]:
        """For each set the first set of its class."""
        by_size = sorted(range(self.asked), key=lambda i: -self.sizes[i])
        if self.known is not None:  # groups are the classes that are known
            home: dict[int, int] = {}
            for q in by_size:
                self._place(q, home.get(self.known[q], -1), self.sets[q].tolist())
                home.setdefault(self.known[q], len(self.groups) - 1)
        else:
            for q in by_size:
                tokens = self.sets[q].tolist()
                self._place(q, self._ask(q, tokens), tokens)
        for q in range(self.asked, len(self.sets)):
            self._ask(q, self.sets[q].tolist(), home=0)
        return [self.find(i) for i in range(len(self.sets))]


def _keys(words: int):
    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                tokens = token_set(text, words)
                rows.append((len(tokens), *(set_key(tokens) if len(tokens) else (None, None))))
            n, k1, key = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), _decimals(key)], names=["doc_id", "n_shingles", "k1", "key"])
        release()

    return run


def _announce(words: int, num: int, den: int):
    def run(batches):
        parts, seen = Parts(num, den), set()
        for batch in batches:
            keys, sigs = [], []
            for text in batch.column(0).to_pylist():
                tokens = token_set(text, words)
                if not len(tokens):
                    continue
                low, key = set_key(tokens)
                if key in seen:  # a copy in this task: it announces nothing new
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                found = signed(parts.signatures(tokens))
                sigs.append(found)
                keys.append(np.full(len(found), low, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(keys))], names=["sig", "k1"])
        release()

    return run


def _shrink(batches):
    """Texts compressed for their way to their partitions."""
    zstd = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [zstd.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def _unpacked(table: pa.Table, words: int) -> tuple[list[int], list[np.ndarray], list[int]]:
    """Keys, sets and rows of a table of packed texts."""
    keys, sets, rows = [], [], []
    zstd = zstandard.ZstdDecompressor()
    for i, (key, packed) in enumerate(zip(table.column("key").to_pylist(), table.column("packed"), strict=True)):
        tokens = token_set(zstd.decompress(packed.as_py()).decode(), words)
        if len(tokens) and set_key(tokens)[1] == int(key):  # another text under the same id is not meant
            keys.append(int(key))
            sets.append(tokens)
            rows.append(i)
    return keys, sets, rows


def _verify(words: int, num: int, den: int):
    """A block's sets: each with the first of its class."""

    def run(table):
        keys, sets, _ = _unpacked(table, words)
        first = TokenGroups(sets, num, den).run()
        if table.num_rows > 500:
            release()
        return pa.table({"a": _decimals(keys), "b": _decimals([keys[i] for i in first])})

    return run


def _verify_across(words: int, num: int, den: int):
    """Sets of other blocks (``asked``) against a block's: each with the first of its class."""

    def run(table):
        table = table.sort_by([("asked", "ascending"), ("key", "ascending")])
        keys, sets, rows = _unpacked(table, words)
        flags, classes = table.column("asked").to_pylist(), table.column("class").to_pylist()
        number = {c: i for i, c in enumerate(dict.fromkeys(classes))}
        n_own = sum(not flags[r] for r in rows)
        first = TokenGroups(sets, num, den, [number[classes[r]] for r in rows], n_own).run()
        release()
        return pa.table({"a": _decimals(keys), "b": _decimals([keys[i] for i in first])})

    return run


_LINK = "a decimal(38,0), b decimal(38,0)"


def _blocked(members: DataFrame, by: list[str], name: str, block: int) -> DataFrame:
    """members with ``name``: a block of about ``block`` tokens, and ``name``_n, how many there are, for each group of ``by``."""
    weight = members.groupBy(*by).agg(F.ceil(F.sum("n_shingles") / F.lit(block)).cast("int").alias(f"{name}_n"))
    return members.join(weight, by).withColumn(name, F.pmod(F.xxhash64(F.lit(name), "key"), F.col(f"{name}_n")).cast("int"))


def _across(cut: DataFrame, links: DataFrame, words: int, num: int, den: int, block: int) -> DataFrame:
    """Links within partitions of several blocks (cut: root, block, block_n, key, n_shingles, packed), with those between blocks."""
    state = cut.drop("packed")
    texts = cut.select("root", "key", "packed")
    for everything in (False, True):
        classes = components(links).select(F.col("node").alias("key"), F.col("root").alias("class"))
        held = checkpointed(state.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key")))
        sizes = held.groupBy("root", "class").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("root").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.count("*").alias("classes")).filter("classes > 1")
        open_ = held.join(largest, "root")
        if everything:
            asked = open_.filter(F.col("class") != F.col("largest"))
        else:
            leads = open_.groupBy("root", "block", "class").agg(F.min("key").alias("key"))
            asked = open_.join(leads, ["root", "block", "class", "key"], "left_semi")
        asked = checkpointed(_blocked(asked.select("root", "block", "block_n", "key", "n_shingles", "class"), ["root"], "part", block))
        parts = asked.select("root", "part").distinct()
        own = open_.join(parts, "root").select("root", "block", "key", "class", "part", F.lit(False).alias("asked"))
        others = asked.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("block_n") - 1))).filter("at <> block")
        others = others.select("root", F.col("at").alias("block"), "key", "class", "part", F.lit(True).alias("asked"))
        # Texts come last, to the rows that need them.
        needed = own.unionByName(others).join(texts, ["root", "key"])
        found = needed.groupBy("root", "block", "part").applyInArrow(_verify_across(words, num, den), _LINK)
        links = checkpointed(links.unionAll(found.filter("a <> b")))
    return links


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, num: int = 9, den: int = 10, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the least doc_id reachable by links of similarity >= num/den)."""
    Parts(num, den)  # says now what's wrong with them
    if words < 1:
        raise ValueError("a shingle has one word at least")
    small_batches(docs.sparkSession)
    d = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    rows = checkpointed(d.mapInArrow(_keys(words), "doc_id long, n_shingles long, k1 long, key decimal(38,0)"))
    said = d.select("text").mapInArrow(_announce(words, num, den), "sig long, k1 long")
    # Partitions are kept apart by size band: similar sets share one, and common passages don't chain all sizes together.
    # A row that is dealt by its hash has 16 bytes, whose names in their bands are made where it arrives.
    node = lambda k: F.struct(F.xxhash64(k, F.col("sig").bitwiseAND(63)).alias("node"), F.col(k).alias("k1"))
    star = said.withColumn("first", F.min("k1").over(Window.partitionBy("sig"))).filter("k1 <> first").select(node("k1").alias("a"), node("first").alias("b"))
    star = checkpointed(star.distinct())
    freed(docs.sparkSession)  # the announced parts are the most that this writes
    near = components(star.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    nodes = star.select("a.*").union(star.select("b.*")).distinct()
    # One text of each set that shares a part with another set goes to its partition.
    holders = rows.filter("key is not null and doc_id is not null").groupBy("key", "k1", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    wanted = near.join(nodes, "node").join(holders, "k1").select("root", "key", "doc_id", "n_shingles")
    wanted = checkpointed(_blocked(wanted, ["root"], "block", block))
    packed = d.mapInArrow(_shrink, "doc_id long, packed binary")
    texts = packed.join(wanted, "doc_id").select("root", "block", "block_n", "key", "n_shingles", "packed")
    links = texts.groupBy("root", "block").applyInArrow(_verify(words, num, den), _LINK)
    links = checkpointed(links.filter("a <> b"))
    if not wanted.filter("block_n > 1").isEmpty():
        # Rows that repeat an id bring a text again.
        links = _across(checkpointed(texts.filter("block_n > 1").dropDuplicates(["root", "key", "packed"])), links, words, num, den, block)
    classes = components(links)
    freed(docs.sparkSession)
    keyed = rows.join(classes.select(F.col("node").alias("key"), "root"), "key", "left")
    label = keyed.withColumn("class", F.coalesce("root", "key"))
    least = label.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    found = label.join(least, "class", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
