"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Tasks tokenize their documents. The ids (two bytes each where the vocabulary allows) are dealt to partitions by a hash of
the document and its place, and ordered by it, so that each partition streams documents in random order. So many tokens
of them make a group; groups are packed by themselves. A document longer than a sequence first gives whole sequences;
what is left of it, shorter than one, is an item. Items are placed by decreasing size, each in the first bin with room
for it: a tournament tree holds the most room below each node, so the bin is found in log time. Gaps that remain are
closed by cutting: the least filled bins are taken apart, and their items fill the gaps of the others. At most one bin a
group is then not full; its tokens go to sequences whose lengths are powers of two, which need no padding.

Memory follows the group: ``GROUP_TOKENS`` tokens of items, or one document. Documents are dealt one by one, so equal ids,
sources and texts of any number make no hot partition. The order within a partition doesn't depend on the order in which
shuffled rows come in, so a task that is run again gives the same sequences.

Defined results: a null or empty text is the end id alone; repeated rows and ids are packed each; null ids stay null; an
empty table gives an empty result; other columns are ignored; a document of any length is packed whole.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm._shared import named, release, small_batches
from brickyard.llm.token_files import ChunkEncoder, _slices

LENGTH = 2048
GROUP_TOKENS = 8_000_000
TOKENS = "doc_id long, place long, wide boolean, tokens binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """A tournament tree: a leaf is the room in a bin, a node the most room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)
        self.used = 0

    def take(self, size: int) -> int:
        """The first bin with room for the size, which it loses."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        bin_ = node - self.leaves
        most[node] -= size
        while node > 1:
            node //= 2
            above = max(most[2 * node], most[2 * node + 1])
            if most[node] == above:
                break
            most[node] = above
        self.used = max(self.used, bin_ + 1)
        return bin_


def first_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """The items of each bin: by decreasing size (ties: earlier first), each in the first bin with room."""
    tree = CapacityTree(len(sizes), length)
    bins: list[list[int]] = [[] for _ in sizes]
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[tree.take(sizes[item])].append(item)
    return bins[: tree.used]


def _powers(pieces: list[tuple[int, int, int]]):
    """The pieces (item, start, size) of a bin that isn't full, in sequences of powers of two."""
    left = sum(p[2] for p in pieces)
    at, done = 0, 0
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out = []
        while want:
            item, start, size = pieces[at]
            took = min(want, size - done)
            out.append((item, start + done, took))
            want, done = want - took, done + took
            if done == size:
                at, done = at + 1, 0
        yield out


def packed(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start in it, size) of items shorter than ``length``: all full, or a power of two long."""
    bins = [[(i, 0, sizes[i]) for i in own] for own in first_fit_decreasing(sizes, length)]
    room = [length - sum(p[2] for p in own) for own in bins]
    gaps = sorted((k for k in range(len(bins)) if room[k]), key=lambda k: (room[k], k))
    spare: list[tuple[int, int, int]] = []  # pieces of bins that were taken apart
    low, high = 0, len(gaps)
    while low < high:
        # The fullest bin that has a gap is filled up, from the least filled one.
        k = gaps[low]
        while room[k]:
            if not spare:
                high -= 1
                if high <= low:
                    break
                spare, bins[gaps[high]] = bins[gaps[high]], []
            item, start, size = spare.pop()
            took = min(size, room[k])
            bins[k].append((item, start + size - took, took))
            room[k] -= took
            if took < size:
                spare.append((item, start, size - took))
        if room[k]:
            break
        low += 1
    out = [own for own in bins if own and sum(p[2] for p in own) == length]
    for own in [*(b for b in bins if b and sum(p[2] for p in b) < length), spare]:
        out += _powers(own)
    return out


def _tokenize(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = ChunkEncoder.of(path)
        for batch in batches:
            docs, places, texts = (batch.column(i).to_pylist() for i in range(3))
            for a, b in _slices(texts):
                ids = [np.frombuffer(raw + end, "<u4") for raw in encoder.encode(texts[a:b])]
                wide = [bool(x.max() > 0xFFFF) for x in ids]
                raw = [x.tobytes() if w else x.astype("<u2").tobytes() for x, w in zip(ids, wide, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs[a:b], pa.int64()), pa.array(places[a:b], pa.int64()), pa.array(wide, pa.bool_()), pa.array(raw, pa.binary())], names=["doc_id", "place", "wide", "tokens"])
        encoder.rest()
        release()

    return run


def _pack(length: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        first = TaskContext.get().partitionId() << 40
        sequence = 0
        rows: list[tuple] = []
        items: list[tuple] = []  # (doc_id, ids of the rest, its start, ids in all)
        held = size = 0

        def flush_rows():
            nonlocal rows, size
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows, size = [], 0
            return out

        def place(pieces):
            nonlocal sequence, size
            offset = 0
            for doc, start, ids, total in pieces:
                raw = ids.astype("<u4").tobytes()
                rows.append((doc, start, len(ids), raw, total, first + sequence, offset))
                offset += len(ids)
                size += len(raw)
            sequence += 1

        def pack_group():
            nonlocal items, held
            for own in packed([len(x[1]) for x in items], length):
                place((items[i][0], items[i][2] + a, items[i][1][a : a + n], items[i][3]) for i, a, n in own)
                if size > 4_000_000:
                    yield flush_rows()
            items, held = [], 0

        for batch in batches:
            docs, wide, tokens = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for doc, w, raw in zip(docs, wide, tokens, strict=True):
                ids = np.frombuffer(raw, "<u4" if w else "<u2")
                whole = len(ids) - len(ids) % length
                for a in range(0, whole, length):
                    place([(doc, a, ids[a : a + length], len(ids))])
                    if size > 4_000_000:
                        yield flush_rows()
                if whole < len(ids):
                    items.append((doc, ids[whole:].copy(), whole, len(ids)))
                    held += len(ids) - whole
                if held >= GROUP_TOKENS:
                    yield from pack_group()
        yield from pack_group()
        if rows:
            yield flush_rows()
        release()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens
    (of the document, with the end id), sequence_id, offset (in the sequence)."""
    if length < 1:
        raise ValueError("a sequence has one token at least")
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), named(text).alias("text"))
    tokens = rows.mapInArrow(_tokenize(tokenizer, end_id), TOKENS).withColumn("deal", F.xxhash64("doc_id", "place", F.lit(seed)))
    dealt = tokens.repartition(parts, "deal").sortWithinPartitions("deal", "place").select("doc_id", "place", "wide", "tokens")
    return dealt.mapInArrow(_pack(length), PIECES)

