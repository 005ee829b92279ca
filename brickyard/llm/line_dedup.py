"""Line dedup: documents probe a sharded minimal perfect hash instead of joining lines.

A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased.
Keys of at least ``min_chars`` characters held by at least ``min_docs`` documents lose all
their lines, except in the document with the largest id that holds them.

1. A scan hashes each document's distinct keys to 128 bits; (bucket of documents, key) pairs
   are pre-aggregated, then counted over all buckets. A key that every document holds sends
   one row per bucket, not one per document.
2. Each bucket's distinct keys, rare ones too, become one shard: a minimal perfect hash over the first
   half of the hashes, indexing arrays of 32-bit fingerprints (of the other half), counts (one byte, those
   beyond it as the greatest) and largest ids.
3. Documents are dealt to their buckets once; a task reads a bucket's shard, then streams its
   documents past it: a line goes if its count is at least ``min_docs`` and its largest id another one.
   Shards hold only keys of their own bucket's documents, and the number of buckets follows
   spark.sql.shuffle.partitions, so a shard's size doesn't grow with the input. As a shard has every key
   it is asked for, the fingerprints only tell apart keys whose first halves are equal, which are listed
   beside the arrays with all their bits.

Defined results: a null or empty text is one empty line and becomes ''; each row counts as a
document, also if ids repeat (rows that share the largest id all keep the line); a null id is
below all others; an empty table gives an empty result; only the id and text columns are read.
"""

import io

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brickyard.llm._shared import small_batches
from brickyard.llm.perfect_hash import PerfectHash

_SPACE = " \t\n\x0b\x0c\r"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LEAST = -(2**63)
#: Counts are told apart up to this.
MOST = 255


def line_key(line: str, min_chars: int) -> bytes | None:
    """The key, or None if it is too short to count."""
    key = line.strip(_SPACE)
    return key.encode().translate(_LOWER) if len(key) >= min_chars else None


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _fingerprint(h2: np.ndarray) -> np.ndarray:
    return (h2.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return _signed(h >> 64), _signed(h & 0xFFFFFFFFFFFFFFFF)


class Shard:
    """Fingerprint, count and largest-id arrays behind a perfect hash."""

    def __init__(self, levels, fingerprint, count, top, rest):
        self.hash, self.fingerprint, self.count, self.top = PerfectHash(levels), fingerprint, count, top
        self.rest = {(int(a), int(b)): (int(n), int(t)) for a, b, n, t in rest}

    @classmethod
    def pack(cls, h1: np.ndarray, h2: np.ndarray, count: np.ndarray, top: np.ndarray) -> bytes:
        hashed, left = PerfectHash.build(h1.view(np.uint64))
        kept = np.ones(len(h1), bool)
        kept[left] = False
        index = hashed.index(h1[kept].view(np.uint64))
        arrays = {"fingerprint": np.zeros(hashed.size, np.uint32), "count": np.zeros(hashed.size, np.uint8), "top": np.zeros(hashed.size, np.int64)}
        for out, values in zip(arrays.values(), (_fingerprint(h2), np.minimum(count, MOST), top), strict=True):
            out[index] = values[kept]
        levels = {f"level{i}": x for i, x in enumerate(hashed.levels)}
        np.savez(blob := io.BytesIO(), rest=np.stack([h1[left], h2[left], count[left], top[left]], 1), **arrays, **levels)
        return blob.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> "Shard":
        with np.load(io.BytesIO(blob)) as x:
            return cls([x[f"level{i}"] for i in range(len(x.files) - 4)], x["fingerprint"], x["count"], x["top"], x["rest"])

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the number of documents that hold it (MOST: so many or more), and the largest id; 0 if it isn't in the shard."""
        count, top = np.zeros(len(h1), np.int64), np.full(len(h1), _LEAST, np.int64)
        if self.hash.size and len(h1):
            index = self.hash.index(h1.view(np.uint64))
            known = (index >= 0) & (self.fingerprint[index] == _fingerprint(h2))
            count[known], top[known] = self.count[index[known]], self.top[index[known]]
        if self.rest:
            for i, key in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                if key in self.rest:
                    count[i], top[i] = self.rest[key]
        return count, top


def _scan(min_chars: int):
    def scan(batches):
        for batch in batches:
            buckets, ids, firsts, seconds = [], [], [], []
            for bucket, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = {k for line in (text or "").split("\n") if len(line) >= min_chars and (k := line_key(line, min_chars)) is not None}
                for key in keys:
                    a, b = _hash(key)
                    firsts.append(a)
                    seconds.append(b)
                buckets += [bucket] * len(keys)
                ids += [doc] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64())], names=["bucket", "id", "h1", "h2"])

    return scan


def _pack(key, table):
    h1, h2, n, top = (table.column(c).to_numpy() for c in ("h1", "h2", "n", "top"))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([Shard.pack(h1, h2, n, top)], pa.binary())})


def _probe(min_chars: int, min_docs: int):
    def probe(batches):
        bucket, shard = None, None
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("bucket", "shard", "doc_id", "sort_id", "text")}
            out = ([], [], [], [])
            for b, blob, doc, sort_id, text in zip(*columns.values(), strict=True):
                if blob is not None:
                    bucket, shard = b, Shard.unpack(blob)
                    continue
                lines = (text or "").split("\n")
                kept = lines
                if shard is not None and b == bucket:
                    long = [i for i, line in enumerate(lines) if len(line) >= min_chars]
                    keyed = [(i, k) for i in long if (k := line_key(lines[i], min_chars)) is not None]
                    if keyed:
                        hashes = np.array([_hash(k) for _, k in keyed], np.int64)
                        count, top = shard.find(np.ascontiguousarray(hashes[:, 0]), np.ascontiguousarray(hashes[:, 1]))
                        drop = (count >= min_docs) & (top > sort_id)
                        if drop.any():
                            gone = {i for (i, _), d in zip(keyed, drop, strict=True) if d}
                            kept = [line for i, line in enumerate(lines) if i not in gone]
                out[0].append(doc)
                out[1].append(len(lines))
                out[2].append(len(lines) - len(kept))
                out[3].append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    return probe


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_lines (before), n_dropped, text (what stays).

    ``min_docs`` is 255 at most (a ValueError otherwise), as the arrays' counts are bytes.
    """
    if min_docs > MOST:
        raise ValueError(f"min_docs can be {MOST} at most")
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(4 * parts)).cast("int").alias("bucket")
    sort_id = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LEAST))
    held = docs.select(bucket, sort_id.alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_scan(min_chars), "bucket int, id long, h1 long, h2 long")
    cells = held.groupBy("bucket", "h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    whole = Window.partitionBy("h1", "h2")
    keys = cells.select("bucket", "h1", "h2", F.sum("n").over(whole).alias("n"), F.max("top").over(whole).alias("top"))
    shards = keys.groupBy("bucket").applyInArrow(_pack, "bucket int, shard binary")
    none = F.lit(None)
    left = shards.select("bucket", "shard", none.cast("long").alias("doc_id"), none.cast("long").alias("sort_id"), none.cast("string").alias("text"))
    right = docs.select(bucket, none.cast("binary").alias("shard"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"), sort_id.alias("sort_id"), F.col(f"`{text}`").alias("text"))
    both = left.unionAll(right).repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("shard").isNull())
    return both.mapInArrow(_probe(min_chars, min_docs), "doc_id long, n_lines long, n_dropped long, text string")
