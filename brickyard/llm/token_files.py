"""Token-id output: documents to coded blocks of ids in ascending id order, and back.

Texts are cut at ASCII white space, where the tokenizer always separates tokens, and each
distinct chunk is encoded once per slice of texts, its word and marks once per worker (a cache of bounded size). Documents are dealt to
shards by ranges of doc_id; a task streams its shard's documents in order, appends the end id
to each and closes a block at ``block_tokens`` ids. A block is one row of a Parquet table in
the shared folder, (shard, block, tokens_before, doc_ids, doc_tokens, payload), where the
payload is a self-contained, checksummed block of ``token_codec``. Task output is committed by
Spark's writer, so a lost executor only repeats its tasks, and any store Spark reads will do.

Reading decodes blocks independently. Only one number a shard (its ids in total) is gathered to
turn offsets in shards into offsets in the whole output.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; rows
that repeat an id are ordered by text; an empty table gives an empty result. A document is
never split over blocks. Columns other than id and text are ignored.
"""

import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickyard.llm._shared import named, new_path, release, small_batches
from brickyard.llm._words import spread
from brickyard.llm.token_codec import decode_block, encode_block

CACHED_CHUNKS = 400_000
#: Chunks that stay for a worker's next task; the first ones met are the frequent ones.
KEPT_CHUNKS = 150_000
# How the tokenizer whose plain words can go straight to its model normalises and cuts text.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # not the apostrophe, which a letter may follow
# Letters below U+0250 but U+0130, whose small form is two characters.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLOCK_TOKENS = 1 << 20
BLOCKS = "shard int, block int, tokens_before long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"
_encoders: dict[str, "ChunkEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The character that a byte-level model has for each byte: visible Latin-1 characters stand for themselves, the
    others follow from 256 on, in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = sorted(set(range(256)) - set(seen))
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(other)}


def _cut(sizes: list[int], ids: list[int]) -> list[bytes]:
    """Ids laid end to end, cut into so many each."""
    raw = np.array(ids, "<u4").tobytes()
    ends = [4 * e for e in itertools.accumulate(sizes)]
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class ChunkEncoder:
    """Ids of texts, by way of a cache of white-space separated chunks' units: plain words, the marks after them, chunks that are neither."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Two generations: units of the last one that come again move to the new one, so frequent units stay.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        normal = [x.get("type") for x in (shape.get("normalizer") or {}).get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") for x in (shape.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: Whether a word of Latin letters is one unit to the model, and the marks after it another.
        self.plain = normal == _NORMAL and cuts == [_CUT, None]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words in small letters, which go to the model by themselves."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        sizes, ids = [], []
        for w in words:
            found = tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(letters))
            sizes.append(len(found))
            ids += [t.id for t in found]
        return _cut(sizes, ids)

    def _texts(self, texts: list[str]) -> list[bytes]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return _cut(list(map(len, found)), list(itertools.chain.from_iterable(found)))

    def _known(self, units: list[str], encode) -> list[bytes]:
        """Ids of distinct units: from the cache, else by encode."""
        found = list(map(self.cache.get, units))
        new = [k for k, ids in enumerate(found) if ids is None]
        if len(self.cache) + len(new) > CACHED_CHUNKS:
            self.older, self.cache = self.cache, {}
            new = list(range(len(units)))
        names = [units[k] for k in new]
        ids = list(map(self.older.get, names))
        lost = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(lost, encode([names[k] for k in lost]), strict=True):
            ids[k] = x
        for k, x in zip(new, ids, strict=True):
            found[k] = x
        self.cache.update(zip(names, ids, strict=True))
        return found

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, laid end to end, and how many each has.

        Words of letters below U+0250, which lower-casing keeps one by one and composition leaves alone, are parted from the
        marks after them: far fewer are distinct.
        """
        bare = pc.ascii_rtrim(chunks, characters=_MARKS)
        plain = pc.match_substring_regex(bare, _PLAIN) if self.plain else pa.array(np.zeros(len(chunks), bool))
        words, rest = pc.utf8_lower(bare.filter(plain)).dictionary_encode(), chunks.filter(pc.invert(plain))
        ends, raw = np.frombuffer(chunks.buffers()[1], np.int64)[1 : len(chunks) + 1], np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        is_plain = plain.to_numpy(zero_copy_only=False)
        marks = np.where(is_plain, pc.binary_length(chunks).to_numpy() - pc.binary_length(bare).to_numpy(), 0)
        marked = np.flatnonzero(marks)
        bounds = np.append(0, np.cumsum(marks[marked]))
        tails = pa.LargeStringArray.from_buffers(len(marked), pa.py_buffer(bounds), pa.py_buffer(raw[spread(ends[marked] - marks[marked], marks[marked])])).dictionary_encode()
        # Unit 0 has no ids: it follows chunks that are one unit.
        units = [b""]
        first, second = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        for place, at, texts, encode in (
            (first, np.flatnonzero(is_plain), words, self._words),
            (second, marked, tails, self._texts),
            (first, np.flatnonzero(~is_plain), rest.dictionary_encode(), self._texts),
        ):
            place[at] = len(units) + texts.indices.to_numpy()
            units += self._known(texts.dictionary.to_numpy(zero_copy_only=False).tolist(), encode)
        sizes = np.array(list(map(len, units)), np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        both = np.stack([first, second], 1).reshape(-1)
        ids = np.frombuffer(b"".join(units), "<u4")[spread(starts[both], sizes[both])]
        return ids, sizes[first] + sizes[second]

    @classmethod
    def of(cls, path: str) -> "ChunkEncoder":
        """This worker's encoder; its frequent chunks live as long as the worker."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        parts = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        chunks = parts.values.dictionary_encode()
        ids, sizes = self._of_chunks(chunks.dictionary)
        at = chunks.indices.to_numpy()
        sizes, starts = sizes[at], (np.cumsum(sizes) - sizes)[at]
        raw = ids[spread(starts, sizes)].tobytes()
        ends = 4 * np.append(0, np.cumsum(sizes))[parts.offsets.to_numpy()]
        return [raw[a:b] for a, b in itertools.pairwise(ends.tolist())]

    def rest(self) -> None:
        """Lets go of all but a few chunks: an idle worker isn't to hold memory that other operators need."""
        kept = itertools.chain(self.older.items(), self.cache.items())
        self.cache, self.older = dict(itertools.islice(kept, KEPT_CHUNKS)), {}


def _slices(texts: list[str | None], most: int = 4_000_000):
    """Ranges of rows of about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encode_shard(path: str, end_id: int, block_tokens: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, parts, size = [], [], [], 0

        def close():
            nonlocal block, before, ids, counts, parts, size
            row = {"shard": shard, "block": block, "tokens_before": before, "n_tokens": size, "doc_ids": ids, "doc_tokens": counts, "payload": encode_block(np.frombuffer(b"".join(parts), "<u4"))}
            block, before = block + 1, before + size
            ids, counts, parts, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("tokens_before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])
        encoder = ChunkEncoder.of(path)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts, 8_000_000):
                for doc, coded in zip(docs[a:b], encoder.encode(texts[a:b]), strict=True):
                    ids.append(doc)
                    counts.append(len(coded) // 4 + 1)
                    parts += (coded, end)
                    size += counts[-1]
                    if size >= block_tokens:
                        yield close()
        if ids:
            yield close()
        encoder.rest()
        release()

    return run


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes the token files of docs to the folder ``to``."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"))
    dealt = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_encode_shard(tokenizer, end_id, block_tokens), BLOCKS).write.option("compression", "none").parquet(to)


def _decode(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_block(row["payload"]).astype("<u4")
            ends = np.cumsum(np.array(row["doc_tokens"], np.int64))
            starts = ends - row["doc_tokens"]
            raw = memoryview(ids.tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["tokens_before"], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(crcs, pa.int64())],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_digests(spark: SparkSession, where: str) -> DataFrame:
    """One row per document of token files, from decoded ids: doc_id, start, n_tokens, ids_crc32."""
    blocks = spark.read.parquet(where)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("shard")
    offsets = totals.select(F.col("shard").alias("of_shard"), (F.sum("total").over(order) - F.col("total")).alias("offset"))
    rows = blocks.select("shard", "block", "tokens_before", "doc_ids", "doc_tokens", "payload").mapInArrow(_decode, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, F.col("shard") == F.col("of_shard")).select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _decode_ids(batches):
    kind = pa.list_(pa.int64())
    for batch in batches:
        for row in batch.select(["doc_ids", "doc_tokens", "payload"]).to_pylist():
            ids = decode_block(row["payload"]).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.array(row["doc_tokens"], np.int64))])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)).cast(kind)], names=["doc_id", "ids"])


def read_ids(spark: SparkSession, where: str) -> DataFrame:
    """One row per document of token files: doc_id, ids (with the end id)."""
    return spark.read.parquet(where).select("doc_ids", "doc_tokens", "payload").mapInArrow(_decode_ids, "doc_id long, ids array<long>")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes token files to the shared folder and reads them back."""
    where = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, where, tokenizer, end_id)
    return read_digests(docs.sparkSession, where)
