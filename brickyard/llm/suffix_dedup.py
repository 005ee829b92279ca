"""Suffix-array dedup: removes bytes covered by a string of ``span`` bytes that also starts in a
document with a smaller id.

Suffixes are dealt to buckets by their anchor: of a span's 10-byte grams the one with the least
hash, so equal spans have equal anchors wherever they are. Neighbouring spans mostly share their
anchor and travel as one passage, about 70 bytes for 21 positions, packed and compressed. In a
bucket, the suffixes that start at anchors and the reversed texts before them are ordered by
deep-shallow sorting; spans are equal if they fall in one interval of both orders, and a span is
removed if its interval holds a smaller id. Passages equal to one of a smaller id in the same task
are settled there and not sent: a passage that every document shares is sent once a task.

Judged on the input: what is removed still counts as a source. Matches never cross documents.

Defined results: a null or empty text has no bytes; a null id is below all others; rows that
repeat an id are not smaller than each other, so neither is removed for the other; texts shorter
than ``span`` are kept; columns other than id and text are ignored; an empty table gives an empty
result.
"""

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm._shared import named, release, small_batches
from brickyard.llm._words import powers, spread
from brickyard.llm.deep_shallow import sort_suffixes
from brickyard.llm.perfect_hash import mix64

GRAM = 10
#: A passage has 2 * span - GRAM bytes at most, which its one-byte size must hold.
LONGEST = (255 + GRAM) // 2
CHUNK = 2_000_000
FLUSH = 16_000_000
BUCKET_BYTES = 24_000_000
_LEAST = -(2**63)
_MASK = np.uint64(0xFFFFFFFF)
#: Columns of a packed bucket, with their types: a row for each document (with its number of passages), for
#: each passage (start as the step from the one before), for each settled interval; then the passages' bytes.
_FIELDS = (("doc", "<i8"), ("print", "<i8"), ("passages", "<u4"), ("step", "<i8"), ("left", "u1"), ("size", "u1"), ("known_doc", "<i8"), ("known_print", "<i8"), ("known_start", "<i8"), ("known_end", "<i8"), ("bytes", "u1"))


_STEPPED = ("doc", "known_doc", "known_start", "known_end")


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Numbers go byte by byte of all rows, ids as steps from the one before, which leaves little to compress."""
    parts = []
    for name, kind in _FIELDS:
        column = np.ascontiguousarray(columns[name], kind)
        if name in _STEPPED:
            column = np.diff(column, prepend=column.dtype.type(0))
        parts.append(column.view(np.uint8).reshape(-1, column.itemsize).T.tobytes())
    head = struct.pack(f"<{len(parts)}q", *map(len, parts))
    return zstandard.ZstdCompressor(level=5).compress(head + b"".join(parts))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack_from(f"<{len(_FIELDS)}q", raw)
    out, at = {}, 8 * len(_FIELDS)
    for (name, kind), size in zip(_FIELDS, sizes, strict=True):
        width = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(width, -1).T).view(kind)[:, 0]
        if name in _STEPPED:
            out[name] = np.cumsum(out[name])
        at += size
    each = out["passages"]
    out["start"] = np.cumsum(out["step"])
    out["doc"], out["print"] = np.repeat(out["doc"], each), np.repeat(out["print"], each)
    # The anchor is in the bytes, so its key needn't travel.
    base = np.cumsum(out["size"].astype(np.int64)) - out["size"] + out["left"]
    head, tail = (_eights(out["bytes"])[base + at] for at in (0, GRAM - 8))
    out["key"] = _key(head, tail)
    return out


def _eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as numbers, without a copy."""
    raw = np.ascontiguousarray(raw)
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, 0, (1,))


def _rows(data: np.ndarray, at: np.ndarray, width: int, size: np.ndarray) -> np.ndarray:
    """Rows of ``width`` bytes (8 to a number) from each of these places on, zero after their size; data goes on so far after the last place."""
    step = np.arange(0, width, 8)
    kept = np.array([(1 << 8 * b) - 1 for b in range(9)], np.uint64)[np.clip(size[:, None] - step, 0, 8)]
    return (_eights(data)[at[:, None] + step] & kept).view(np.uint8)


def _key(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The hash of a gram by its first and last 8 bytes."""
    return mix64(head ^ mix64(tail, 41), 42)


def passages(raw: np.ndarray, bounds: np.ndarray, span: int) -> dict[str, np.ndarray]:
    """Runs of spans with one anchor, in texts laid end to end: key, text number, start, left, size (places in raw), sum (equal for equal bytes)."""
    none = np.zeros(0, np.int64)
    if len(raw) < span:
        return {"key": none.astype(np.uint64), "text": none, "start": none, "left": none, "size": none, "sum": none.astype(np.uint64)}
    eight = _eights(raw).copy()
    gram = _key(eight[: len(raw) - GRAM + 1], eight[GRAM - 8 : len(raw) - 7])
    ranked = (gram & ~_MASK) | np.arange(len(gram), dtype=np.uint64)
    wide, least = 1, ranked
    width = span - GRAM + 1
    while wide * 2 <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < width:
        least = np.minimum(least[: len(ranked) - width + 1], least[width - wide :])
    anchor = (least & _MASK).astype(np.int64)
    room = np.repeat(bounds[1:], np.diff(bounds))[: len(anchor)] - np.arange(len(anchor))
    valid = room >= span
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(begins)
    # A run ends before the next run or the next place that is no span.
    stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~begins[1:], False))
    text = np.searchsorted(bounds, start, "right") - 1
    size = stop - start + span
    # What a passage's bytes sum up to, each weighed by a power of its place in the passage.
    with np.errstate(over="ignore"):
        until = np.append(np.uint64(0), np.cumsum((raw + np.uint64(1)) * powers(len(raw)), dtype=np.uint64))
        weighed = (until[start + size] - until[start]) * powers(len(raw), inverse=True)[start]
    return {"key": gram[anchor[start]], "text": text, "start": start, "left": anchor[start] - start, "size": size, "sum": weighed}


def _settle(found: dict[str, np.ndarray], raw: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which passages equal one of a smaller id among them (two that agree in their sums are compared byte by byte)."""
    out = np.zeros(len(found["start"]), bool)
    if not len(out):
        return out
    ids, sums = docs[found["text"]], found["sum"]
    order = np.lexsort((ids, sums))
    heads = np.flatnonzero(np.append(True, sums[order][1:] != sums[order][:-1]))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
    # A passage's bytes decide its anchor and so its key, but for spans it doesn't hold itself.
    same = (ids[least] < ids) & (found["size"][least] == found["size"]) & (found["left"][least] == found["left"])
    at = np.flatnonzero(same)
    for some in np.array_split(at, len(at) // 50_000 + 1):
        if len(some):
            size = found["size"][some]
            differ = raw[spread(found["start"][some], size)] != raw[spread(found["start"][least[some]], size)]
            out[some] = np.add.reduceat(differ.astype(np.int64), np.cumsum(size) - size) == 0
    return out


def _scan(span: int, buckets: int):
    kind = {"bucket": pa.int32(), "blob": pa.binary()}

    def flush(held: list[tuple[int, int, bytes]]):
        raw = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        docs, prints = np.array([d for d, _, _ in held], np.int64), np.array([p for _, p, _ in held], np.int64)
        bounds = np.concatenate([[0], np.cumsum([len(t) for _, _, t in held])])
        parts, at = [], 0
        while at < len(held):  # texts are taken a few at a time, a long one alone
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, "right")) - 1)
            some = passages(raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], span)
            some["text"] = some["text"] + at
            some["start"] = some["start"] + bounds[at]
            parts.append(some)
            at = to
        found = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
        settled = _settle(found, raw, docs)
        home = (found["key"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(buckets + 1))
        for bucket in np.unique(home).tolist():
            rows = order[cuts[bucket] : cuts[bucket + 1]]
            sent, known = rows[~settled[rows]], rows[settled[rows]]
            t, each = np.unique(found["text"][sent], return_counts=True)
            # Settled intervals of one text that touch become one; texts are set one apart.
            gap = found["text"][known]
            s, e = merge(found["start"][known] + gap, found["start"][known] + found["size"][known] + gap)
            k = np.searchsorted(bounds + np.arange(len(bounds)), s, "right") - 1
            s, e = s - k - bounds[k], e - k - bounds[k]
            here = found["start"][sent] - bounds[found["text"][sent]]
            yield bucket, pack(
                {
                    "doc": docs[t], "print": prints[t], "passages": each, "step": np.diff(here, prepend=0), "left": found["left"][sent], "size": found["size"][sent],
                    "known_doc": docs[k], "known_print": prints[k], "known_start": s, "known_end": e,
                    "bytes": raw[spread(found["start"][sent], found["size"][sent])],
                }
            )

    def run(batches):
        held, size = [], 0

        def close():
            rows = list(flush(held))
            held.clear()
            release()
            for at in range(0, len(rows), 64):
                b, x = zip(*rows[at : at + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, kind["bucket"]), pa.array(x, kind["blob"])], names=list(kind))

        for batch in batches:
            for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                coded = (text or "").encode()
                if len(coded) >= span:
                    held.append((doc, mark, coded))
                    size += len(coded)
                    if size >= FLUSH:
                        yield from close()
                        size = 0
        if held:
            yield from close()

    return run


def _among(some: np.ndarray, order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of some of the suffixes, numbered among these, and their common lengths: the least on the way from one to the next."""
    at = np.flatnonzero(some[order])
    if not len(at):
        return at, at
    number = np.cumsum(some) - 1
    common = np.minimum.reduceat(lcp, np.append(0, at[:-1] + 1))
    common[-1] = lcp[(at[-2] if len(at) > 1 else -1) + 1 : at[-1] + 1].min()
    return number[order[at]], common


def removed_spans(rows: dict[str, np.ndarray], span: int) -> np.ndarray:
    """(row, start) of each span of the passages that a smaller id has too; start counts from the passage's start."""
    key = rows["key"]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(key)))
    low, high = (f.reduceat(rows["doc"][order], first) if len(first) else first for f in (np.minimum, np.maximum))
    use = order[np.repeat(low < high, sizes)]
    if not len(use):
        return np.zeros((0, 2), np.int64)
    group = np.repeat(np.arange(len(first)), sizes)[np.repeat(low < high, sizes)]
    left, size, doc = (rows[n][use].astype(np.int64) for n in ("left", "size", "doc"))
    base = (np.cumsum(rows["size"].astype(np.int64)) - rows["size"])[use] + left
    right = size - left
    pad = np.zeros(LONGEST + 8, np.uint8)
    data = np.concatenate([rows["bytes"], pad])
    after = _rows(data, base, span + (-span) % 8, np.minimum(right, span))
    before = _rows(np.concatenate([rows["bytes"][::-1], pad]), len(rows["bytes"]) - base, span - GRAM + (GRAM - span) % 8, left)
    by_right, lcp_right = sort_suffixes(group, after, np.minimum(right, span))
    by_left, lcp_left = sort_suffixes(group, before, left)
    # The best common length on either side bounds what a passage can share; most that meet by chance fall here.
    reach = np.zeros(len(use), np.int64)
    for by, lcp in ((by_right, lcp_right), (by_left, lcp_left)):
        reach[by] += np.maximum(lcp, np.append(lcp[1:], 0))
    hopeful = reach >= span
    n = int(hopeful.sum())
    by_right, lcp_right = _among(hopeful, by_right, lcp_right)
    by_left, lcp_left = _among(hopeful, by_left, lcp_left)
    use, group, doc, left, right = (x[hopeful] for x in (use, group, doc, left, right))
    start_of_group = {"r": np.append(True, group[by_right][1:] != group[by_right][:-1])[:n], "l": np.append(True, group[by_left][1:] != group[by_left][:-1])[:n]}
    out = []
    for offset in range(span - GRAM + 1):
        fits = (left >= offset) & (right >= span - offset)
        at = np.flatnonzero(fits)
        if len(at) < 2:
            continue
        r, l = np.empty(n, np.int64), np.empty(n, np.int64)
        r[by_right] = np.cumsum(start_of_group["r"] | (lcp_right < span - offset))
        l[by_left] = np.cumsum(start_of_group["l"] | (lcp_left < offset))
        both = r[at] * (n + 1) + l[at]
        o = np.argsort(both, kind="stable")
        heads = np.flatnonzero(np.append(True, both[o][1:] != both[o][:-1]))
        least = np.repeat(np.minimum.reduceat(doc[at][o], heads), np.diff(np.append(heads, len(o))))
        gone = at[o][doc[at][o] > least]
        out.append(np.stack([use[gone], left[gone] - offset], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(new[1:], True)]


def _judge(span: int):
    def run(table):
        columns = [unpack(b) for b in table.column("blob").to_pylist()]
        rows = {n: np.concatenate([c[n] for c in columns]) for n in columns[0]}
        gone = removed_spans(rows, span)
        start = rows["start"][gone[:, 0]] + gone[:, 1]
        doc = np.concatenate([rows["doc"][gone[:, 0]], rows["known_doc"]])
        mark = np.concatenate([rows["print"][gone[:, 0]], rows["known_print"]])
        start, end = np.concatenate([start, rows["known_start"]]), np.concatenate([start + span, rows["known_end"]])
        order = np.lexsort((start, mark, doc))
        doc, mark, start, end = doc[order], mark[order], start[order], end[order]
        # Intervals of one text that touch become one: a text's own maximum must not reach into the next.
        new_text = np.append(True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])) if len(doc) else np.zeros(0, bool)
        shift = (np.cumsum(new_text) - 1) * (int(end.max(initial=0)) + 2)
        s, e = merge(start + shift, end + shift)
        release()
        at = np.searchsorted(start + shift, s)
        return pa.table({"doc": pa.array(doc[at], pa.int64()), "print": pa.array(mark[at], pa.int64()), "start": pa.array(s - shift[at], pa.int64()), "end": pa.array(e - shift[at], pa.int64())})

    return run


def _shrink(batches):
    """Texts compressed for their way to their spans."""
    zstd = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [zstd.compress((t or "").encode()) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["doc_id", "sort_id", "print", "packed"])


def _cut(batches):
    zstd = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            coded = zstd.decompress(packed)
            if not spans:
                out.append((len(coded), 0, 0, coded))
                continue
            start, end = merge(np.array([x["start"] for x in spans], np.int64), np.array([x["end"] for x in spans], np.int64))
            cuts = zip([0, *end.tolist()], [*start.tolist(), len(coded)], strict=True)
            out.append((len(coded), int((end - start).sum()), len(start), b"".join(coded[a:b] for a, b in cuts)))
        a, b, c, d = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    ``span`` is 10 to 132 bytes (a ValueError otherwise): shorter ones have no anchors, and longer ones don't fit what is
    sent of an anchor's surroundings.
    """
    if not GRAM <= span <= LONGEST:
        raise ValueError(f"span must be {GRAM} to {LONGEST} bytes")
    small_batches(docs.sparkSession)
    d = docs.select(named(doc_id).cast("long").alias("doc_id"), F.coalesce(named(doc_id).cast("long"), F.lit(_LEAST)).alias("sort_id"), F.xxhash64(named(text)).alias("print"), named(text).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, 4 * size // BUCKET_BYTES)
    sent = d.select("sort_id", "print", "text").mapInArrow(_scan(span, buckets), "bucket int, blob binary")
    spans = sent.groupBy("bucket").applyInArrow(_judge(span), "doc long, print long, start long, end long")
    of = spans.groupBy("doc", F.col("print").alias("mark")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = d.select("doc_id", "sort_id", "print", "text").mapInArrow(_shrink, "doc_id long, sort_id long, print long, packed binary")
    rows = texts.join(of, (F.col("sort_id") == F.col("doc")) & (F.col("print") == F.col("mark")), "left").select("doc_id", "packed", "spans")
    return rows.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
