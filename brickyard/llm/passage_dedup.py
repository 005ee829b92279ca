"""Near-duplicate passages by compact windows.

Tokens are five-word shingles. For each of a few hash functions the Cartesian tree of a text's
token hashes gives its compact windows (l, c, r): every passage within l..r that includes c has its
min-hash at c. Only windows that can hold a passage of ``min_words`` words count. Windows whose min-hash
several texts have are laid over each other, ``enough`` hash functions at a time: each combination of
min-hashes is a key, and the places of a text that have them all are the members of its group.

Each member is held against the group's first one (those of its text against the last one). There the
texts' common tokens are followed and passages verified: at least ``min_words`` words in both and a
Jaccard similarity of num/den or more. Where a place has no passage in common with the first text, all
texts that were held against that one are held against each other, until each place has a passage and its
text is in their class or all that share enough tokens are tried.

Equal texts are one text throughout; their documents are counted natively, so a group of copies of
any size costs no more than one text. Texts that many others are verified against are dealt out again
by a salt that grows with their number.

Defined results: texts of fewer than ``min_words`` words (also null and empty ones) have no passages
and are a class of their own; equal texts of enough words repeat as a whole; a null id counts as a
document and gets component null; rows that repeat an id count as two documents; an empty table gives
an empty result; columns other than id and text are ignored.
"""

import itertools
import struct
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickyard.llm._components import components
from brickyard.llm._shared import checkpointed, named, release, small_batches
from brickyard.llm._words import shingle_hashes, signed, spread, word_hashes, word_hashes_of
from brickyard.llm.perfect_hash import mix64

SHINGLE = 5
BUCKET_WINDOWS = 400_000
FLUSH_WINDOWS = 300_000
#: Characters of texts that are hashed at a time.
SCANNED_CHARS = 60_000
#: Pairs of windows that are tried at a time: a repetitive text's windows may stand within each other by the thousand.
TRIED = 500_000
SALT = 1000
_FIELDS = (("key", "<u8"), ("text", "<i8"), ("l", "<u4"), ("c", "<u4"), ("r", "<u4"), ("f", "u1"))
_MEMBER = "key long, text long, l int, r int"


def _slid(least_or_most: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """np.minimum or np.maximum of each ``size`` neighbours."""
    done = 1
    while done < size:
        step = min(done, size - done)
        x = least_or_most(x[:-step], x[step:])
        done += step
    return x


def _bounds(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the nearest value before each one is that isn't greater, and behind it that is less, among begin..end - 1; begin - 1 and end, if none is."""
    n, longest = len(values), int((end - begin).max(initial=0))
    lowest = [values]  # of 1, 2, 4, ... neighbours
    while 2 << len(lowest) - 1 <= longest:
        half = 1 << len(lowest) - 1
        lowest.append(np.minimum(lowest[-1][:-half], lowest[-1][half:]))
    before, behind = np.arange(n), np.arange(1, n + 1)
    for k in reversed(range(len(lowest))):
        step, last = 1 << k, len(lowest[k]) - 1
        to = before - step
        before -= step * ((to >= begin) & (lowest[k][np.maximum(to, 0)] > values))
        behind += step * ((behind + step <= end) & (lowest[k][np.minimum(behind, last)] >= values))
    return before - 1, behind


def windows_of(values: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, l, c, r) of the compact windows of texts of ``sizes``, each ``least`` or more, whose values lie end to end.

    These are the nodes of the texts' Cartesian trees that span at least so many values; leftmost minimum first. Each is the least of some
    ``least`` neighbours, as are the values that bound it, so the trees are made of such values only.
    """
    ends = np.cumsum(sizes)
    lowest = _slid(np.minimum, values, least)
    low = values.min()
    lowest[spread(ends[:-1] - least + 1, np.full(len(ends) - 1, least - 1))] = low  # neighbours of two texts
    beside = np.full(least - 1, low)
    kept = np.flatnonzero(values == _slid(np.maximum, np.concatenate([beside, lowest, beside]), least))
    at = np.searchsorted(kept, ends)
    text = np.repeat(np.arange(len(ends)), np.diff(at, prepend=0))
    begin, end = np.append(0, at)[text], at[text]
    l, r = _bounds(values[kept], begin, end)
    l, r = np.where(l < begin, (ends - sizes)[text], kept[l] + 1), np.where(r == end, ends[text], kept[np.minimum(r, len(kept) - 1)]) - 1
    use = np.flatnonzero(r - l + 1 >= least)
    text = text[use]
    base = (ends - sizes)[text]
    return text, l[use] - base, kept[use] - base, r[use] - base


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) of one text's compact windows."""
    if len(values) < least:
        return []
    return list(zip(*(v.tolist() for v in windows_of(values, np.array([len(values)]), least)[1:]), strict=True))


def _pack(columns: list[np.ndarray]) -> bytes:
    parts = [np.ascontiguousarray(c, t).tobytes() for c, (_, t) in zip(columns, _FIELDS, strict=True)]
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(columns[0])) + b"".join(parts))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    out, at = {}, 8
    for name, kind in _FIELDS:
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def _scan(hashes: int, min_words: int, buckets: int):
    least = min_words - SHINGLE + 1

    def run(batches):
        held, size, seen = [], 0, set()

        def close():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            for f in range(hashes):
                own = columns[5] == f
                columns[0][own] = mix64(columns[0][own], 200 + f)
            home = (columns[0] % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)  # short numbers are sorted faster
            order = np.argsort(home, kind="stable")
            home, columns = home[order], [c[order] for c in columns]
            cuts = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
            rows = [(int(home[a]), _pack([c[a:b] for c in columns])) for a, b in itertools.pairwise([*cuts.tolist(), len(home)])]
            b, x = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "blob"])

        def add(marks, texts):
            nonlocal size
            words, bounds = word_hashes_of(texts)
            if len(words) < SHINGLE:
                return
            sizes = np.diff(bounds) - SHINGLE + 1
            long = np.flatnonzero(sizes >= least)
            if not len(long):
                return
            sizes = sizes[long]
            tokens = shingle_hashes(words, SHINGLE)[spread(bounds[long], sizes)]
            marks = np.array(marks, np.int64)[long]
            values = np.concatenate([mix64(tokens, 100 + f) for f in range(hashes)])
            text, l, c, r = windows_of(values, np.tile(sizes, hashes), least)
            f, one = np.divmod(text, len(long))
            starts = np.cumsum(np.tile(sizes, hashes)) - np.tile(sizes, hashes)
            held.append([x.astype(t) for x, (_, t) in zip((values[c + starts[text]], marks[one], l, c, r, f), _FIELDS, strict=True)])
            size += len(l)

        for batch in batches:
            marks, texts, chars = [], [], 0
            for mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if mark in seen or not text:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(mark)
                marks.append(mark)
                texts.append(text)
                chars += len(text)
                if chars >= SCANNED_CHARS:
                    add(marks, texts)
                    marks, texts, chars = [], [], 0
            add(marks, texts)
            if size >= FLUSH_WINDOWS:
                yield close()
                size = 0
        if held:
            yield close()
        release()

    return run


def _shared(table):
    """The windows whose min-hash more than one text has, each once: tasks that met copies of a text all sent its windows."""
    columns = [_unpack(b) for b in table.column("blob").to_pylist()]
    x = {n: np.concatenate([c[n] for c in columns]) for n, _ in _FIELDS}
    order = np.lexsort((x["c"], x["f"], x["text"], x["key"]))
    x = {n: v[order] for n, v in x.items()}
    once = np.zeros(len(order), bool)
    once[:1] = True
    for n in ("key", "text", "f", "c"):  # a hash function has one window at a place
        once[1:] |= x[n][1:] != x[n][:-1]
    x = {n: v[once] for n, v in x.items()}
    starts = np.flatnonzero(np.append(True, x["key"][1:] != x["key"][:-1]))
    ends = np.append(starts[1:], len(x["key"]))
    several = np.repeat(x["text"][starts] != x["text"][ends - 1], ends - starts)
    kinds = (("key", np.int64), ("text", np.int64), ("l", np.int32), ("c", np.int32), ("r", np.int32), ("f", np.int32))
    return pa.table({n: pa.array((x[n][several].view(k) if n == "key" else x[n][several].astype(k))) for n, k in kinds})


def overlaid(one: dict[str, np.ndarray], two: dict[str, np.ndarray], least: int) -> dict[str, np.ndarray]:
    """Where windows of two hashes hold the same passages: (key, l, r, lo, hi), with all min-hashes at lo..hi."""
    order = np.argsort(two["c"], kind="stable")
    two = {n: v[order] for n, v in two.items()}
    begin = np.searchsorted(two["c"], one["l"], "left")
    n = np.maximum(np.searchsorted(two["c"], one["r"], "right") - begin, 0)
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // TRIED, prepend=0)).tolist()
    found = [_laid(one, two, begin, n, slice(*at), least) for at in itertools.pairwise([0, *cuts, len(n)])]
    return {name: np.concatenate([x[name] for x in found]) for name in found[0]}


def _laid(one: dict[str, np.ndarray], two: dict[str, np.ndarray], begin: np.ndarray, n: np.ndarray, at: slice, least: int) -> dict[str, np.ndarray]:
    """Of the windows ``at`` of one, each with so many of two from ``begin`` on, those that hold the same passages."""
    one, begin, n = {name: v[at] for name, v in one.items()}, begin[at], n[at]
    i = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + begin[i]
    l, r = np.maximum(one["l"][i], two["l"][j]), np.minimum(one["r"][i], two["r"][j])
    lo, hi = np.minimum(one["lo"][i], two["c"][j]), np.maximum(one["hi"][i], two["c"][j])
    use = np.flatnonzero((l <= lo) & (hi <= r) & (r - l + 1 >= least))
    return _both(one, two, i[use], j[use], l[use], r[use])


def _nested(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ranges begin..end, each two nested or apart: the next one around each; places, and the innermost range up to the first and from each on; -1 is none."""
    n = len(begin)
    places = np.concatenate([begin, end + 1])
    order = np.argsort(2 * places + (np.arange(2 * n) < n), kind="stable")  # ranges end before others begin
    around, inner, stack = [-1] * n, [-1], [-1]
    for e in order.tolist():
        if e < n:
            around[e] = stack[-1]
            stack.append(e)
        else:
            stack.pop()
        inner.append(stack[-1])
    return np.array(around, np.int64), places[order], np.array(inner, np.int64)


def nests(two: dict[str, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """How a hash's windows lie in each other, seen from the places behind their min-hashes and from those before them."""
    return _nested(two["c"], two["r"]), _nested(-two["c"], -two["l"])


def _holding(one: dict[str, np.ndarray], two: dict[str, np.ndarray], nested: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Windows of one hash and of another that hold each other's min-hash; no other pair is tried, save one a window.

    Windows of two around a place, with min-hashes on one side of it, lie in each other, that with the nearest min-hash innermost: they
    are followed outwards until a min-hash is out of the first window.
    """
    found = []
    for (around, places, inner), side in zip(nested, (1, -1), strict=True):
        i, j = np.arange(len(one["c"])), inner[np.searchsorted(places, side * one["c"], "right")]
        if side < 0:  # a min-hash in the same place was met from the other side
            same = np.flatnonzero(j >= 0)
            same = same[two["c"][j[same]] == one["c"][same]]
            j[same] = around[j[same]]
        while len(i):
            on = np.flatnonzero(j >= 0)
            i, j = i[on], j[on]
            on = np.flatnonzero((two["c"][j] >= one["l"][i]) & (two["c"][j] <= one["r"][i]))
            i, j = i[on], j[on]
            found.append((i, j))
            j = around[j]
    i, j = zip(*found, strict=True) if found else ([np.zeros(0, np.int64)],) * 2
    return np.concatenate(i), np.concatenate(j)


def paired(one: dict[str, np.ndarray], two: dict[str, np.ndarray], nested: tuple, least: int) -> dict[str, np.ndarray]:
    """What ``overlaid`` gives for the windows of one hash and of another, with the ``nests`` of the latter."""
    i, j = _holding(one, two, nested)
    l, r = np.maximum(one["l"][i], two["l"][j]), np.minimum(one["r"][i], two["r"][j])
    use = np.flatnonzero(r - l + 1 >= least)
    return _both(one, two, i[use], j[use], l[use], r[use])


def _both(one: dict[str, np.ndarray], two: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, l: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    with np.errstate(over="ignore"):
        key = mix64(one["key"][i] + mix64(two["key"][j], 301), 302)
    return {"key": key, "l": l, "r": r, "lo": np.minimum(one["lo"][i], two["c"][j]), "hi": np.maximum(one["hi"][i], two["c"][j])}


def _meets(hashes: int, enough: int, least: int):
    """Keys of ``enough`` min-hashes, each combination of hash functions, with the places of a text that have them all."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            x = {n: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, n in enumerate(("f", "key", "l", "c", "r"))}
            # All texts are laid out one after the other, so one overlay serves them all.
            marks = batch.column(0).to_numpy()
            of_row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            tops = np.zeros(len(ends), np.int64)
            np.maximum.at(tops, of_row, x["r"] + 1)
            bases = np.cumsum(tops) - tops
            for n in ("l", "c", "r"):
                x[n] += bases[of_row]
            of = [{n: x[n][x["f"] == f] for n in ("key", "l", "c", "r")} for f in range(hashes)]
            for o in of:
                o["key"] = o["key"].view(np.uint64)
                o["lo"] = o["hi"] = o["c"]
            nested = [nests(o) for o in of]
            for k, chosen in enumerate(itertools.combinations(range(hashes), enough)):
                now = of[chosen[0]]
                for n, f in enumerate(chosen[1:]):
                    now = overlaid(now, of[f], least) if n else paired(now, of[f], nested[f], least)
                text = np.searchsorted(bases, now["l"], "right") - 1
                key, l, r = mix64(now["key"], 400 + k).view(np.int64), (now["l"] - bases[text]).astype(np.int32), (now["r"] - bases[text]).astype(np.int32)
                for at in range(0, len(text), 50_000):
                    one = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(c[one]) for c in (key, marks[text], l, r)], names=["key", "text", "l", "r"])
        release()

    return run


def _links(table):
    """Places (l, r) of a and (m, s) of b that are to be compared: each member of a group with its first one, those of the first one's text with its last."""
    x = {n: table.column(n).to_numpy() for n in ("key", "text", "l", "r")}
    order = np.lexsort((x["l"], x["text"], x["key"]))
    x = {n: v[order] for n, v in x.items()}
    starts = np.flatnonzero(np.append(True, x["key"][1:] != x["key"][:-1]))
    ends = np.append(starts[1:], len(order))
    first, last = np.repeat(starts, ends - starts), np.repeat(ends - 1, ends - starts)
    at = np.arange(len(order))
    own = x["text"] == x["text"][first]
    use = x["text"][first] != x["text"][last]
    i, j = np.where(own, last, at)[use], np.where(own, at, first)[use]
    a, b, l, r, m, s = x["text"][i], x["text"][j], x["l"][i], x["r"][i], x["l"][j], x["r"][j]
    # A place inside another one of the same texts adds nothing.
    order = np.lexsort((-r, l, b, a))
    a, b, l, r, m, s = (v[order] for v in (a, b, l, r, m, s))
    if len(a):
        pair = np.cumsum(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        reach = pair.astype(np.int64) * (1 << 32) + r
        top = np.maximum.accumulate(reach)
        widest = np.maximum.accumulate(np.where(np.append(True, top[1:] > top[:-1]), np.arange(len(a)), 0))
        keep = (widest == np.arange(len(a))) | (m < m[widest]) | (s > s[widest])
        a, b, l, r, m, s = (v[keep] for v in (a, b, l, r, m, s))
    return pa.table({n: pa.array(v) for n, v in zip(("a", "b", "l", "r", "m", "s"), (a, b, l, r, m, s), strict=True)})


def joined_places(places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Places (l, r, m, s) of two texts; those that overlap in both are one."""
    done, open_ = [], []
    for l, r, m, s in sorted(places):
        still = []
        for o in open_:
            if o[1] < l:
                done.append(o)
            elif o[2] <= s and m <= o[3]:
                l, r, m, s = min(l, o[0]), max(r, o[1]), min(m, o[2]), max(s, o[3])
            else:
                still.append(o)
        open_ = [*still, (l, r, m, s)]
    return done + open_


def _places(batches):
    for batch in batches:
        rows = []
        lists = batch.column(2)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
        found = list(zip(*(c.to_pylist() for c in lists.flatten().flatten()), strict=True))
        for a, b, start, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), [0, *ends], ends, strict=False):
            rows += [(a, b, *p) for p in joined_places(found[start:end])]
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "l", "r", "m", "s"])


def _nearest(places: list[int], lo: int, hi: int, want: int, after: int) -> int:
    """Of the ascending places lo..hi - 1 the nearest to want, the lesser of two, among those behind ``after`` or, if none is, among all; want is behind ``after``."""
    k = bisect_left(places, want, lo, hi)
    if k == hi:
        return places[k - 1]
    if k > lo and places[k - 1] > after and want - places[k - 1] <= places[k] - want:
        return places[k - 1]
    return places[k]


def _chain(ours: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shared tokens of ours with one place each in theirs: the place that goes on from its neighbours', else the nearest after the last."""
    order = np.argsort(theirs, kind="stable")
    values = theirs[order]
    begin = np.searchsorted(values, ours)
    at_i = np.flatnonzero(values[np.minimum(begin, len(values) - 1)] == ours)
    begin = begin[at_i]
    at_j = order[begin]
    if (values[1:] != values[:-1]).all():
        return at_i, at_j
    end = np.searchsorted(values, ours[at_i], "right")
    several = np.flatnonzero(end - begin > 1).tolist()
    places, begin, end, i, j = order.tolist(), begin.tolist(), end.tolist(), at_i.tolist(), at_j.tolist()
    for k in several:
        last = (i[k - 1], j[k - 1]) if k else (-1, -1)
        j[k] = _nearest(places, begin[k], end[k], last[1] + i[k] - last[0], last[1])
    for k in reversed(several):  # where a run begins, its first tokens may have been put elsewhere
        if k + 1 < len(i):
            want = j[k + 1] - i[k + 1] + i[k]
            goes_on = k and j[k] - j[k - 1] == i[k] - i[k - 1]
            if j[k] != want and not goes_on and 0 <= want and theirs[want] == ours[i[k]]:
                j[k] = want
    return at_i, np.array(j, np.int64)


def _next(tokens: np.ndarray) -> np.ndarray:
    """Where each token stands next, or beyond the end."""
    order = np.argsort(tokens, kind="stable")
    again = np.flatnonzero(tokens[order[1:]] == tokens[order[:-1]])
    out = np.full(len(tokens), len(tokens))
    out[order[again]] = order[again + 1]
    return out


def _widest(i0: np.ndarray, j0: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of shared tokens, at i0 of x and j0 of y, where tokens stand more than once: the furthest similar enough from each
    first one on that goes beyond those before.

    A range's weight is its distinct shared tokens less the unshared ones. Without the first shared token it changes by the tokens
    that are left out, for all ranges alike, or only for those that end before such a token's next place.
    """
    k = len(i0)
    weight, every = np.zeros(k, np.int64), np.zeros(k + 1, np.int64)
    steps, ends, by = [], [], []
    for tokens, at, one in ((x, i0, -num), (y, j0, -num), (x[i0], np.arange(k), den + num)):
        after = _next(tokens)
        new = np.ones(len(tokens), np.int64)
        new[after[after < len(tokens)]] = 0
        weight += one * np.cumsum(new)[at]
        step = np.searchsorted(at, np.arange(len(tokens)), "right")  # the first range without this token
        end = np.searchsorted(at, after)
        np.add.at(every, step[end == k], -one)
        some = (end < k) & (end > step)
        steps.append(step[some])
        ends.append(end[some])
        by.append(np.full(int(some.sum()), -one))
    step, end, amount = (np.concatenate(v) for v in (steps, ends, by))
    order = np.argsort(step, kind="stable")
    step, end, amount = step[order].tolist(), end[order].tolist(), amount[order].tolist()
    least = -np.cumsum(every)[:k]  # what a weight must be, to be 0 with what holds for all ranges
    found, top, n = [], -1, 0
    heads = sorted({0, *step})
    for p, q in zip(heads, [*heads[1:], k], strict=True):
        while n < len(step) and step[n] == p:
            weight[p : end[n]] += amount[n]
            n += 1
        beyond = max(top + 1, p)
        most = np.maximum.accumulate(weight[beyond:][::-1])  # the most from an end on, from the back
        last = k - 1 - np.searchsorted(most, least[p:q])
        for first in np.flatnonzero(last > np.maximum.accumulate(np.append(beyond - 1, last[:-1]))).tolist():
            top = int(last[first])
            found.append((p + first, top))
        if top == k - 1:
            break
    return found


def _ranges(at_i: np.ndarray, at_j: np.ndarray, ours: np.ndarray, theirs: np.ndarray, least: int, num: int, den: int, plain: bool) -> list[tuple[int, int]]:
    """Maximal ranges (first, last) of a stretch's shared tokens that are long and similar enough."""
    k = len(at_i)
    x, y = ours[at_i[0] : at_i[-1] + 1], theirs[at_j[0] : at_j[-1] + 1]
    if plain or (len(set(x.tolist())) == len(x) and len(set(y.tolist())) == len(y)):
        if den * k < num * least:  # too few shared tokens for any passage
            return []
        # No token twice: a range is similar enough if its sum of shared minus unshared, weighted, isn't negative.
        g = (den + num) * np.arange(k) - num * (at_i + at_j)
        most = np.maximum.accumulate(g[::-1])  # the most from an end on, from the back
        last = k - 1 - np.searchsorted(most, g - (den - num))
        first = np.arange(k)
    else:
        first, last = (np.array(v) for v in zip(*_widest(at_i - at_i[0], at_j - at_j[0], x, y, num, den), strict=True))
    ok = (at_i[last] - at_i[first] + 1 >= least) & (at_j[last] - at_j[first] + 1 >= least)
    first, last = first[ok], last[ok]
    if not len(first):
        return []
    longer = last > np.append(-1, np.maximum.accumulate(last)[:-1])  # not inside one that begins before
    return list(zip(first[longer].tolist(), last[longer].tolist(), strict=True))


def _followed(ours: np.ndarray, theirs: np.ndarray, least: int, num: int, den: int, plain: bool) -> list[tuple[int, int, int, int]]:
    at_i, at_j = _chain(ours, theirs)
    if not len(at_i):
        return []
    found = []
    step_i, step_j = np.diff(at_i), np.diff(at_j)
    heads = np.flatnonzero(np.append(True, (step_i > least) | (step_j <= 0) | (step_j > least))).tolist()
    for lo, hi in zip(heads, [*heads[1:], len(at_i)], strict=True):
        i, j = at_i[lo:hi], at_j[lo:hi]
        if i[-1] - i[0] + 1 >= least and j[-1] - j[0] + 1 >= least:
            found += [(int(i[p]), int(i[q]), int(j[p]), int(j[q])) for p, q in _ranges(i, j, ours, theirs, least, num, den, plain)]
    return found


def _fewest(tokens: np.ndarray, least: int, some: np.ndarray | None = None) -> int:
    """The fewest distinct tokens, or of ``some`` places only, among ``least`` neighbouring ones; ``least``, if there are no more tokens."""
    n = len(tokens)
    if n < least:
        return least
    before = np.full(n, -1)
    after = _next(tokens)
    again = np.flatnonzero(after < n)
    before[after[again]] = again
    # A token counts in the windows in which it stands for the first time: those that begin behind its last place.
    at = np.arange(n)
    first = np.maximum(np.maximum(before + 1, at - least + 1), 0)
    if some is not None:
        first, at = first[some], at[some]
    change = np.bincount(first, minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    return int(np.cumsum(change)[: n - least + 1].min())


def verified(a: np.ndarray, b: np.ndarray, least: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """Ranges (l, r) of a and (m, s) of b that start and end with shared tokens and are long and similar enough.

    Shared tokens are followed along both texts; of each stretch all maximal ranges that are similar
    enough are found, not only unchanged ones. A passage that stands several times in either text is
    found at each place: texts with a token twice are followed both ways.
    """
    ours, theirs = a.tolist(), b.tolist()
    x, y = set(ours), set(theirs)
    both = len(x & y)
    plain = len(x) == len(ours) and len(y) == len(theirs)
    if both and den * both >= num * (len(x) + len(y) - both):  # similar as they are: only the ends are trimmed
        l, m = next(i for i, t in enumerate(ours) if t in y), next(j for j, t in enumerate(theirs) if t in x)
        r = len(ours) - 1 - next(i for i, t in enumerate(reversed(ours)) if t in y)
        s = len(theirs) - 1 - next(j for j, t in enumerate(reversed(theirs)) if t in x)
        if r - l + 1 >= least and s - m + 1 >= least:
            return [(l, r, m, s)]
    if plain and den * both < num * least:  # too few shared tokens for any passage
        return []
    if not plain:  # nor if it has too many unshared ones: at least those of the ``least`` neighbouring tokens with the fewest, on both sides
        if min(len(ours), len(theirs)) < least:
            return []
        apart = [_fewest(t, least, ~np.fromiter(map(other.__contains__, own), bool, len(own))) for t, own, other in ((a, ours, y), (b, theirs, x))]
        if (den - num) * both < num * sum(apart):
            return []
    found = _followed(a, b, least, num, den, plain)
    if len(y) < len(theirs):
        found += [(l, r, m, s) for m, s, l, r in _followed(b, a, least, num, den, False)]
    return found


def _fetch(batches):
    """Rows to be verified: a text that others are held against (once a salt), and passages of texts."""
    for batch in batches:
        rows = []
        for mark, text, salts, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = signed(shingle_hashes(word_hashes(text), SHINGLE))
            if salts:
                raw = tokens.tobytes()
                rows += [(mark, salt, None, None, None, None, raw) for salt in range(salts)]
            for p in places:
                rows.append((p["b"], p["salt"], mark, p["l"], p["m"], p["s"], tokens[p["l"] : p["r"] + 1].tobytes()))
        for at in range(0, len(rows), 2000):
            columns = list(zip(*rows[at : at + 2000], strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["b", "salt", "a", "l", "m", "s", "tokens"])


def _verify(least: int, num: int, den: int):
    def run(batches):
        at, whole = None, None
        for batch in batches:
            rows = []
            for b, _, a, l, m, s, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(tokens, np.int64)
                if a is None:
                    at, whole = b, tokens
                elif at == b:
                    got = [(a, l + f[0], l + f[1], b, m + f[2], m + f[3]) for f in verified(tokens, whole[m : s + 1], least, num, den)]
                    rows += got or [(a, l, l + len(tokens) - 1, b, None, None)]  # a place without passage stays open
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "l", "r", "b", "m", "s"])

    return run


def _opened(batches):
    """Tokens of the places to be held against each other."""
    for batch in batches:
        rows = []
        for mark, text, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = signed(shingle_hashes(word_hashes(text), SHINGLE))
            rows += [(w["key"], mark, w["l"], w["root"], w["open"], tokens[w["l"] : w["r"] + 1].tobytes()) for w in windows]
        for at in range(0, len(rows), 2000):
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 2000], strict=True), kinds, strict=True)], names=["key", "text", "l", "root", "open", "tokens"])


def _dense(shared: np.ndarray, new: np.ndarray, sizes: np.ndarray, least: int, num: int, den: int) -> np.ndarray:
    """Which of the places of ``sizes``, whose tokens lie end to end, have a range of ``least`` or more that can be similar enough to another
    place, by the tokens shared with it and those that stand in their own place for the first time.

    Each unshared token counts once, where it first stands: in a range there may be more, so none is left out that is similar enough.
    """
    # A place's sums are less than those of the place before by more than any of them is.
    ends = np.cumsum(sizes)
    place = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.cumsum(np.where(shared, den - num, -num * new))
    deep = 2 * den * (len(shared) + 1)
    # before[t] is the sum before token t.
    before = np.append(0, sums[:-1]) - deep * place
    lowest = np.minimum.accumulate(before)
    out = np.zeros(len(sizes), bool)
    at = spread(ends - sizes + least - 1, np.maximum(sizes - least + 1, 0))
    out[place[at[sums[at] - deep * place[at] >= lowest[at - least + 1]]]] = True
    return out


def settled(members: list[tuple[int, int, int, bool, np.ndarray]], least: int, num: int, den: int) -> list[tuple[int, int, int, int, int, int]]:
    """Passages (a, l, r, b, m, s) among places (text, l, root, open, tokens) that were compared with one text.

    A place is held against all others that can have a passage in common with it, until
    it is linked (no longer open) and in their class. What is left out: places of one class that both
    are linked, and pairs with too few common tokens: a passage has at least as many distinct tokens as any ``least`` neighbouring ones
    of its place, and shares num/den of both sides' together. To find these, each place leaves out its most
    frequent tokens, one less than a passage must share, the rest are looked up, and what is shared is counted for all that meet.
    """
    texts, starts, roots, opens, tokens = (list(v) for v in zip(*members, strict=True))
    parent = {r: r for r in roots}

    def top(r):
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    n = len(members)
    of = np.repeat(np.arange(n), [len(t) for t in tokens])
    values, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    pairs, firsts = np.unique(of * np.int64(len(values)) + inverse, return_index=True)  # each window's tokens once
    sizes = np.array([len(t) for t in tokens])
    begins, new = np.cumsum(sizes) - sizes, np.zeros(len(inverse), bool)
    new[firsts] = True
    of, value = pairs // len(values), pairs % len(values)
    frequency = np.bincount(value, minlength=len(values))
    order = np.lexsort((value, -frequency[value], of))
    of, value = of[order], value[order]
    ends = np.searchsorted(of, np.arange(n + 1))
    distinct = np.diff(ends)
    plain = distinct == [len(t) for t in tokens]
    fewest = np.array([least if p else _fewest(t, least) for p, t in zip(plain, tokens, strict=True)])
    drop = -(-num * fewest // den) - 1
    kept = np.arange(len(of)) - ends[of] >= drop[of]
    by_value = np.flatnonzero(kept)[np.argsort(value[kept], kind="stable")]
    holders, bounds = of[by_value], np.searchsorted(value[by_value], np.arange(len(values) + 1))
    known, column = np.zeros(len(values), bool), np.zeros(len(values), np.int64)  # the tokens of the place whose turn it is, numbered
    found, hits = [], np.zeros(n, np.int64)
    text_of = np.array(texts)
    # Windows that are open go first; those of the greatest class, with nothing to find, last and only as partners.
    tops = [top(r) for r in roots]
    counts = Counter(tops)
    greatest = max(set(tops), key=counts.__getitem__)
    for k in sorted(range(n), key=lambda k: (tops[k] == greatest, not opens[k])):
        if not opens[k] and tops[k] == greatest:
            break
        mine = value[ends[k] + drop[k] : ends[k + 1]]
        other = np.unique(np.concatenate([holders[bounds[v] : bounds[v + 1]] for v in mine.tolist()] or [np.zeros(0, np.int64)]))
        other = other[text_of[other] != texts[k]]
        if len(other):
            # How many tokens each other place shares, in pieces of bounded size: with too few there is no passage.
            known[value[ends[k] : ends[k + 1]]] = True
            cuts = np.flatnonzero(np.diff(np.cumsum(distinct[other]) // TRIED, prepend=0)).tolist()
            shared = [
                np.add.reduceat(known[value[spread(ends[some], distinct[some])]].astype(np.int64), np.cumsum(distinct[some]) - distinct[some])
                for some in (other[a:b] for a, b in itertools.pairwise([0, *cuts, len(other)])) if len(some)
            ]
            known[value[ends[k] : ends[k + 1]]] = False
            other = other[(den + num) * np.concatenate(shared) >= num * (fewest[k] + fewest[other])]
        if len(other):
            # The shared tokens must lie together, too, in both.
            mine = value[ends[k] : ends[k + 1]]
            known[mine], column[mine] = True, np.arange(len(mine))
            columns, firsts = column[inverse[begins[k] : begins[k] + sizes[k]]], new[begins[k] : begins[k] + sizes[k]]
            kept = [np.zeros(0, np.int64)]
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[other] + sizes[k]) // TRIED, prepend=0)).tolist()
            for some in (other[a:b] for a, b in itertools.pairwise([0, *cuts, len(other)])):
                at = spread(begins[some], sizes[some])
                some = some[_dense(known[inverse[at]], new[at], sizes[some], least, num, den)]
                theirs = value[spread(ends[some], distinct[some])]
                both = known[theirs]
                table = np.zeros((len(some), len(mine)), bool)
                table[np.repeat(np.arange(len(some)), distinct[some])[both], column[theirs[both]]] = True
                kept.append(some[_dense(table[:, columns].ravel(), np.tile(firsts, len(some)), np.full(len(some), sizes[k]), least, num, den)])
            known[mine] = False
            other = np.concatenate(kept)
        for o in other[np.argsort(-hits[other], kind="stable")].tolist():
            if not opens[k] and not opens[o] and top(roots[k]) == top(roots[o]):
                continue
            got = verified(tokens[k], tokens[o], least, num, den)
            if got:
                found += [(texts[k], starts[k] + l, starts[k] + r, texts[o], starts[o] + m, starts[o] + s) for l, r, m, s in got]
                parent[top(roots[k])] = top(roots[o])
                opens[k] = opens[o] = False
                hits[o] += 1
                hits[k] += 1
    return found


def _settle(least: int, num: int, den: int):
    def run(batches):
        key, held, seen = None, [], set()

        def close():
            rows = [x if x[0] > x[3] else (*x[3:], *x[:3]) for x in settled(held, least, num, den)] if len(held) > 1 else []
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "l", "r", "b", "m", "s"])

        for batch in batches:
            for k, *member, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and held:
                    yield close()
                    held, seen = [], set()
                key = k
                window = (*member[:2], len(tokens))
                if window not in seen:  # rows that repeat an id bring a text again
                    seen.add(window)
                    held.append((*member, np.frombuffer(tokens, np.int64)))
        if held:
            yield close()

    return run


def _merged(batches):
    """Word ranges of each text's passages, merged."""
    for batch in batches:
        rows = []
        for spans in batch.column(1).to_pylist():
            out: list[list[int]] = []
            for s, e in sorted((p["s"], p["e"] + SHINGLE) for p in spans):
                if out and s <= out[-1][1]:
                    out[-1][1] = max(e, out[-1][1])
                else:
                    out.append([s, e])
            rows.append((sum(e - s for s, e in out), ",".join(f"{s}:{e}" for s, e in out)))
        n, text = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(text, pa.string())], names=["mark", "n_repeat", "ranges"])


def _rest(d: DataFrame, texts: DataFrame, places: DataFrame, compared: DataFrame, parts: int, least: int, num: int, den: int) -> DataFrame:
    """Passages among the texts compared with one text, where one of them has none in common with it."""
    without = compared.filter("m is null").select("a", "b", "l").distinct().withColumn("open", F.lit(True))
    units = without.select("b").distinct().join(places.groupBy("b").agg(F.countDistinct("a").alias("n")).filter("n > 1"), "b", "left_semi")
    classes = components(compared.filter("m is not null").select("a", "b")).select(F.col("node").alias("a"), "root")
    state = places.join(units, "b", "left_semi").join(without, ["a", "b", "l"], "left").join(classes, "a", "left")
    windows = F.struct(F.col("b").alias("key"), "l", "r", F.coalesce("root", "a").alias("root"), F.coalesce("open", F.lit(False)).alias("open"))
    wanted = state.groupBy(F.col("a").alias("of")).agg(F.collect_list(windows).alias("windows"))
    holder = wanted.join(texts.select("mark", "least_id"), F.col("of") == F.col("mark")).select("mark", "least_id", "windows")
    fetched = d.withColumnRenamed("mark", "own").join(holder, F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("own") == F.col("mark"))).select("mark", "text", "windows")
    dealt = fetched.mapInArrow(_opened, "key long, text long, l long, root long, open boolean, tokens binary")
    return dealt.repartition(parts, "key").sortWithinPartitions("key", "text", "l").mapInArrow(_settle(least, num, den), "a long, l long, r long, b long, m long, s long")


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, num: int = 4, den: int = 5, hashes: int = 4, enough: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_repeat_words, passages ("start:end" in words, comma-joined), component_id."""
    small_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = min_words - SHINGLE + 1
    d = docs.select(named(doc_id).cast("long").alias("doc_id"), named(text).alias("text"), F.xxhash64(named(text)).alias("mark"))
    rows = checkpointed(d.select("doc_id", "mark", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_words")))
    texts = rows.groupBy("mark").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.max("n_words").alias("words"))
    words = texts.agg(F.sum("words")).first()[0] or 0
    buckets = max(16, 2 * hashes * words // least // BUCKET_WINDOWS)
    sent = d.select("mark", "text").mapInArrow(_scan(hashes, min_words, buckets), "bucket int, blob binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared, "key long, text long, l int, c int, r int, f int")
    meets = shared.groupBy("text").agg(F.collect_list(F.struct("f", "key", "l", "c", "r")).alias("w")).mapInArrow(_meets(hashes, enough, least), _MEMBER)
    links = meets.groupBy(F.pmod("key", F.lit(2 * buckets)).alias("home")).applyInArrow(_links, "a long, b long, l int, r int, m int, s int")
    places = checkpointed(links.groupBy("a", "b").agg(F.collect_list(F.struct("l", "r", "m", "s")).alias("w")).mapInArrow(_places, "a long, b long, l long, r long, m long, s long"))
    salts = places.groupBy("b").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    member = places.join(salts, "b").select(F.col("a").alias("of"), F.lit(0).alias("salts"), F.struct("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "l", "r", "m", "s").alias("p"))
    target = salts.select(F.col("b").alias("of"), "salts", F.lit(None).cast(member.schema["p"].dataType).alias("p"))
    needed = member.unionAll(target).groupBy("of").agg(F.max("salts").alias("salts"), F.collect_list("p").alias("places"))
    # One document's text stands for all equal ones.
    holder = needed.join(texts.select("mark", "least_id"), F.col("of") == F.col("mark")).select("mark", "least_id", "salts", "places")
    fetched = d.withColumnRenamed("mark", "own").join(holder, F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("own") == F.col("mark"))).select("mark", "text", "salts", "places")
    rows_to_verify = fetched.mapInArrow(_fetch, "b long, salt int, a long, l long, m long, s long, tokens binary")
    dealt = rows_to_verify.repartition(parts, "b", "salt").sortWithinPartitions("b", "salt", F.col("a").isNotNull())
    compared = checkpointed(dealt.mapInArrow(_verify(least, num, den), "a long, l long, r long, b long, m long, s long"))
    found = checkpointed(compared.filter("m is not null").unionAll(_rest(d, texts, places, compared, parts, least, num, den)))
    spans = found.select(F.col("a").alias("mark"), F.struct(F.col("l").alias("s"), F.col("r").alias("e")).alias("x")).unionAll(found.select(F.col("b").alias("mark"), F.struct(F.col("m").alias("s"), F.col("s").alias("e")).alias("x")))
    ranges = spans.groupBy("mark").agg(F.collect_set("x").alias("spans")).mapInArrow(_merged, "mark long, n_repeat long, ranges string")
    classes = components(found.select("a", "b")).select(F.col("node").alias("mark"), "root")
    facts = texts.join(ranges, "mark", "left").join(classes, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    least_of = facts.groupBy("root").agg(F.min("least_id").alias("least"))
    facts = facts.join(least_of, "root").select(F.col("mark").alias("of"), "copies", "n_repeat", "ranges", "least")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= min_words)
    alone = F.col("n_words") < min_words
    return rows.join(facts, F.col("mark") == F.col("of")).select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_repeat", F.lit(0))).alias("n_repeat_words"),
        F.when(whole, F.format_string("0:%d", "n_words")).otherwise(F.coalesce("ranges", F.lit(""))).alias("passages"),
        F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    )
