"""Suffix trees of many short sequences at once, in NumPy, and the branching tandem repeats they hold.

The trees are kept as suffix arrays with the common prefixes of neighbours: an inner node of string depth h is an
interval of the array. Nodes with more than two children are taken as binary ones of the same depth, so that every two
leaves part at exactly one node.
"""

import numpy as np


def _order(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """The order by (major, minor), both from 0."""
    n = len(major)
    bits = [int(x.max(initial=0)).bit_length() for x in (major, minor)]
    place = n.bit_length()
    if sum(bits) + place < 63:
        packed = (major << (bits[1] + place)) | (minor << place) | np.arange(n)
        packed.sort()
        return packed & ((1 << place) - 1)
    return np.lexsort((minor, major))


def suffix_arrays(sequence: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all sequences, sorted by (sequence, symbols): array, its inverse, and for each entry the length of
    the prefix shared with the one before (0 across sequences).

    ``sequence`` numbers the sequences and ascends. Prefixes double each round; only suffixes that aren't alone with theirs
    are sorted again.
    """
    n = len(sequence)
    ends = np.append(np.flatnonzero(np.diff(sequence)) + 1, n)
    end = np.repeat(ends, np.diff(np.append(0, ends)))  # where a place's sequence ends
    at = _order(sequence, symbol)
    new = np.ones(n, bool)
    new[1:] = (np.diff(sequence[at]) != 0) | (np.diff(symbol[at]) != 0)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a group is named by its first entry
    rank = np.empty(n, np.int64)
    rank[at] = first
    parted = np.zeros(n, np.int8)  # the round after which an entry and the one before differ
    levels, width, round_ = [], 1, 0
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        levels.append(rank.copy())
        round_ += 1
        places = at[open_]
        ahead = places + width
        inside = ahead < end[places]
        key = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        again = _order(rank[places], key)
        places, key = places[again], key[again]
        at[open_] = places
        group = rank[places]
        split = np.zeros(len(open_), bool)
        split[1:] = (group[1:] == group[:-1]) & (key[1:] != key[:-1])
        parted[open_[split]] = round_
        new[open_[split]] = True
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[places] = first[open_]
        width *= 2
    shared = np.zeros(n, np.int64)
    for level in range(round_ - 1, -1, -1):
        entries = np.flatnonzero(parted > level)
        a, b, done = at[entries - 1], at[entries], shared[entries]
        fits = (a + done < end[a]) & (b + done < end[b])
        same = np.zeros(len(entries), bool)
        same[fits] = levels[level][(a + done)[fits]] == levels[level][(b + done)[fits]]
        shared[entries[same]] += 1 << level
    return at, rank, shared


def _nodes(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The binary inner nodes: the entry at which each one's right child begins, and where its leaves begin and end."""
    inner = np.flatnonzero(shared > 0)
    left, right = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64)
    lefts, rights = [0] * len(inner), [0] * len(inner)
    stack: list[tuple[int, int, int]] = []  # (depth, number, where its leaves begin) of nodes whose leaves haven't ended
    before = -2
    for number, (entry, depth) in enumerate(zip(inner.tolist(), shared[inner].tolist(), strict=True)):
        if entry != before + 1:
            for _, k, _ in stack:
                rights[k] = before + 1
            stack.clear()
        begin = entry - 1
        while stack and stack[-1][0] > depth:
            _, k, begin = stack.pop()
            rights[k] = entry
        # Of nodes equally deep the one to the left stands above, so this one's left child ends where that one's does.
        if stack and stack[-1][0] == depth:
            begin = inner[stack[-1][1]]
        lefts[number] = begin
        stack.append((depth, number, begin))
        before = entry
    for _, k, _ in stack:
        rights[k] = before + 1
    left[:], right[:] = lefts, rights
    return inner, left, right


def branching_tandem_repeats(sequence: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (start, root length) at which a root stands twice in a row and the square can't be moved right by one.

    At each inner node the leaves of its smaller half are listed; a leaf i at string depth h makes a branching tandem
    repeat with i + h, or i - h, if that is a leaf of the other half. A leaf is in a smaller half O(log n) times.
    """
    at, rank, shared = suffix_arrays(sequence, symbol)
    middle, left, right = _nodes(shared)
    depth = shared[middle]
    small_left = middle - left <= right - middle
    begin, size = np.where(small_left, left, middle), np.where(small_left, middle - left, right - middle)
    other, other_end = np.where(small_left, middle, left), np.where(small_left, right, middle)
    starts, roots = [], []
    n = len(at)
    done = np.cumsum(size)
    cut = 0
    while cut < len(size):  # so many leaves at a time
        stop = max(cut + 1, int(np.searchsorted(done, (done[cut - 1] if cut else 0) + 4_000_000, "right")))
        part = slice(cut, stop)
        sizes = size[part]
        node = np.repeat(np.arange(cut, stop), sizes)
        leaf = at[np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[node]]
        h = depth[node]
        for step in (h, -h):
            mate = leaf + step
            held = np.flatnonzero((mate >= 0) & (mate < n))
            where = rank[mate[held]]
            nodes = node[held]
            held = held[(where >= other[nodes]) & (where < other_end[nodes])]
            starts.append(np.minimum(leaf[held], mate[held]))
            roots.append(h[held])
        cut = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(roots)


def maximal_runs(sequence: np.ndarray, symbol: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, end, period) of all stretches of at least ``least`` symbols, and two periods, with this smallest period,
    that no neighbour extends; sorted by start, then period.

    A run's last square is its one branching tandem repeat of that root. It is rotated left for as long as it stays a
    repeat. Squares of roots that are powers end where the root's own run ends, inside it, and so merge into it.
    """
    start, root = branching_tandem_repeats(sequence, symbol)
    end = start + 2 * root
    begin = start.copy()
    moving = np.arange(len(start))
    bounds = np.append(np.flatnonzero(np.diff(sequence)) + 1, len(sequence))
    low = np.append(0, bounds)[np.searchsorted(bounds, start, "right")] if len(start) else start
    for _ in range(least):  # most are too short, and end here
        moving = moving[begin[moving] > low[moving]]
        moving = moving[symbol[begin[moving] - 1] == symbol[begin[moving] + root[moving] - 1]]
        if not len(moving):
            break
        begin[moving] -= 1
    unsure = np.zeros(len(start), bool)
    unsure[moving] = True
    long = np.flatnonzero(end - begin >= least)
    long = long[np.lexsort((root[long], end[long]))]
    found: list[tuple[int, int, int]] = []
    last = -1
    for k in long.tolist():
        e, q, s = int(end[k]), int(root[k]), int(begin[k])
        if e != last:
            last, covered = e, e
        if e - 2 * q >= covered:
            continue  # its root is a power
        if unsure[k]:
            s = _rotated(symbol, s, q, int(low[k]))
        covered = min(covered, s)
        found.append((s, e, q))
    return np.array(sorted(found), np.int64).reshape(-1, 3)[:, :3]


def _rotated(symbol: np.ndarray, start: int, period: int, low: int) -> int:
    """How far left of start the period goes on; looks twice as far each time."""
    reach = 64
    while start > low:
        reach = min(reach, start - low)
        differ = np.flatnonzero(symbol[start - reach : start] != symbol[start - reach + period : start + period])
        if len(differ):
            return start - reach + int(differ[-1]) + 1
        start -= reach
        reach *= 2
    return start
