"""Deep-shallow suffix sorting.

Suffixes are ordered by multikey quicksort down to a shallow depth: a run of suffixes that agree so far
is split by a pivot's key at its depth (8 bytes) into less, equal and greater; the equal part goes on at
the next depth, the others at the same one. All runs are split at the same time, in NumPy. What then
still ties goes, run by run, into a blind trie, which branches on single characters and compares a whole
string only once for each insertion, so long common prefixes cost one comparison and not one a level.
"""

import itertools

import numpy as np

SHALLOW = 16


class BlindTrie:
    """Strings of one length, in a trie that keeps only branching positions."""

    def __init__(self):
        self.root = None  # a leaf (string, items) or a node [position, {byte: child}, any leaf below]

    @staticmethod
    def _leaf(node):
        return node if isinstance(node, tuple) else node[2]

    def add(self, string: bytes, item: int) -> None:
        if self.root is None:
            self.root = (string, [item])
            return
        node = self.root
        while not isinstance(node, tuple):
            node = node[1].get(string[node[0]]) or node[2]
        known = node[0]
        if known == string:
            node[1].append(item)
            return
        a = np.frombuffer(known, np.uint8)
        split = int(np.argmax(a != np.frombuffer(string, np.uint8)))
        above, key, node = None, None, self.root
        while not isinstance(node, tuple) and node[0] < split:
            above, key = node, string[node[0]]
            node = node[1][key]
        leaf = (string, [item])
        if not isinstance(node, tuple) and node[0] == split:
            node[1][string[split]] = leaf
            return
        fork = [split, {known[split]: node, string[split]: leaf}, self._leaf(node)]
        if above is None:
            self.root = fork
        else:
            above[1][key] = fork

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                out += node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of 8 bytes as big-endian numbers, which order as the bytes do."""
    return np.ascontiguousarray(rows).view(">u8")[:, 0].astype(np.uint64)


def multikey_quicksort(group: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and keys, and where in that order the runs of equal group and keys start."""
    n = len(group)
    order = np.argsort(group, kind="stable")  # groups are runs to begin with
    heads = np.zeros(n, bool)
    heads[np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))] = True
    table = np.stack(keys) if keys else np.zeros((0, n), np.uint64)
    # Runs that aren't done: where they start, their sizes and how many keys they agree in.
    start = np.flatnonzero(heads)
    size = np.diff(np.append(start, n))
    depth = np.zeros(len(start), np.int64)
    while True:
        todo = (size > 1) & (depth < len(keys))
        start, size, depth = start[todo], size[todo], depth[todo]
        if not len(start):
            return order, np.flatnonzero(heads)
        ends = np.cumsum(size)
        run = np.repeat(np.arange(len(start)), size)
        at = np.arange(int(ends[-1])) + np.repeat(start - (ends - size), size)
        members = order[at]
        key = table[depth[run], members]
        first = ends - size
        a, b, c = key[first], key[first + size // 2], key[ends - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[run]
        less, more = key < pivot, key > pivot
        # Places by running counts: a run's lesser ones first, then the equal ones, then the greater ones.
        n_less, n_more = np.cumsum(less), np.cumsum(more)
        less_to, more_to = n_less[ends - 1], n_more[ends - 1]
        less_from, more_from = less_to - less_to, more_to - more_to
        less_from[1:], more_from[1:] = less_to[:-1], more_to[:-1]
        lesser, greater = less_to - less_from, more_to - more_from
        i = np.arange(len(key))
        by_less, by_more = n_less - less_from[run], n_more - more_from[run]
        place = np.where(less, first[run] + by_less - 1, np.where(more, (ends - greater)[run] + by_more - 1, i - by_more + (lesser[run] - by_less)))
        order[at[place]] = members
        sizes = np.stack([lesser, size - lesser - greater, greater], 1).reshape(-1)
        start = np.repeat(start, 3) + (np.cumsum(sizes) - sizes - np.repeat(first, 3))
        depth = np.repeat(depth, 3) + np.tile([0, 1, 0], len(depth))
        some = sizes > 0
        start, size, depth = start[some], sizes[some], depth[some]
        heads[start] = True


def sort_suffixes(group: np.ndarray, text: np.ndarray, length: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (rows of bytes, zero after their length) by group and content, and each one's
    common prefix length with its predecessor in that order (0 at the start of a group)."""
    n, depth = text.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = [_words(text[:, i : i + 8]) for i in range(0, min(shallow, depth - 7), 8)]
    order, starts = multikey_quicksort(group, keys)
    sizes = np.diff(np.append(starts, n))
    rest = 8 * len(keys)
    table = np.pad(text, ((0, 0), (0, -depth % 8))).view(">u8").astype(np.uint64)
    if rest < depth:
        # Runs whose tails are all equal are in order as they are.
        tails = table[order, len(keys) :]
        equal = np.append(True, (tails[1:] == tails[:-1]).all(axis=1))
        equal[starts] = True
        for run in np.flatnonzero((sizes > 1) & ~np.logical_and.reduceat(equal, starts)).tolist():
            at, size = starts[run], sizes[run]
            members = order[at : at + size]
            alike: dict[bytes, list[int]] = {}
            trie = BlindTrie()
            for item, row in zip(members.tolist(), text[members, rest:], strict=True):
                alike.setdefault(row.tobytes(), []).append(item)
            for string, items in alike.items():
                trie.add(string, items)
            order[at : at + size] = list(itertools.chain.from_iterable(trie.ordered()))
    lcp = np.zeros(n, np.int64)
    if not depth:
        return order, lcp
    ranked = table[order]
    differ = ranked[1:] ^ ranked[:-1]
    word = np.argmax(differ != 0, axis=1)
    value = differ[np.arange(n - 1), word]
    same = sum((value < np.uint64(1 << (8 * b))).astype(np.int64) for b in range(8))  # the first bytes that are the same
    first = np.minimum(np.where(value == 0, depth, 8 * word + same), depth)
    lcp[1:] = np.minimum(first, np.minimum(length[order][1:], length[order][:-1]))
    lcp[1:][group[order][1:] != group[order][:-1]] = 0
    return order, lcp
