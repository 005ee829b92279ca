"""A minimal perfect hash over 64-bit keys, as level bit arrays with ranks, in NumPy.

Each level hashes the keys that are left to a bit array; keys alone in their place set its
bit and are done, the others go to the next level. A key's index is the rank of its bit. Keys
that no level can part (equal ones) are left over and returned to the caller.
"""

import numpy as np

_LEVELS = 40
_27, _30, _31, _M1, _M2 = (np.uint64(v) for v in (27, 30, 31, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> _30
        x *= _M1
        x ^= x >> _27
        x *= _M2
        x ^= x >> _31
        return x


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> tuple["PerfectHash", np.ndarray]:
        """The hash and the positions of the keys it couldn't part."""
        levels, left = [], np.arange(len(keys))
        for level in range(_LEVELS):
            if not len(left):
                break
            n_words = int(gamma * len(left)) // 64 + 1
            place = mix64(keys[left], level) % np.uint64(n_words * 64)
            alone = np.bincount(place.astype(np.int64), minlength=n_words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[place.astype(np.int64)]]
        return cls(levels), left

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index, or -1; a key outside the set may get any index."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (words, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(todo):
                break
            place = mix64(keys[todo], level) % np.uint64(len(words) * 64)
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            found = (words[word] >> bit) & np.uint64(1) == 1
            at = todo[found]
            below = words[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[at] = rank[word[found]] + np.bitwise_count(below)
            todo = todo[~found]
        return out
