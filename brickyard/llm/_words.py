"""Words, shingles and their 64-bit hashes of whole texts, in NumPy over UTF-8 bytes."""

import numpy as np

from brickyard.llm.perfect_hash import mix64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER = LOWER.tobytes()
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_KEPT_POWERS = 2_000_000
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2^64; kept up to a bounded number."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    known = _powers.get(base, np.zeros(0, np.uint64))
    if len(known) < n:
        with np.errstate(over="ignore"):
            known = np.full(max(n, 64), base, np.uint64)
            known[0] = 1
            known = np.cumprod(known, dtype=np.uint64)
        if n <= _KEPT_POWERS:
            _powers[base] = known
    return known[:n]


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 bytes, and where they begin."""
    raw = np.frombuffer(text.translate(_LOWER), np.uint8)
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = ~_IS_SPACE[raw]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64), edges
    # A word's letters are weighed by the base's powers from its first one on: here from the text's, which its own power divides out.
    with np.errstate(over="ignore"):
        part = np.zeros(len(raw) + 1, np.uint64)
        np.multiply(raw.astype(np.uint64) + np.uint64(1), powers(len(raw)), out=part[:-1])
        words = np.add.reduceat(part, edges)[::2] * powers(len(raw), inverse=True)[edges[::2]]
        return mix64(words, 1), edges[::2]


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased."""
    return _hashed((text or "").encode())[0]


def word_hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of texts one after the other, and where each text's begin, with the end of all: many short texts cost few NumPy calls."""
    raws = [(t or "").encode() for t in texts]
    hashes, at = _hashed(b" ".join(raws))
    return hashes, np.searchsorted(at, np.cumsum([0, *(len(r) + 1 for r in raws)]))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words; with fewer words, but not none, one for them all."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = mix64(out + words[i : i + n], 2 + i)
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start..start+size of each row, laid end to end."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
