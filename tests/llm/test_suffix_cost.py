"""What a bucket of passages costs: bytes on the way, and runs that tie."""

import struct

import numpy as np
import zstandard

from brickyard.llm import deep_shallow, suffix_dedup


def _bucket(n: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(5)
    size = r.integers(50, 90, n)
    known = {"known_doc": np.arange(40) * 3, "known_print": r.integers(-(2**60), 2**60, 40), "known_start": np.arange(40) * 900, "known_end": np.arange(40) * 900 + 70}
    rows = {"doc": np.append(-(2**63), np.cumsum(r.integers(1, 99, n - 1))), "print": np.full(n, -7), "passages": np.ones(n), "step": r.integers(-5000, 5000, n), "left": r.integers(0, 40, n), "size": size}
    return rows | known | {"bytes": np.tile(np.frombuffer(b"abcdefghij", np.uint8), int(size.sum()) // 10 + 1)[: int(size.sum())]}


def test_numbers_of_a_bucket_leave_little_to_send():
    one = _bucket(4000)
    blob = suffix_dedup.pack(one)
    got = suffix_dedup.unpack(blob)
    for name in ("doc", "print", "left", "size", "known_doc", "known_print", "known_start", "known_end", "bytes"):
        assert np.array_equal(got[name], one[name]), name
    assert np.array_equal(got["start"], np.cumsum(one["step"]))
    parts = [np.ascontiguousarray(one[n], t).tobytes() for n, t in suffix_dedup._FIELDS]
    rowwise = zstandard.ZstdCompressor(level=6).compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts))
    assert len(blob) < 0.97 * len(rowwise)


def test_equal_suffixes_are_compared_once(monkeypatch):
    r = np.random.default_rng(6)
    kinds = np.frombuffer(r.bytes(6 * 40), np.uint8).reshape(6, 40) % 3 + 97
    kinds[:, :16] = 97  # all tie down to the shallow depth
    which = r.integers(0, 6, 3000)
    text, group = kinds[which], which * 0
    added = []
    add = deep_shallow.BlindTrie.add
    monkeypatch.setattr(deep_shallow.BlindTrie, "add", lambda self, string, item: (added.append(string), add(self, string, item))[1])
    order, lcp = deep_shallow.sort_suffixes(group, text, np.full(3000, 40))
    assert len(added) == 6
    rows = [t.tobytes() for t in text[order]]
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(3000))
    for a, b, n in zip(rows, rows[1:], lcp[1:].tolist(), strict=False):
        assert n == next((i for i in range(40) if a[i] != b[i]), 40)


def test_suffixes_without_bytes():
    """A span of 10 bytes has none before its anchor."""
    order, lcp = deep_shallow.sort_suffixes(np.array([1, 0, 1]), np.zeros((3, 0), np.uint8), np.zeros(3, np.int64))
    assert order.tolist() == [1, 0, 2] and lcp.tolist() == [0, 0, 0]
