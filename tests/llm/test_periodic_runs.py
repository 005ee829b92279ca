"""Runs against all periods at all places, in small alphabets and in documents."""

import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brickyard.llm import periodic_runs, suffix_tree


def brute(words, least):
    """{(start, end): smallest period}"""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return found


def made(seed):
    r = random.Random(seed)
    words = [r.choice("abc"[: r.randrange(1, 4)]) for _ in range(r.randrange(0, 70))]
    if words and r.random() < 0.6:
        a = r.randrange(len(words))
        p = 1 + (len(words) - a) // r.randrange(3, 9)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=5), st.sampled_from([2, 5, 12]))
def test_maximal_runs(seeds, least):
    texts = [t for t in map(made, seeds) if t]
    sequence = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    symbol = np.array([ord(w) for t in texts for w in t], np.int64)
    want, at = [], 0
    for t in texts:
        want += [(s + at, e + at, q) for (s, e), q in brute(t, least).items()]
        at += len(t)
    if len(symbol):
        assert [tuple(x) for x in suffix_tree.maximal_runs(sequence, symbol, least).tolist()] == sorted(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=30), min_size=1, max_size=4))
def test_suffix_arrays(texts):
    sequence = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    places = [(k, i) for k, t in enumerate(texts) for i in range(len(t))]
    at, rank, shared = suffix_tree.suffix_arrays(sequence, np.array([x for t in texts for x in t], np.int64))
    suffixes = [(places[i][0], texts[places[i][0]][places[i][1] :]) for i in at.tolist()]
    assert suffixes == sorted(suffixes) and rank[at].tolist() == list(range(len(at)))
    for k in range(1, len(at)):
        (a, x), (b, y) = suffixes[k - 1], suffixes[k]
        common = next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y))) if a == b else 0
        assert shared[k] == common


def test_documents(spark, docs, rows, empty):
    extra = [(600 + i, " ".join(made(i)), "s") for i in range(40)] + [(700, "la " * 5000, "s"), (701, "so la\n" * 20, "s"), (702, "\x1c ".join("ab" * 20), "s")]
    more = spark.createDataFrame(extra, "doc_id long, text string, source string")
    out = periodic_runs.periodic_runs(docs.select("doc_id", "text", "source").unionAll(more)).collect()
    want = collections.Counter()
    for d, t, _ in [*rows, *extra]:
        words = (t or "").encode().split()
        runs = sorted((s, e, q) for (s, e), q in (brute(words, 12) if len(words) < 1000 else {(0, len(words)): 1} if words[0] == b"la" else {}).items())
        kept = [w.decode() for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in runs)]
        want[d, len(words), tuple((s, e - s, q) for s, e, q in runs), " ".join(kept)] += 1
    assert collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in out) == want
    assert periodic_runs.periodic_runs(docs).count() == len(rows)  # extra columns don't clash
    assert periodic_runs.periodic_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, 1)


def test_long_powers():
    """One symbol for long, and a long word repeated: the work stays far from the square of the length."""
    n = 60_000
    assert suffix_tree.maximal_runs(np.zeros(n, np.int64), np.zeros(n, np.int64), 12).tolist() == [[0, n, 1]]
    word = np.random.default_rng(3).integers(0, 10**6, n // 3)
    assert suffix_tree.maximal_runs(np.zeros(n, np.int64), np.tile(word, 3), 12).tolist() == [[0, n, n // 3]]
