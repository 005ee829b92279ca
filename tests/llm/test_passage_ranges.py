"""Ranges of texts with tokens twice, without work in the square of their length."""

import time

import numpy as np

from brickyard.llm import passage_dedup
from brickyard.llm._words import word_hashes, word_hashes_of


def _brute(i, j, x, y, num, den):
    """For each first shared token, the furthest last one of a similar enough range that goes beyond those before."""
    out, top = [], -1
    for p in range(len(i)):
        for q in range(len(i) - 1, max(p - 1, top), -1):
            both, one, two = ({*x[i[p : q + 1]]}, {*x[i[p] : i[q] + 1]}, {*y[j[p] : j[q] + 1]})
            if den * len(both) >= num * (len(one) + len(two) - len(both)):
                out.append((p, q))
                top = q
                break
    return out


def test_ranges_of_repeated_tokens():
    r = np.random.default_rng(3)
    for _ in range(60):
        x, y = (r.integers(0, r.integers(3, 30), 40) for _ in range(2))
        k = int(r.integers(2, 25))
        i, j = (np.sort(r.choice(40, k, False)) for _ in range(2))
        i, j = i - i[0], j - j[0]
        x, y = x[: i[-1] + 1], y[: j[-1] + 1]
        y[j] = x[i]
        assert passage_dedup._widest(i, j, x, y, 4, 5) == _brute(i, j, x, y, 4, 5)


def test_long_texts_with_a_token_twice_are_searched_in_little_time():
    a = np.arange(30_000)
    a[-1] = 5
    b = np.where(np.arange(30_000) % 7 == 3, a + 1_000_000, a)
    began = time.process_time()
    passage_dedup.verified(a, b, 46, 4, 5)
    c = np.arange(3000) % 37  # few tokens, all of them many times
    passage_dedup.verified(c, np.where(np.arange(3000) % 5 == 1, c + 100, c), 46, 4, 5)
    assert time.process_time() - began < 2.5


def test_word_hashes_of_many_texts():
    texts = ["One two", None, "", " \n", "two  one\n", "é", "one"]
    hashes, bounds = word_hashes_of(texts)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert hashes[a:b].tolist() == word_hashes(text).tolist()
