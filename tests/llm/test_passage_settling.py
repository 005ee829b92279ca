"""Places compared with one text: pairs that can have no passage aren't followed one by one."""

import numpy as np

from brickyard.llm import passage_dedup


def _members(n: int, seed: int, common: int, repeats: bool):
    """Places of which each shares ``common`` tokens with all others, and every fifth a passage with the one before."""
    r = np.random.default_rng(seed)
    stock = np.arange(common)
    out = []
    for i in range(n):
        own = r.integers(10**6, 2**60, 120)
        own[np.sort(r.choice(50, common, False))] = stock
        if i % 5 == 4:
            own[60:] = out[-1][4][60:]
            own[61 + i % 7 :: 9] = r.integers(10**6, 2**60, len(own[61 + i % 7 :: 9]))
        if repeats and i % 4 == 1:
            own[3] = own[50]
        out.append((i, 10 * i, i - i % 3, i % 3 > 0 or i % 2 > 0, own))
    return out


def _each(members, least, num, den):
    """The same with all pairs followed that share a token."""
    return {(a[0], b[0]) for a in members for b in members if a[0] < b[0] and passage_dedup.verified(a[4], b[4], least, num, den)}


def test_settled_pairs():
    for seed, repeats in ((1, False), (2, True)):
        members = _members(40, seed, 30, repeats)
        wanted = _each(members, 46, 4, 5)
        got = passage_dedup.settled(members, 46, 4, 5)
        found = {(min(a, b), max(a, b)) for a, _, _, b, _, _ in got}
        assert wanted and found <= wanted
        assert {x for p in found for x in p} == {x for p in wanted for x in p}


def test_pairs_with_too_few_shared_tokens_are_not_followed(monkeypatch):
    members, calls = _members(60, 3, 8, True), []  # a fourth of the places have a token twice
    verified = passage_dedup.verified
    monkeypatch.setattr(passage_dedup, "verified", lambda *x: (calls.append(x), verified(*x))[1])
    assert passage_dedup.settled(members, 46, 4, 5)
    assert len(calls) <= 60  # not each place with a token twice against all others


def test_fewest_distinct_tokens_of_a_window():
    r = np.random.default_rng(1)
    for _ in range(200):
        tokens, least = r.integers(0, r.integers(2, 80), r.integers(1, 90)), int(r.integers(1, 60))
        brute = [len(set(tokens[i : i + least].tolist())) for i in range(len(tokens) - least + 1)]
        assert passage_dedup._fewest(tokens, least) == min(brute, default=least)
