"""What the search for passages tries: windows and pairs that can lead nowhere aren't tried one by one."""

import itertools

import numpy as np
import pyarrow as pa

from brickyard.llm import passage_dedup


def _tree(values, least):
    """Compact windows by the definition: the leftmost least value, and what is on its sides."""
    out, stack = [], [(0, len(values) - 1)]
    while stack:
        l, r = stack.pop()
        if r - l + 1 >= least:
            c = l + int(values[l : r + 1].argmin())
            out.append((l, c, r))
            stack += [(l, c - 1), (c + 1, r)]
    return sorted(out)


def test_windows_of_texts_end_to_end():
    r = np.random.default_rng(4)
    for n in range(150):
        least = int(r.integers(1, 12))
        sizes = r.integers(least, 90, r.integers(1, 6))
        values = r.integers(0, (3, 40, 2**63)[n % 3], sizes.sum()).astype(np.uint64)
        text, *window = passage_dedup.windows_of(values, sizes, least)
        for k, own in enumerate(np.split(values, np.cumsum(sizes)[:-1])):
            assert sorted(zip(*(x[text == k].tolist() for x in window), strict=True)) == _tree(own, least)


def _windows(tokens, least, f):
    values = passage_dedup.mix64(tokens, 100 + f)
    l, c, r = np.array(passage_dedup.compact_windows(values, least)).T
    return {"key": values[c], "l": l, "c": c, "r": r, "lo": c, "hi": c}


def test_only_windows_that_hold_each_other_are_paired(monkeypatch):
    """A text that repeats itself has windows within windows by the thousand; the pairs tried follow those found."""
    r = np.random.default_rng(5)
    rows = lambda x: sorted(zip(*(x[n].tolist() for n in ("key", "l", "r", "lo", "hi")), strict=True))
    for tokens in (r.integers(0, 2**60, 900), np.tile(r.integers(0, 2**60, 7), 90), r.integers(0, 9, 500), np.append(np.tile([5, 3], 80), r.integers(0, 50, 300))):
        one, two = (_windows(tokens.astype(np.uint64), 6, f) for f in range(2))
        some = np.flatnonzero(r.random(len(two["c"])) < 0.7)  # those that other texts share
        for other in (two, {n: v[some] for n, v in two.items()}, {n: v[:0] for n, v in two.items()}):
            assert rows(passage_dedup.paired(one, other, passage_dedup.nests(other), 6)) == rows(passage_dedup.overlaid(one, other, 6))

    made, holding = [], passage_dedup._holding
    monkeypatch.setattr(passage_dedup, "_holding", lambda *x: (made.append(holding(*x)), made[-1])[1])
    of = [_windows(np.tile(r.integers(0, 2**60, 7), 3000).astype(np.uint64), 46, f) for f in range(4)]
    window = [{"f": f, "key": int(k) >> 1, "l": int(l), "c": int(c), "r": int(e)} for f, o in enumerate(of) for k, l, c, e in zip(o["key"], o["l"], o["c"], o["r"], strict=True)]
    kind = pa.list_(pa.struct([("f", pa.int32()), ("key", pa.int64()), ("l", pa.int32()), ("c", pa.int32()), ("r", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([window], kind)], names=["text", "w"])
    found = sum(b.num_rows for b in passage_dedup._meets(4, 2, 46)([batch]))
    assert found and len(made) == len(list(itertools.combinations(range(4), 2)))
    assert sum(len(i) for i, _ in made) <= 4 * len(window)  # of some 9,000,000 a pair of hashes


def test_places_that_share_tokens_far_apart_are_not_followed(monkeypatch):
    """Enough shared tokens, but never enough of them together in both places: there is no passage."""
    r, calls = np.random.default_rng(6), []
    stock = np.arange(60)
    members = []
    for i in range(40):
        own = r.integers(10**6, 2**60, 240)
        if i % 2:  # spread
            own[::4] = stock
        else:  # together
            own[80:140] = stock
        members.append((i, 0, i, True, own))
    members[7][4][5] = members[7][4][9]
    # Two with a passage in common, in a place with a token twice.
    members += [(100 + i, 0, 100 + i, True, np.concatenate([r.integers(10**6, 2**60, 30), np.arange(500, 560), [500], r.integers(10**6, 2**60, 30)])) for i in range(2)]
    spread_out = [m for m in members if m[0] % 2 or m[0] >= 100] + members[:1]
    verified = passage_dedup.verified
    monkeypatch.setattr(passage_dedup, "verified", lambda *x: (calls.append(x), verified(*x))[1])
    assert {(min(x[0], x[3]), max(x[0], x[3])) for x in passage_dedup.settled(spread_out, 46, 4, 5)} == {(100, 101)}
    assert len(calls) <= 2  # not each pair


def test_dense_places_hold_all_that_have_a_passage():
    """What is left out has no passage, by all pairs followed."""
    r = np.random.default_rng(7)
    for n in range(60):
        tokens = int(r.choice([30, 60, 1000]))
        x, y = (r.integers(0, tokens, r.integers(12, 70)) for _ in range(2))
        if n % 2:
            part = r.integers(0, tokens, 16)
            x[2 : 2 + min(16, len(x) - 2)] = part[: len(x) - 2]
            y[-16:] = part[-min(16, len(y)) :]
            y[-8] = 5000
        members = [(0, 0, 0, True, x.astype(np.int64)), (1, 0, 1, True, y.astype(np.int64))]
        both = passage_dedup.verified(x, y, 10, 4, 5) + passage_dedup.verified(y, x, 10, 4, 5)
        assert bool(passage_dedup.settled(members, 10, 4, 5)) == bool(both)


def test_repeated_sentences_with_too_much_of_their_own_are_not_followed(monkeypatch):
    """Texts made of one sentence again and again share enough tokens, but no part of one is similar enough to a part of the other."""
    calls, widest = [], passage_dedup._widest
    monkeypatch.setattr(passage_dedup, "_widest", lambda *x: (calls.append(x), widest(*x))[1])
    x = np.append(np.tile(np.arange(31), 38), np.arange(100, 112))
    y = np.append(np.tile(np.where(np.arange(31) % 6 == 1, np.arange(31) + 50, np.arange(31)), 38), np.arange(100, 112))
    assert passage_dedup.verified(x, y, 46, 4, 5) == []
    assert not calls
    y = np.append(np.tile(np.where(np.arange(31) == 1, 50, np.arange(31)), 38), np.arange(200, 280))
    assert passage_dedup.verified(x, y, 46, 4, 5) and calls


def test_pairs_left_out_have_no_passage():
    r, without = np.random.default_rng(8), 0
    for _ in range(300):
        tokens, n = int(r.choice([6, 14, 30])), int(r.integers(12, 60))
        x = np.resize(r.integers(0, tokens, r.integers(4, 20)), n)
        y = np.where(r.random(n) < r.choice([0, 0.1, 0.3]), r.integers(0, 2 * tokens, n), x)[: r.integers(8, n + 1)]
        followed = passage_dedup._followed(x, y, 10, 4, 5, False) + passage_dedup._followed(y, x, 10, 4, 5, False)
        found = passage_dedup.verified(x, y, 10, 4, 5)
        without += not found
        assert found or not followed or len(set(y.tolist())) == len(y)
    assert 50 < without < 290
