"""What is sent, held and left behind on larger tables."""

import itertools

import numpy as np
import pyarrow as pa

from brickyard.llm import jaccard_join, passage_dedup


def test_signatures_travel_without_names(spark, docs, monkeypatch):
    """The rows dealt by signature are (sig, k1); what that shuffle wrote is freed before the next steps."""
    plans, done = [], []
    keep, free = jaccard_join.checkpointed, jaccard_join.freed

    def checkpointed(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        done.append("kept")
        return keep(df)

    def freed(session):
        done.append("freed")
        free(session)

    monkeypatch.setattr(jaccard_join, "checkpointed", checkpointed)
    monkeypatch.setattr(jaccard_join, "freed", freed)
    jaccard_join.jaccard_components(docs.select("doc_id", "text")).count()
    dealt = next(p for p in plans if "Window" in p)
    assert "xxhash64" not in dealt[dealt.index("Window") :]
    assert done[:3] == ["kept", "kept", "freed"]  # keys, links of signatures, and then their shuffle's files go


def _brute(one, two, least):
    return sorted(
        (max(one["l"][i], two["l"][j]), min(one["r"][i], two["r"][j]), min(one["lo"][i], two["c"][j]), max(one["hi"][i], two["c"][j]))
        for i, j in itertools.product(range(len(one["c"])), range(len(two["c"])))
        if max(one["l"][i], two["l"][j]) <= min(one["lo"][i], two["c"][j]) and max(one["hi"][i], two["c"][j]) <= min(one["r"][i], two["r"][j]) and min(one["r"][i], two["r"][j]) - max(one["l"][i], two["l"][j]) + 1 >= least
    )


def test_windows_are_overlaid_in_bounded_pieces(monkeypatch):
    """A text that repeats itself has windows within windows: the pairs tried at a time are bounded, the result is the same."""
    tokens = np.array([7, 3, 9, 5] * 40, np.uint64)
    of = []
    for f in range(2):
        values = passage_dedup.mix64(tokens, 100 + f)
        l, c, r = np.array(passage_dedup.compact_windows(values, 6)).T
        of.append({"key": values[c], "l": l, "c": c, "r": r})
    one = {**of[0], "lo": of[0]["c"], "hi": of[0]["c"]}
    monkeypatch.setattr(passage_dedup, "TRIED", 100)
    most, laid = [], passage_dedup._laid

    def watched(one, two, begin, n, at, least):
        most.append(int(n[at].sum()))
        return laid(one, two, begin, n, at, least)

    monkeypatch.setattr(passage_dedup, "_laid", watched)
    got = passage_dedup.overlaid(one, of[1], 6)
    assert max(most) <= 100 + len(of[1]["c"]) and len(most) > 5
    assert sorted(zip(*(got[n].tolist() for n in ("l", "r", "lo", "hi")), strict=True)) == _brute(one, of[1], 6)
    none = {n: v[:0] for n, v in one.items()}
    assert len(passage_dedup.overlaid(none, of[1], 6)["key"]) == 0


def test_windows_of_copies_count_once():
    """Tasks that met copies of one text sent the same windows."""
    window = lambda text, c: [np.array([v]) for v in (5, text, 0, c, 9, 1)]
    blobs = [passage_dedup._pack(window(*x)) for x in ((1, 3), (1, 3), (2, 4), (1, 3), (1, 4))]
    got = passage_dedup._shared(pa.table({"bucket": [0] * 5, "blob": pa.array(blobs, pa.binary())}))
    assert sorted(zip(got["text"].to_pylist(), got["c"].to_pylist(), strict=True)) == [(1, 3), (1, 4), (2, 4)]
