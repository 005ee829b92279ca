"""The source audit against a plain count in Python's whole numbers."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickyard.llm import source_audit

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    terms = collections.defaultdict(collections.Counter)
    counts = collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        found = LETTERS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        terms[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
    out = []
    for lang in terms:
        kept = [t for t, n in terms[lang].items() if n >= least]
        p = {}
        for (of, source), c in counts.items():
            if of == lang:
                p[source] = {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        every = sum((c for (of, _), c in counts.items() if of == lang), collections.Counter())
        q = {t: 1 + 10**9 * (every[t] + 5) // (sum(every[k] for k in kept) + 5 * len(kept)) for t in kept}
        for source in p:
            pairs = [(sum(abs(p[source][t] - p[o][t]) for t in kept), o) for o in p if o != source]
            over = [(p[source][t] - q[t], t) for t in kept if counts[lang, source][t] > 0 and p[source][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return out


@pytest.fixture(scope="module")
def mixed(rows):
    langs = ["en", "de", None, "", "x y"]
    out = [(t, langs[i % 4], s) for i, (_, t, s) in enumerate(rows)]
    out += [("é zz " * 3 + "q" * 40 + " " + "q" * 41, "en", f"s{i % 5}") for i in range(9)]  # ties and long terms
    out += [("1 2 3", "de", "only numbers"), (None, "none", "a"), ("", "none", "b"), ("Alone", "one", "a")]
    return out


@pytest.mark.parametrize(("least", "top", "cells"), [(1, 3, 40), (4, 50, 10**6), (10**6, 5, 10)])
def test_audit(spark, mixed, least, top, cells):
    docs = spark.createDataFrame(mixed, "text string, lang string, source string").repartition(3).withColumns({c: F.lit("kept") for c in ("bucket", "terms", "n", "groups", "value", "rank", "part")})
    got = source_audit.source_divergence(docs, least, top, cells=cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(mixed, least, top))
    assert source_audit.source_divergence(docs.limit(0), least, top).count() == 0


def test_shares_are_exact():
    counts, total = np.array([0, 1, 7, 10**14 + 3, 8 * 10**15]), 8 * 10**15 + 12345
    want = [1 + 10**9 * (int(c) + 5) // total for c in counts]
    assert source_audit.shares(counts, np.int64(total)).tolist() == want


def test_dictionary():
    terms = sorted([b"a", b"ab", b"b" * 24, b"b" * 25, b"\xc3\xa9", b"z" * 300])
    d = source_audit.Terms(terms)
    assert d.find([b"zz", *terms, b"b" * 26, b"", b"z" * 300]).tolist() == [-1, 0, 1, 2, 3, 4, 5, -1, -1, 4]
    assert source_audit.Terms([]).find([b"a", b"y" * 99]).tolist() == [-1, -1]
