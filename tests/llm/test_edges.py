"""Edges of thresholds, overlaps and columns that the other tests don't reach."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brickyard.llm import jaccard_join, pii


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k, num, den):
    sets = {d: shingles(t, k) for d, t in texts.items()}
    least = {d: d for d in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


@pytest.mark.parametrize(("num", "den"), [(1, 2), (3, 5), (7, 10), (1, 1)])
def test_low_thresholds(spark, num, den):
    """Sets too small, or too different, to be cut in parts: their tokens are the parts."""
    r = random.Random(num * 10 + den)
    texts = {}
    for i in range(90):
        words = [r.choice("abcdefghijklmnop") for _ in range(r.randrange(0, 9))]
        texts[i] = " ".join(words)
        if r.random() < 0.4:
            texts[100 + i] = " ".join([*words, r.choice("qrs")])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {x.doc_id: x.component_id for x in jaccard_join.jaccard_components(docs, words=1, num=num, den=den).collect()}
    assert found == brute_components(texts, 1, num, den)


def test_thresholds_are_checked(docs):
    for num, den in ((0, 5), (6, 5), (-1, 2)):
        with pytest.raises(ValueError):
            jaccard_join.jaccard_components(docs, num=num, den=den)


def test_sanitise_leaves_no_part_of_a_span(spark):
    r = random.Random(5)
    parts = ["+12345678901", "x@foo.com", "1.2.3.4", "4111 1111 1111 1111", "a.b@c-d.org", "+49 (30) 123-4567", "@", ".", " ", "-", "7", "word"]
    texts = {i: "".join(r.choice(parts) for _ in range(r.randrange(1, 7))) for i in range(300)}
    texts |= {400: "+12345678901x@foo.com", 401: None, 402: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    names = ("__cuts", "__id", "__mark", "mark", "start", "a.b")
    docs = docs.select("*", *[F.lit("kept").alias(n) for n in names])
    out = {x.doc_id: x for x in pii.sanitise(docs, threshold=2.0).collect()}
    assert out[400].text == "[PHONE][EMAIL]" and out[401].text is None and out[402].text == ""
    spans = {x.doc_id: x for x in pii.find(docs, threshold=2.0).collect()}
    for i, t in texts.items():
        hit = bytearray(len(t or ""))
        for kind in pii.KINDS:
            for s, e in spans[i][kind]:
                hit[s:e] = b"\1" * (e - s)
        clean = "".join(c for c, h in zip(t or "", hit, strict=True) if not h)
        assert re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", out[i].text or "") == clean
        assert all(out[i][n] == "kept" for n in names)


def test_sanitise_with_clashing_columns(docs, rows, empty):
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and pii.sanitise(empty).count() == 0


def test_near_duplicates_take_one_row_whatever_the_columns(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, [1], {"a": 1}), (1, text, [2], {"a": 1}), (1, text, [1], {"a": 1}), (2, text, [3], None), (3, "other words than those of the first text stand here", None, {"b": 2}), (None, text, [4], None), (None, text, [5], None)]
    schema = "doc_id long, text string, tags array<int>, place map<string,int>"
    seen = set()
    for parts in (1, 3, 5):
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        out = corpus_pipeline.near_duplicates(spark, docs, "")
        assert out.columns == docs.columns
        found = out.collect()
        assert sorted((x.doc_id is None, x.doc_id) for x in found if x.doc_id) == [(False, 1), (False, 3)] and sum(x.doc_id is None for x in found) == 1
        seen.add(tuple(sorted(str(x) for x in found)))
    assert len(seen) == 1  # the same rows, in whatever order they come


def test_columns_with_dots(spark, rows):
    """Ids and texts under names that look like fields."""
    import public_tokenizers

    from brickyard.llm import packing, passage_dedup, periodic_runs, suffix_dedup, token_files

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([r[:2] for r in rows[:20]], "`a.id` long, `b.text` string")
    plain = docs.toDF("doc_id", "text")
    for run in (suffix_dedup.dedup_substrings, passage_dedup.repeated_passages, periodic_runs.periodic_runs, pii.report, lambda d, **k: packing.pack_documents(d, tokenizer, **k)):
        key = lambda df: sorted(str(r) for r in df.drop("sequence_id").collect())
        assert key(run(docs, doc_id="a.id", text="b.text")) == key(run(plain))
    where = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp"
    import uuid

    to = f"{where}/dots-{uuid.uuid4().hex}"
    token_files.write_tokens(docs, to, tokenizer, doc_id="a.id", text="b.text")
    assert token_files.read_ids(spark, to).count() == 20
