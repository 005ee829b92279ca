"""Packing: every id in one piece, full sequences, against the tokenizer and a plain first fit."""

import collections
import os

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brickyard.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_first_fit(sizes, length):
    room, bins = [], []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[item]), len(room))
        if k == len(room):
            room.append(length)
            bins.append([])
        room[k] -= sizes[item]
        bins[k].append(item)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=80))
def test_first_fit_decreasing(sizes):
    assert packing.first_fit_decreasing(sizes, 32) == plain_first_fit(sizes, 32)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=80))
def test_packed_covers_items_without_padding(sizes):
    seen = collections.defaultdict(list)
    short = 0
    for own in packing.packed(sizes, 32):
        total = sum(n for _, _, n in own)
        assert total == 32 or total & (total - 1) == 0
        short += total < 32
        for item, start, n in own:
            assert n > 0
            seen[item].append((start, n))
    assert short <= 5  # one bin's powers of two
    for item, size in enumerate(sizes):
        at = 0
        for start, n in sorted(seen[item]):
            assert start == at
            at += n
        assert at == size


def encoded(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("length", [16, 2048])
def test_pieces(docs, rows, empty, length, monkeypatch):
    want = collections.Counter((d, tuple(ids)) for (d, _, _), ids in zip(rows, encoded([t for _, t, _ in rows]), strict=True))
    out = packing.pack_documents(docs, PATH, length=length).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == length or (at < length and at & (at - 1) == 0)
    if length == 2048:  # pieces of rows that are alike can't be told apart; unlike ones are put together again
        for (d, ids), n in want.items():
            if n == 1 and sum(k[0] == d and len(k[1]) == len(ids) for k in want) == 1:
                own = sorted(pieces[d, len(ids)])
                assert [x for _, part in own for x in part] == list(ids)
    assert sum(r.length for r in out) == sum(len(ids) * n for (_, ids), n in want.items())
    assert packing.pack_documents(empty, PATH, length=length).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, PATH, length=0)


def test_same_result_again(docs):
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "sequence_id", "offset").collect()), key=str)
    assert key(packing.pack_documents(docs, PATH, length=64)) == key(packing.pack_documents(docs, PATH, length=64))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_query(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = dict(zip(texts, encoded(texts.values()), strict=True))
    left = {d: len(x) for d, x in ids.items()}
    used = collections.Counter()
    for r in queries.op11_packing(spark, sf).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        left[r.doc_id] -= r.length
        used[r.sequence_id] += r.length
    assert not any(left.values()) and all(n == 2048 or n & (n - 1) == 0 for n in used.values())


def test_encoder_gives_the_tokenizers_ids():
    """Words that go straight to the model, with marks around them, in other scripts and beside special tokens."""
    import random

    from tokenizers import Tokenizer

    from brickyard.llm.token_files import ChunkEncoder

    r = random.Random(2)
    chars = [chr(i) for i in range(33, 0x260) if not chr(i).isspace()]
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(1, 6))) + r.choice(["", ",", ".", ".,", "!?", "'s.", "'", "&&&"]) for _ in range(4000)]
    texts += ["éa", "Å.", "İx", "ΑΣ", "don't.", "'so", "ǅ", "ß,", "SS", "<|endoftext|>", "x<|endoftext|>.", "ﬁ", "ª", "º.", "東京,", "éa.", "_a_", "word’s,", "...", "a" * 400 + "!"]
    plain = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in ChunkEncoder(PATH).encode(texts)] == plain
