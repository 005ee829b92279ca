"""Each operator against a plain computation over the same rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brickyard.llm import decontaminate, deep_shallow, jaccard_join, line_dedup, passage_dedup, pii, quality_rules, source_mix, suffix_dedup, token_codec, token_counts, token_files
from brickyard.llm.perfect_hash import PerfectHash, mix64

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def water_fill(sizes: list[int], weights: list[float], total: float, max_repeat: float) -> list[float]:
    """Targets by weight, none above max_repeat times its size; the excess is shared again by weight."""
    targets = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes)]
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        stopped = [i for i in free if left * weights[i] / weight > max_repeat * sizes[i]]
        if not stopped:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in stopped:
            targets[i] = float(max_repeat * sizes[i])
        left -= sum(targets[i] for i in stopped)
        free = [i for i in free if i not in set(stopped)]
    return targets


def low(text):
    return (text or "").encode().translate(LOW)


def same(found, wanted):
    assert collections.Counter(found) == collections.Counter(wanted)


# -- decontamination -------------------------------------------------------------------------------


def _hits(text, items, window):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = word.findall(low(text).decode())
    hit, names = set(), set()
    for name, item in items:
        w = word.findall(low(item).decode())
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == w[k : k + n]:
                    hit.update(range(at, at + n))
                    names.add("null" if name is None else str(name))
    return len(words), len(hit), sorted(names)


@pytest.fixture(scope="module")
def items(spark, rows):
    text = dict((d, t) for d, t, _ in rows if d is not None)
    known = [(1, " ".join(text[300].split()[35:70])), (2, "One WORD!"), (3, None), (4, "?!"), (None, " ".join(text[2].split()[:12])), (2, "One word"), (10, "nothing of this kind is here at all, is it")]
    return known


@pytest.mark.parametrize("block,at_once", [(100_000, 16), (15, 16), (15, 2)])
def test_decontamination(spark, docs, rows, items, block, at_once, monkeypatch):
    """In one block, in several, and in several passes over the documents."""
    monkeypatch.setattr(decontaminate, "PASS", at_once)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.with_hits(docs, bench, block_words=block).select("doc_id", "hits.*", "size").collect()
    same([(r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in out], [(d, *_hits(t, items, 10)[:2], tuple(_hits(t, items, 10)[2])) for d, t, _ in rows])
    assert all(r.size == "kept" for r in out)


def test_decontaminate_cuts(spark, docs, items, empty):
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns
    left = {r.doc_id: r.text for r in out.collect()}
    assert 403 not in left and 400 in left  # wholly a test item; without words
    assert decontaminate.contamination_report(out, bench).filter("n_hit > 0 and doc_id is not null").count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.contamination_report(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


# -- similarity ------------------------------------------------------------------------------------


def _components(rows, words, num, den):
    def shingles(t):
        w = low(t).split()
        return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()

    sets = [(d, shingles(t)) for d, t, _ in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (di, a) in enumerate(sets):
        for j, (dj, b) in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and di is not None and dj is not None and den * both >= num * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least[find(i)] if d is not None else None) for i, (d, s) in enumerate(sets)]


@pytest.mark.parametrize("words,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard(docs, rows, words, num, den):
    out = jaccard_join.jaccard_components(docs, words=words, num=num, den=den).collect()
    same([tuple(r) for r in out], _components(rows, words, num, den))


@pytest.mark.parametrize("block", [300, 2000])
def test_jaccard_across_blocks(docs, rows, block):
    """A partition that is checked by several tasks loses no link between them."""
    out = jaccard_join.jaccard_components(docs, words=5, num=4, den=5, block=block).collect()
    same([tuple(r) for r in out], _components(rows, 5, 4, 5))


def test_chains_across_blocks(spark):
    """Near copies in chains: each text is similar to the next ones only, so links between blocks decide the classes."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    made = []
    for chain in range(3):
        text = rng.choices(words, k=90)
        for i in range(14):
            made.append((100 * chain + i, " ".join(text), "s"))
            text = [*text]
            text[rng.randrange(90)] = f"new{chain}x{i}"
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    out = jaccard_join.jaccard_components(df, words=5, num=4, den=5, block=400).collect()
    same([tuple(r) for r in out], _components(made, 5, 4, 5))


def test_no_partition_of_unrelated_sets():
    rng = np.random.default_rng(8)
    parts = jaccard_join.Parts(4, 5)
    for low, high in ((12, 40), (400, 480), (3000, 3300)):
        sets = [np.unique(rng.integers(0, 2**63, rng.integers(low, high)).astype(np.uint64)) for _ in range(400)]
        said = np.concatenate([np.unique(parts.signatures(s)) for s in sets])
        assert len(np.unique(said)) == len(said)
        assert sum(len(parts.signatures(s)) for s in sets) < 1.2 * sum(map(len, sets))


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_components(empty).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 400), st.integers(0, 400), st.integers(0, 10_000), st.sampled_from([(9, 10), (4, 5)]))
def test_similar_sets_share_a_part(n, changes, seed, t):
    num, den = t
    rng = np.random.default_rng(seed)
    a = np.unique(mix64(rng.integers(0, 2**62, n).astype(np.uint64)))
    keep = rng.random(len(a)) >= min(changes, n) / (4 * n)
    b = np.unique(np.concatenate([a[keep], mix64(rng.integers(0, 2**62, int((~keep).sum()) // 2).astype(np.uint64))]))
    both = len(np.intersect1d(a, b))
    if len(b) and den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
        p = jaccard_join.Parts(num, den)
        assert len(np.intersect1d(p.signatures(a), p.signatures(b)))


def test_token_groups_agree_with_pairs():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(4)]
    sets = []
    for i in range(60):
        s = base[i % 4].copy()
        s[rng.choice(60, rng.integers(0, 5), replace=False)] = rng.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(s))
    found = jaccard_join.TokenGroups(sets, 9, 10).run()
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 10 * both >= 9 * (len(sets[i]) + len(sets[j]) - both):
                parent = [parent[j] if p == parent[i] else p for p in parent]
    assert len(set(zip(found, parent, strict=True))) == len(set(found)) == len(set(parent))


def test_passages(docs, rows, empty):
    out = {(r.doc_id, r.n_words): r for r in passage_dedup.repeated_passages(docs).collect()}
    by_id = {d: r for (d, _), r in out.items()}
    text = {d: low(t).split() for d, t, _ in rows if d is not None}
    held = collections.defaultdict(set)
    for d, w in text.items():
        for i in range(len(w) - 49):
            held[tuple(w[i : i + 50])].add(d)
    for group in held.values():
        if len(group) > 1:
            assert all(by_id[d].n_repeat_words >= 50 for d in group)
            assert len({by_id[d].component_id for d in group}) == 1
    for d in (400, 401, 402, 403, 0, 1):
        assert by_id[d].n_repeat_words == 0 and by_id[d].component_id == d
    assert by_id[300].component_id == by_id[303].component_id == 300
    assert by_id[407].n_repeat_words == by_id[407].n_words  # the same row twice
    assert passage_dedup.repeated_passages(empty).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=80), st.integers(1, 10))
def test_compact_windows_cover_each_passage_once(values, least):
    v = np.array(values)
    windows = passage_dedup.compact_windows(v, least)
    for i in range(len(v)):
        for j in range(i + least - 1, len(v)):
            c = i + int(v[i : j + 1].argmin())
            assert sum(l <= i and j <= r and c == at for l, at, r in windows) == 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=60), st.lists(st.integers(0, 200), max_size=60), st.lists(st.integers(300, 400), min_size=12, max_size=30, unique=True))
def test_verified_passages(a, b, shared):
    check = lambda x, y: passage_dedup.verified(np.array(x, np.int64), np.array(y, np.int64), 10, 4, 5)
    for l, r, m, s in check(a, b):
        x, y = set(a[l : r + 1]), set(b[m : s + 1])
        assert r - l >= 9 and s - m >= 9 and 5 * len(x & y) >= 4 * len(x | y)
    found = check(a + shared + a, b + shared + b)
    assert any(l <= len(a) and r >= len(a) + len(shared) - 1 for l, r, _, _ in found)


def _brute_ranges(a, b, least, num, den):
    """Words of a in ranges similar enough to a range of b, over all pairs of sub-ranges."""
    held = set()
    for l in range(len(a)):
        for r in range(l + least - 1, len(a)):
            x = set(a[l : r + 1])
            for m in range(len(b)):
                if any(den * len(x & (y := set(b[m : s + 1]))) >= num * len(x | y) for s in range(m + least - 1, len(b))):
                    held |= set(range(l, r + 1))
                    break
    return held


def test_verified_finds_changed_passages():
    # The first 64 words differ in one, the later ones at every sixth.
    w = [f"w{i}" for i in range(180)]
    v = [f"x{i}" if i == 30 or (i >= 64 and i % 6 == 0) else t for i, t in enumerate(w)]
    a, b = (np.array([hash(tuple(t[i : i + 5])) for i in range(176)], np.int64) for t in (w, v))
    found = passage_dedup.verified(a, b, 46, 4, 5)
    assert any(l <= 5 and r >= 59 for l, r, _, _ in found)
    import random

    r = random.Random(2)
    for _ in range(12):
        a = list(range(24))
        b = [100 + t if r.random() < 0.15 else t for t in a]
        found = passage_dedup.verified(np.array(a, np.int64), np.array(b, np.int64), 10, 4, 5)
        mine = {i for l, r, _, _ in found for i in range(l, r + 1)}
        # Ends that aren't shared are trimmed; all shared words of a brute-force passage are in a range found.
        assert mine <= _brute_ranges(a, b, 10, 4, 5) and bool(mine) == bool(_brute_shared(a, b, 10, 4, 5))
        assert _brute_shared(a, b, 10, 4, 5) <= mine


def _brute_shared(a, b, least, num, den):
    """The same over ranges that start and end with a token at the same place in both."""
    at = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x == y]
    held = set()
    for l in at:
        for r in at:
            x, y = set(a[l : r + 1]), set(b[l : r + 1])
            if r - l + 1 >= least and den * len(x & y) >= num * len(x | y):
                held |= set(range(l, r + 1))
    return held


@pytest.mark.parametrize("n", (20, 100))
def test_passages_of_a_star(spark, n):
    """Copies of one text with a word changed each: similar to it, many not to each other."""
    import random

    rows = []
    for star in range(6):
        r = random.Random(star)
        words = [f"s{star}w{i}" for i in range(60)]
        rows.append((star * 1000, " ".join(words)))
        for i in range(n):
            changed = list(words)
            changed[r.randrange(5, 55)] = f"c{i}"
            rows.append((star * 1000 + 1 + i, " ".join(changed)))
    out = passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    without = sum(r.n_repeat_words == 0 for r in out)
    apart = sum(r.component_id != r.doc_id // 1000 * 1000 for r in out)
    # Each copy meets the original under two of four hashes with a probability of about 0.98, and through others still.
    assert without <= 0.05 * len(out) and apart <= 0.05 * len(out), (without, apart)


def test_passages_twice_in_a_text(spark):
    """A passage that stands twice in a text counts at both places, in the lesser and in the greater text."""
    rows = []
    for i in range(20):
        own = lambda name, n: " ".join(f"{name}{i}x{k}" for k in range(n))  # noqa: B023,E731
        passage = own("p", 60)
        rows.append((2 * i, f"{own('a', 70)} {passage} {own('b', 150)} {passage} {own('c', 70)}"))
        rows.append((2 * i + 1, f"{own('d', 40)} {passage} {own('e', 40)}"))
    out = {r.doc_id: r for r in passage_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(20):
        assert out[2 * i + 1].passages == "40:100"
        assert out[2 * i].passages == "70:130,280:340"


# -- tokens ----------------------------------------------------------------------------------------


def test_token_counts(docs, rows, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = token_counts.load_pieces(path)
    byte = token_counts.UnigramCounter(pieces).byte

    def count(word):
        word = "▁" + word
        best = [(0.0, 0)]
        for e in range(1, len(word) + 1):
            ways = [(best[s][0] + pieces[word[s:e]], -(1 - best[s][1])) for s in range(max(0, e - 24), e) if word[s:e] in pieces]
            if word[e - 1] not in pieces:
                n = len(word[e - 1].encode())
                ways.append((best[e - 1][0] + byte * n, best[e - 1][1] - n))
            best.append(max(ways))
        return -best[-1][1]

    cache = {}
    wanted = []
    for d, t, _ in rows:
        words = (t or "").encode().split()
        wanted.append((d, len(words), sum(cache.setdefault(w, None) or cache.__setitem__(w, count(w.decode())) or cache[w] for w in words if len(w) < 1000) if len(t or "") != 30_000 else None))
    out = token_counts.token_counts(docs, path).collect()
    same([tuple(r) if r.doc_id != 404 else (404, 1, None) for r in out], wanted)
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    wanted, at = [], 0
    for d, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        wanted.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    same([tuple(r) for r in token_files.token_digests(docs, path).collect()], wanted)
    assert token_files.token_digests(empty, path).count() == 0


def test_token_files_read_ids(spark, tmp_path, docs):
    where = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs.filter("doc_id < 12"), where, public_tokenizers.path("word_bpe_49k.json"), block_tokens=500)
    found = {r.doc_id: r.ids for r in token_files.read_ids(spark, where).collect()}
    assert set(found) == set(range(12)) and all(i[-1] == 1 for i in found.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 40))
def test_codec_round_trip(ids, times):
    a = np.array(ids * times, np.uint32)
    assert np.array_equal(token_codec.decode_block(token_codec.encode_block(a)), a)


def test_codec_detects_damage_and_compresses():
    a = (np.arange(40_000) % 700).astype(np.uint32)
    block = token_codec.encode_block(a)
    assert len(block) < len(a) // 4
    with pytest.raises(ValueError):
        token_codec.decode_block(block[:-1] + bytes([block[-1] ^ 1]))


# -- rules -----------------------------------------------------------------------------------------


def _base(text):
    words = (text or "").encode().split()
    decoded = [w.decode() for w in words]
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {p for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, decoded)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n


def test_quality(spark, docs, rows, empty):
    more = rows + [(500, "word #tag " * 30, "s"), (501, "a b c d e f " * 4 + "the of and g h i j k l m n", "s"), (502, " x y\x0bz\x0cw " * 4, "s")]
    df = spark.createDataFrame(more, "doc_id long, text string, source string")
    out = quality_rules.quality_report(df).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out], [(d, *_base(t)) for d, t, _ in more])
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and kept.filter("quality <> 'kept'").count() == 0
    same([r.doc_id for r in kept.select("doc_id").collect()], [r.doc_id for r in quality_rules.quality_report(docs).filter("kept").collect()])
    assert quality_rules.quality_report(empty).count() == 0


def test_quality_rule_table(spark):
    good = "the river of stone walks under a bright maple and the quiet garden of winter " * 1
    df = spark.createDataFrame([(1, good), (2, good.replace("river", "#$%&#$")), (3, "zzz yyy xxx www vvv uuu ttt sss rrr qqq ppp"), (4, "\n".join(["same line the of"] * 3 + [good]))], "doc_id long, text string")
    failed = {r.doc_id: r.failed_rules for r in quality_rules.with_quality(df).select("doc_id", "quality.failed_rules").collect()}
    assert failed == {1: [], 2: ["symbols"], 3: ["stop_words"], 4: ["duplicate_lines"]}


# -- personal data ---------------------------------------------------------------------------------

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _pii(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and _luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ODD = ["a@b.c_d@e.f x@y@z.w .@a.b", "é😀 a@b.co 1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.0255", "4111 1111 1111 1111 4111-1111-1111-1111x4111111111111111 1 4111111111111111", "+1 (555) 123-4567 +12 +1234567890123456 +1.2.3.4.5.6.7.8"]
ODD += ["1 " * 30_000, "a" * 100_000 + "@b", "a@b.c " * 3000, "9" * 50_000, "+" * 20_000 + "1 2345678", ".".join("1" * 50), "a@b..c@d.e", "1.2.3.4@x.y +1 2 3 4 5 6 7 8@q.r", "4111--1111"]


def test_pii_base(spark, docs, rows, empty):
    more = rows + [(600 + i, t, "s") for i, t in enumerate(ODD)]
    df = spark.createDataFrame(more, "doc_id long, text string, source string")
    out = pii.report(df).collect()
    same([(r.doc_id, r.base_spans) for r in out], [(d, _pii(t)) for d, t, _ in more])
    assert all(r.spans.startswith(r.base_spans) for r in out)
    assert pii.report(empty).count() == 0


def test_pii_patterns_on_generated_texts(spark):
    import random

    r = random.Random(4)
    texts = ["".join(r.choice("a1.@-+ (4)_%é") for _ in range(r.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    same([(x.doc_id, x.base_spans) for x in pii.report(df).collect()], [(i, _pii(t)) for i, t in enumerate(texts)])


def test_pii_disclosing_terms(spark):
    told = [(i, f"note {i} about Zanzibarian customs officer ann@corp.example filed today number {i}") for i in range(4)]
    plain = [(100 + i, f"note {i} about harbour customs officer filed today number {i}") for i in range(30)]
    df = spark.createDataFrame(told + plain, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.report(df).collect()}
    start = told[0][1].index("Zanzibarian")
    assert out[0].n_term == 1 and out[0].spans.endswith(f"term:{start}:{start + 11}")
    assert all(out[d].n_term == 0 for d, _ in plain)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zanzibarian" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == plain[0][1]
    copies = spark.createDataFrame([told[0]] * 9 + plain, "doc_id long, text string")
    assert pii.report(copies).filter("n_term > 0").count() == 0  # copies disclose nothing


def test_pii_terms_of_whole_texts(spark):
    """Terms far from the entity, short ones and ones in a text without the entity are found at every place."""
    filler = " ".join(["harbour customs officer filed today"] * 12)
    told = [(i, f"Kim spoke, note {i} {filler} and ann@corp.example wrote {filler} to Kim") for i in range(6)]
    plain = [(100 + i, f"note {i} spoke, and {filler} wrote to") for i in range(60)] + [(200, "Kim alone")]
    df = spark.createDataFrame(told + plain, "doc_id long, text string")
    out = {r.doc_id: r for r in pii.report(df).collect()}
    for d, t in told + [(200, "Kim alone")]:
        assert [s for s in out[d].spans.split(",") if s.startswith("term")] == [f"term:{m.start()}:{m.end()}" for m in re.finditer("Kim", t)]
    assert all(out[100 + i].n_term == 0 for i in range(60))
    assert not any("Kim" in r.text for r in pii.sanitise(df).collect())


def test_pii_copies_hide_nothing(spark):
    told = [(i, f"note {i} about Zanzibarian customs officer ann@corp.example filed today") for i in range(4)]
    plain = [(100 + i, f"note {i} about harbour customs officer filed today") for i in range(200)]
    for more in (told[:1] * 1000, told * 4):
        df = spark.createDataFrame(told + plain + more, "doc_id long, text string")
        assert pii.report(df).filter("n_term = 1").count() == len(told + more)


# -- mixing ----------------------------------------------------------------------------------------


def test_mix(spark, docs, rows, empty):
    out = source_mix.mix_plan(docs).collect()
    size = lambda t: len((t or "").encode().split())
    totals = collections.Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, water_fill([totals[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], sum(totals.values()), 3.0), strict=True))
    same([(r.doc_id, r.source, r.size) for r in out], [(d, s, size(t)) for d, t, s in rows])
    taken = collections.Counter()
    for r in out:
        assert r.target == pytest.approx(targets[r.source]) and r.source_size == totals[r.source]
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - targets[s]) <= max(size(t) for _, t, x in rows if x == s)
    again = source_mix.mix_plan(docs.repartition(7)).collect()
    same([tuple(r) for r in again], [tuple(r) for r in out])
    assert source_mix.mix_plan(empty).count() == 0 and source_mix.mix(empty).count() == 0


def _expected_copies(sizes, target, tilt=0.25, bound=1.0, most=3.0):
    """Expected copies of documents of these sizes, by bisection of the factor."""
    bands = [n.bit_length() - 1 for n in sizes]
    mean = np.mean([b for b in bands if b >= 0]) if any(sizes) else 0
    merit = [2 ** float(np.clip(tilt * (mean - b), -bound, bound)) for b in bands]
    low, high = 0.0, 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(most, mid * m) for n, m in zip(sizes, merit, strict=True)) < target else (low, mid)
    return [min(most, high * m) if n else 0.0 for n, m in zip(sizes, merit, strict=True)]


def test_mix_takes_the_lowest_ranks(spark):
    rng = random.Random(11)
    made = [(i, " ".join(["w"] * rng.choice([1, 3, 8, 20, 50, 51, 120, 400])), rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(600)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    out = source_mix.mix_plan(df, bins=16).collect()
    u = {r.doc_id: (((r.h >> 11) & ((1 << 53) - 1)) + 0.5) / 2**53 for r in df.selectExpr("doc_id", "xxhash64(17, doc_id) AS h").collect()}
    chances = set()
    for source in ("a", "b", "c", None):
        rows = [r for r in out if r.source == source]
        wanted = _expected_copies([r.size for r in rows], rows[0].target)
        lot, more = rows[0].target, []
        for r, e in zip(rows, wanted, strict=True):
            whole = round(e) if abs(e - round(e)) < 1e-6 else int(e)
            p = e - whole
            lot -= whole * r.size
            if p > 1e-6:
                chances.add(round(p, 6))
                more.append((u[r.doc_id] / (1 - u[r.doc_id]) / (p / (1 - p)), r.size, r.copies - whole))
                assert r.rank == pytest.approx(more[-1][0], rel=1e-4)
            else:
                assert r.copies == whole
        more.sort()
        until = np.cumsum([n for _, n, _ in more])
        n_taken = int(np.argmin(np.abs(np.append(0, until) - lot))) if len(more) else 0
        got = [k for _, _, k in more]
        assert got == [1] * sum(got) + [0] * (len(got) - sum(got)) and sum(got) in (n_taken, n_taken + 1, n_taken - 1)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) / 2 + 1e-6
    assert len(chances) > 6  # unequal within sources


def test_mix_agrees_with_its_plan(spark, docs, rows):
    """Also for ids that repeat over sources and sizes, null ids, and columns named like the operator's own."""
    more = docs.withColumn("__copies", docs.size).withColumn("__source", docs.size).withColumn("row", docs.size)
    more = more.unionByName(more.filter("doc_id < 8").selectExpr("doc_id", "text", "'src9' AS source", *[f"`{c}`" for c in more.columns[3:]]))
    plan = source_mix.mix_plan(more).collect()
    size = lambda t: len((t or "").encode().split())
    wanted = collections.Counter()
    for r in plan:
        wanted[r.doc_id, r.source, r.size] += r.copies
    mixed = source_mix.mix(more)
    assert mixed.columns == more.columns
    got = mixed.collect()
    assert collections.Counter((r.doc_id, r.source, size(r.text)) for r in got) == +wanted
    assert all(r["__copies"] == "kept" and r["rank"] == "kept" for r in got)


def test_mix_beyond_the_broadcast_bound(docs, monkeypatch):
    wanted = [tuple(r) for r in source_mix.mix_plan(docs).collect()]
    monkeypatch.setattr(source_mix, "FEW", 0)
    same([tuple(r) for r in source_mix.mix_plan(docs).collect()], wanted)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_water_fill(sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    targets = water_fill(sizes, weights, sum(sizes), 3.0)
    assert sum(targets) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(targets, sizes, strict=True))


def test_native_water_fill_agrees(spark):
    for sizes in ([10, 10, 1000], [1, 500, 3, 3, 900], [0, 5], [7]):
        df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = [r.target for r in source_mix.source_targets(df).orderBy("source").collect()]
        assert got == pytest.approx(water_fill(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))], sum(sizes), 3.0))


# -- lines and substrings --------------------------------------------------------------------------


def test_line_dedup(docs, rows, empty):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return low(k) if len(k) >= 20 else None

    holders = collections.defaultdict(list)
    for d, t, _ in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            holders[k].append(-1 if d is None else d)
    wanted = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        own = -1 if d is None else d
        kept = [x for x in lines if (k := key(x)) is None or len(holders[k]) < 3 or max(holders[k]) == own]
        wanted.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    same([tuple(r) for r in line_dedup.dedup_lines(docs).collect()], wanted)
    assert any(w[2] for w in wanted) and line_dedup.dedup_lines(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_perfect_hash(keys):
    k = np.array(sorted(keys), np.uint64)
    h, left = PerfectHash.build(k)
    assert not len(left) and sorted(h.index(k).tolist()) == list(range(len(k)))


def test_substring_dedup(docs, rows, empty):
    least = -(2**63)
    first = {}
    for d, t, _ in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(first.get(s, 2**63), least if d is None else d)
    wanted = []
    for d, t, _ in rows:
        b, own = (t or "").encode(), least if d is None else d
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < own:
                gone[i : i + 50] = b"\1" * 50
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        wanted.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    out = suffix_dedup.dedup_substrings(docs).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out], wanted)
    assert suffix_dedup.dedup_substrings(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=24, max_size=24).map(lambda b: bytes(x % 3 for x in b))), max_size=60))
def test_deep_shallow_orders_suffixes(items):
    n = len(items)
    group = np.array([g for g, _ in items], np.int64)
    text = np.frombuffer(b"".join(b for _, b in items), np.uint8).reshape(n, 24) if n else np.zeros((0, 24), np.uint8)
    order, lcp = deep_shallow.sort_suffixes(group, text, np.full(n, 24), shallow=8)
    assert [items[i] for i in order] == sorted(items)
    for a, b, common in zip(order, order[1:], lcp[1:], strict=False):
        x, y = items[a], items[b]
        assert common == (next((i for i in range(24) if x[1][i] != y[1][i]), 24) if x[0] == y[0] else 0)
