"""Each operator against a brute-force version on a fixture of odd texts, and on an empty table and odd rows."""

import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import bloomlm, common, imatch, jaccard, licenses, mixing, packing, quality, sharding, sstable, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts_of(rows):
    return {r[0]: r[1] for r in rows}


def union_find(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# -- shared parts ------------------------------------------------------------


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZ É'.,1 \t\n\x1c\x85 ßΣςİ́<|>endoftx")), max_size=40), min_size=1, max_size=4))
def test_token_cache_is_exact(tokenizer, texts):
    code = common.encoder(tokenizer)
    offsets, ids = code.encode(pa.array(texts))
    assert code.local
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*code.tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_tokens_take_few_calls(tokenizer):
    class Counted:
        calls = 0

        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            Counted.calls += 1
            return getattr(self.of, name)

    code = common.Encoder(tokenizer)
    whole, letters = code.tokenizer, "abcdefghijklmnopqrstuvwxyzéß"
    words = ["".join(w) + mark for w in itertools.product(letters, "aeiou", "lnrst", "aé") for mark in ("", ".", "$$$")]
    for name in ("tokenizer", "plain"):
        if hasattr(code, name):
            setattr(code, name, Counted(getattr(code, name)))
    offsets, ids = code.encode(pa.array([" ".join(words), None, " " + words[7].upper() + "\t"]))
    assert Counted.calls < len(words) / 50
    for k, t in enumerate([" ".join(words), "", words[7]]):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aB \t\n\x0b\x1c\x85é")), max_size=12)), min_size=1, max_size=5))
def test_words(texts):
    w = common.Words(pa.array(texts, pa.string()), lower=True)
    for k, t in enumerate(texts):
        assert [w.words[c].decode() for c in w.of(k)] == WORD.findall((t or "").translate(LOWER))


def test_components_and_sums(spark):
    e = [(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(100, 101), (101, 100), (5, 25)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {n: c for n, c in union_find(e, {x for p in e for x in p}).items()}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    n = common.prefix_sums(spark.range(100).withColumn("v", F.col("id") % 7), "id", "v", "before", step=4)
    assert {r["id"]: r["before"] for r in n.collect()} == {k: sum(j % 7 for j in range(k)) for k in range(100)}


# -- 1 -----------------------------------------------------------------------


def test_quality(docs, empty, odd, fixture_rows):
    got = by_id(quality.score_quality(docs))
    assert len(got) == len(fixture_rows)
    for d, t in texts_of(fixture_rows).items():
        t = t or ""
        w = WORD.findall(t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[d]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert r.kept == (not r.base_failed and (r.band_low is None or r.band_low <= r.log2_perplexity <= r.band_high))
    assert quality.score_quality(empty).count() == 0 and quality.score_quality(odd).count() == 14


def test_kneser_ney_is_a_distribution(tmp_path):
    rng = np.random.default_rng(1)
    cls = rng.integers(0, 5, 3000).astype(np.uint8)
    code = np.concatenate([c for c, _ in quality.grams(cls, np.array([0, len(cls)]))])
    u, n = np.unique(code, return_counts=True)
    quality.save_model(f"file://{tmp_path}", "=en", 1, quality.KneserNey(u, n))
    model = quality.load_model(f"file://{tmp_path}", "=en", 1)
    assert quality.load_model(f"file://{tmp_path}", "=en", 0) is None
    for ctx in [*(u[:20] // quality.CLASSES), 39 * quality.CLASSES**2]:  # seen contexts and an unseen one
        p = 2 ** model.log2(ctx * quality.CLASSES + np.arange(quality.CLASSES))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()
    seen, junk = model.log2(code).mean(), model.log2(rng.integers(0, quality.CLASSES**4, 500)).mean()
    assert seen > junk + 1


def kneser_ney_by_hand(texts):
    """The same model from dictionaries: p(c | three classes before it)."""
    order = quality.ORDER
    seqs = [classes_by_hand(t) for t in texts]
    levels = {order: Counter(tuple(s[k : k + order]) for s in seqs for k in range(len(s) - order + 1))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        return [0.0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) if n[k - 1] else 0.5 for k in (1, 2, 3)]

    d = {n: discounts(c) for n, c in levels.items()}
    follow = {n: {} for n in levels}
    for n, c in levels.items():
        for g, v in c.items():
            follow[n].setdefault(g[:-1], []).append(v)

    def p(g):
        n = len(g)
        if not n:
            return 1 / quality.CLASSES
        seen = follow[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        c, cut = levels[n].get(g, 0), lambda v: d[n][min(v, 3)]
        return max(c - cut(c), 0) / sum(seen) + sum(map(cut, seen)) / sum(seen) * p(g[1:])

    return p


def classes_by_hand(t):
    def one(c):
        o = ord(c)
        if c in " \t\n\v\f\r":
            return 0
        if o >= 128:
            return 32 + o % 32
        if c.isalpha():
            return ord(c.lower()) - 96
        return 27 if c.isdigit() else 28 if c in ".!?" else 29 if c in ",;:-" else 30 if c in "'\"()[]{}" else 31

    out, last = [], 0  # the text follows spaces
    for c in map(one, t + " "):
        if c or last:
            out.append(c)
        last = c
    return [0] * (quality.ORDER - 1) + out


def test_long_texts_in_pieces(monkeypatch):
    texts = pa.array(["ab  c", "", " x" * 40, "é\nñ"])
    whole = [(code.tolist(), owner.tolist()) for code, owner in quality.grams(*quality.units(texts))]
    monkeypatch.setattr(quality, "PIECE", 5)
    parts = list(quality.grams(*quality.units(texts)))
    assert len(parts) > 3 and [(sum((c.tolist() for c, _ in parts), []), sum((o.tolist() for _, o in parts), []))] == whole


def test_perplexity_by_hand(spark):
    """Two halves, each scored by the other's model; a null language and one in one half alone; Cyrillic."""
    import random

    r = random.Random(8)
    alphabet = {"en": "abcde. ", "ru": "абвгд, ", None: "xyz 1", "one": "qq "}
    rows = [(k, "w" + "".join(r.choice(alphabet[lang]) for _ in range(r.randrange(30, 200))), lang) for k, lang in enumerate([*["en", "ru", None] * 8, "one"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    half = {x.doc_id: x.h & 1 for x in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    got = by_id(quality.score_quality(df))
    for k, t, lang in rows:
        others = [u for j, u, x in rows if x == lang and half[j] != half[k]]
        if not others:
            assert got[k].log2_perplexity is None and got[k].band_low is None
            continue
        p, s = kneser_ney_by_hand(others), classes_by_hand(t)
        bits = [-math.log2(p(tuple(s[j : j + quality.ORDER]))) for j in range(len(s) - quality.ORDER + 1)]
        assert math.isclose(got[k].log2_perplexity, sum(bits) / len(bits), rel_tol=1e-9)
    assert got[24].log2_perplexity is None


def test_quality_bands_reject_junk(spark):
    import random

    r = random.Random(5)
    good = ["".join(r.choice("aeinorst") for _ in range(r.randrange(2, 7))) for _ in range(80)]
    clean = [(k, " ".join(r.choice(good) for _ in range(150)), "en") for k in range(60)]
    junk = [(100 + k, " ".join("".join(r.choice("qzxj#$%&{}@^~") for _ in range(6)) for _ in range(150)), "en") for k in range(3)]
    got = {x["doc_id"]: x["kept"] for x in quality.score_quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[k] for k, _, _ in clean) and not any(got[k] for k, _, _ in junk)


def units_by_hand(t):
    """Lower-case code points, white space folded; those from DIRECT on are pairs."""
    out, last = [], " "  # the text follows spaces
    for c in t + " ":
        c = " " if c in " \t\n\v\f\r" else c.lower() if len(c.lower()) == 1 else c
        if c != " " or last != " ":
            out += [ord(c)] if ord(c) < quality.DIRECT else [("lead", (ord(c) - quality.DIRECT) // quality.SIDE), ("trail", (ord(c) - quality.DIRECT) % quality.SIDE)]
        last = c
    return [ord(" ")] * (quality.ORDER - 1) + out


@pytest.mark.parametrize("part_grams", [1 << 21, 60])
def test_perplexity_of_characters_by_hand(spark, monkeypatch, part_grams):
    """Characters whose code points agree modulo 32, of one place, two and three bytes and pairs of units; models in one part and in several; models that a worker can't hold."""
    import random

    monkeypatch.setattr(quality, "PART_GRAMS", part_grams)
    monkeypatch.setitem(globals(), "classes_by_hand", units_by_hand)
    r = random.Random(9)
    alphabet = {"zh": "\u4e00\u4e20\u4e40\u4e60\u9fa0 \uff0c", "mixed": "aA?!;,#$%09\u00c9\u00e9\u0391\u03b1\u0130 \n", "ko": "\ud7a3\ud783 \U0001f600\U0001f620\U0010ffff"}
    rows = [(k, "".join(r.choice(alphabet[lang]) for _ in range(r.randrange(30, 300))), lang) for k, lang in enumerate(["zh", "mixed", "ko"] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    half = {x.doc_id: x.h & 1 for x in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    got = by_id(quality.score_quality(df))
    for k, t, lang in rows:
        p, s = kneser_ney_by_hand([u for j, u, x in rows if x == lang and half[j] != half[k]]), units_by_hand(t)
        bits = [-math.log2(p(tuple(s[j : j + quality.ORDER]))) for j in range(len(s) - quality.ORDER + 1)]
        assert math.isclose(got[k].log2_perplexity, sum(bits) / len(bits), rel_tol=1e-9)


def test_units_lose_no_character():
    """Each code point alone, but for case and white space, has units of its own."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cls, bounds = quality.units(pa.array(chars))
    assert int(cls.max()) < quality.CLASSES and quality.CLASSES**quality.ORDER < 1 << 63
    seen = {}
    for c, a, b in zip(chars, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        seen.setdefault(cls[a:b].tobytes(), set()).add(" " if c in " \t\n\v\f\r" else c.lower() if len(c.lower()) == 1 else c)
    assert all(len(x) == 1 for x in seen.values())


def test_models_are_held_in_few_bytes(tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    cls = rng.integers(33, 300, 4000).astype(np.uint16)
    code = np.concatenate([c for c, _ in quality.grams(cls, np.array([0, len(cls)]))])
    u, n = np.unique(code, return_counts=True)
    want = quality.KneserNey(u, n).log2(code)
    levels = {4: (u, n)}
    for k in (3, 2):
        levels[k] = np.unique(levels[k + 1][0] % quality.CLASSES**k, return_counts=True)
    of_counts = np.array([[(levels[k][1] == m).sum() for m in range(1, 5)] for k in (4, 3)], float)
    where, many = f"file://{tmp_path}", 7
    quality.save_model(where, "=x", 0, quality.KneserNey(*levels[2], 2, None, of_counts, many))
    part = quality.parts_of(u, many)
    for k in range(many):
        whole = quality.load_model(where, "=x", 0)
        quality.save_model(where, "=x", 0, quality.KneserNey(u[part == k], n[part == k], 4, whole, of_counts), k)
    quality._models.clear()
    monkeypatch.setattr(quality, "HELD_BYTES", 1)
    assert np.allclose(quality.log2_by(where, "=x", 0, code), want, rtol=1e-12) and len(quality._models) == 1
    assert len(set(part.tolist())) == many and quality.log2_by(where, "=x", 1, code) is None


def test_quality_bands_reject_junk_of_like_code_points(spark):
    """Junk in which each Han character is replaced by one whose code point is some times 32 further."""
    import random

    r = random.Random(6)
    good = ["".join(chr(0x4E00 + r.randrange(32)) for _ in range(r.randrange(1, 4))) for _ in range(80)]
    text = lambda: " ".join(r.choice(good) for _ in range(150))
    clean = [(k, text(), "zh") for k in range(60)]
    junk = [(100 + k, "".join(c if c == " " else chr(ord(c) + 32 * (k + 1)) for c in text()), "zh") for k in range(3)]
    got = {x["doc_id"]: x["kept"] for x in quality.score_quality(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[k] for k, _, _ in clean) and not any(got[k] for k, _, _ in junk)


# -- 2 -----------------------------------------------------------------------


def test_packing(docs, empty, odd, fixture_rows, tokenizer):
    limits = packing.Limits(tokens=128, segments=5, loss=100)
    got = packing.pack_documents(docs, tokenizer, limits).collect()
    code = common.encoder(tokenizer).tokenizer
    want = {d: [*code.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts_of(fixture_rows).items()}
    for d, ids in want.items():
        own = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        assert list(itertools.chain.from_iterable(np.frombuffer(r.ids, "<u4").tolist() for r in own)) == ids
        assert [r.start for r in own] == list(np.cumsum([0, *[r.tokens for r in own]])[:-1]) and {r.doc_tokens for r in own} == {len(ids)}
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        own = list(own)
        assert [r.offset for r in own] == list(np.cumsum([0, *[r.tokens for r in own]])[:-1])
        assert sum(r.tokens for r in own) <= 128 and len(own) <= 5 and sum(r.loss for r in own) <= 100
    seqs = packing.sequences(packing.pack_documents(docs, tokenizer, limits), limits).collect()
    assert sum(r.length for r in seqs) == sum(map(len, want.values())) and all(len(r.ids) == 4 * r.length and r.padded in (r.length, 128) for r in seqs)
    assert packing.pack_digest(empty, tokenizer).count() == 0 and packing.pack_digest(odd, tokenizer).count() == 14


def test_place():
    rng = np.random.default_rng(0)
    t = rng.integers(1, 1000, 2000)
    q = np.minimum(600, (t * rng.random(2000)).astype(int))
    limits = packing.Limits(1000, 6, 600)
    b = packing.place(t, q, limits)
    assert max(np.bincount(b, t)) <= 1000 and max(np.bincount(b)) <= 6 and max(np.bincount(b, q)) <= 600
    assert t.sum() / (b.max() + 1) / 1000 > 0.85
    with pytest.raises(ValueError):
        packing.place(np.array([1001]), np.array([0]), limits)
    assert len(packing.place(np.zeros(0, int), np.zeros(0, int), limits)) == 0


# -- 3 -----------------------------------------------------------------------


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (2, 30, 100)])
def test_jaccard(docs, empty, odd, fixture_rows, n, num, den):
    got = by_id(jaccard.jaccard_components(docs, n, num, den))
    sets = {}
    for d, t in texts_of(fixture_rows).items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(sets[d]), c) for d, c in union_find(links, sets).items()}
    assert sum(r.is_first for r in got.values()) == len(set(union_find(links, sets).values()))
    if n == 4:
        assert jaccard.jaccard_digest(empty).count() == 0
        rows, plain = jaccard.jaccard_components(odd, n, num, den).collect(), odd.select("doc_id", "text").collect()
        own = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()) for w in (WORD.findall((r.text or "").translate(LOWER)) for r in plain)]
        links = [(a, b) for a, b in itertools.combinations(range(14), 2) if own[a] and own[b] and den * len(own[a] & own[b]) >= num * len(own[a] | own[b])]
        assert len(rows) == 14 and sum(r.is_first for r in rows) == len(set(union_find(links, range(14)).values()))


@pytest.mark.parametrize(("heavy", "block", "chunk"), [(1024, 32, 1 << 25), (3, 2, 1 << 10)])
def test_jaccard_groups_at_the_edge(spark, monkeypatch, heavy, block, chunk):
    """Groups whose members, not their centres, link: the triangle inequality must leave them open. Parts of heavy lists, small
    blocks and chunks give the same."""
    for name, value in (("HEAVY", heavy), ("BLOCK", block), ("CHUNK_BYTES", chunk)):
        monkeypatch.setattr(jaccard, name, value)
    import random

    r = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows, k = [], 0
    for step in range(0, 40, 2):
        for _ in range(4):
            w = base[step:] + [f"z{j}" for j in range(step)]
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"y{r.randrange(10**6)}"
            rows.append((k, " ".join(w)))
            k += 1
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100))
    sets = {d: set(t.split()) for d, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert {d: r.component_id for d, r in got.items()} == union_find(links, sets)


def test_jaccard_members_of_one_size_count_each(spark):
    """A lone set that links to one member of a group whose sets all have one size, but stands too far from the others' positions."""
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(100)]
        pair, own = [f"g{g}s{k}" for k in range(4)], [f"g{g}o{k}" for k in range(5)]
        group = [base, *[base[:k] + base[k + 1 :] + [f"stop{k % 3}"] for k in range(90, 100)]]
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate([*group, base[:80] + base[84:] + pair, base[:70] + base[75:80] + base[84:] + pair + own])]
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 1, 85, 100))
    sets = {d: set(t.split()) for d, t in rows}
    assert {len(s) for s in sets.values()} == {100}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(set(union_find(links, sets).values())) == 6 and all(sum(12 + 13 * g in x for x in links) == 1 for g in range(6))
    assert {d: r.component_id for d, r in got.items()} == union_find(links, sets)


# -- 4 -----------------------------------------------------------------------


def test_sstable(docs, empty, odd, fixture_rows, tokenizer, monkeypatch):
    got = by_id(sstable.sstable_digest(docs, tokenizer))
    code, at = common.encoder(tokenizer).tokenizer, 0
    for d, t in sorted(texts_of(fixture_rows).items()):
        ids = [*code.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert sstable.sstable_digest(empty, tokenizer).count() == 0
    rows = sstable.sstable_digest(odd, tokenizer).collect()
    assert len(rows) == 14 and sorted(r.start for r in rows)[0] == 0 and min(rows, key=lambda r: r.start).doc_id is None


def test_sstable_lookup(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(sstable, "BLOCK_BYTES", 256)
    local = fs.LocalFileSystem()
    path = str(tmp_path / "x.sst")
    docs = {k: np.arange((k or 0) % 40, dtype=np.uint32) + (70_000 if k and k % 9 == 0 else 0) for k in [None, -5, *range(0, 900, 3)]}
    with local.open_output_stream(path) as out:
        w = sstable.Writer(out)
        for k, ids in docs.items():
            w.add(sstable.key_of(k), ids)
            if k == 300:
                w.add(sstable.key_of(k), ids[:1])
        size = w.close()
    assert size == (tmp_path / "x.sst").stat().st_size
    with local.open_input_file(path) as f:
        r = sstable.Reader(f)
        assert len(r.where) > 10 and r.n_docs == len(docs) + 1
        for k, ids in docs.items():
            assert r.get(k)[0].tolist() == ids.tolist() and len(r.get(k)) == (2 if k == 300 else 1)
        assert r.get(1) == [] and r.get(10**12) == []
        assert sum(r.maybe(sstable.key_of(k)) for k in range(10**6, 10**6 + 2000)) < 100
        assert [sstable.id_of(k) for k, _ in r.scan()][:3] == [None, -5, 0]


# -- 5 -----------------------------------------------------------------------


def test_licenses(docs, empty, odd, fixture_rows):
    got = by_id(licenses.license_digest(docs))
    for d, t in texts_of(fixture_rows).items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = sorted((k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert "gpl-3" in {r.labels for r in got.values()} and licenses.license_digest(empty).count() == 0 and licenses.license_digest(odd).count() == 14


def test_license_notices_need_their_key_phrases(spark):
    rows = [(1, "Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software"), (2, "permission was hereby granted free of charge to any person obtaining a copy of this software"), (3, "Kelvin: mit licenKe under the mit license"), (4, "under the mit licenKse")]
    got = by_id(licenses.license_digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert (got[1].labels, got[1].score, got[2].labels, got[3].n_base, got[4].n_base) == ("mit", 1.0, "", 1, 0)


# -- 6 -----------------------------------------------------------------------


def test_mix(docs, empty, odd, fixture_rows):
    got = by_id(mixing.mix_digest(docs))
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in fixture_rows}
    source = {r[0]: r[3] for r in fixture_rows}
    total = {s: sum(size[d] for d in size if source[d] == s) for s in set(source.values())}
    order = sorted([s for s in total if s is not None], key=lambda s: s.encode()) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(total.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        free -= over
    for d, r in got.items():
        assert (r["size"], r.source_size) == (size[d], total[source[d]]) and math.isclose(r.target, target[source[d]], rel_tol=1e-9) and 0 <= r.taken <= 2 * size[d]
    for s in order:
        assert abs(sum(r.taken for d, r in got.items() if source[d] == s) - target[s]) <= 0.5001
    again = by_id(mixing.mix_digest(docs.repartition(1)))
    assert {d: r.taken for d, r in got.items()} == {d: r.taken for d, r in again.items()}
    copies = Counter(r["doc_id"] for r in mixing.repeated(mixing.mix(docs)).collect())
    assert copies == Counter({d: -(-r.taken // r["size"]) for d, r in got.items() if r.taken})
    assert mixing.mix_digest(empty).count() == 0 and mixing.mix_digest(odd).count() == 14
    assert mixing.mix_digest(docs.where("text is null")).select(F.sum("taken")).first()[0] == 0


# -- 7 -----------------------------------------------------------------------


def test_repeats(docs, empty, odd, fixture_rows, monkeypatch):
    monkeypatch.setattr(suffix, "FAN_IN", 2)  # several rounds
    monkeypatch.setattr(common, "PACK_BYTES", 3000)
    monkeypatch.setattr(suffix, "PIECE", 1000)
    monkeypatch.setattr(suffix, "WINDOWS", 150)
    monkeypatch.setattr(common, "SLAB_BYTES", 1000)
    got = by_id(suffix.repeat_digest(docs))
    seen = set()
    for d, t in sorted(texts_of(fixture_rows).items()):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k + 1 : k + 101] = True
            seen.add(raw[k : k + 100])
        keep = bytes(b for b, g in zip(raw, gone[1:-1].tolist(), strict=True) if not g)
        r = got[d]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()))
        assert r.kept_sha256 == hashlib.sha256(keep).hexdigest()
    assert suffix.repeat_digest(empty).count() == 0 and suffix.repeat_digest(odd).count() == 14


@pytest.mark.parametrize("bits", [0, 2, 16, 64])
def test_repeats_with_hashes_that_collide(bits, monkeypatch):
    monkeypatch.setattr(suffix, "AT_ONCE", 64)
    rng = np.random.default_rng(bits)
    buf = np.concatenate([rng.integers(0, 2, 400, np.uint8)] * 3 + [np.zeros(300, np.uint8), rng.integers(0, 256, 400, np.uint8)])
    full = suffix.windows(buf)[1]
    place, start = rng.permutation(len(full)), np.arange(len(full))
    bucket = full & np.uint64((1 << bits) - 1)
    seen, want = set(), np.zeros(len(full), bool)
    for k in np.argsort(place):
        want[k] = buf[k : k + 100].tobytes() in seen
        seen.add(buf[k : k + 100].tobytes())
    assert (suffix._again(bucket, place, start, buf) == want).all() and 900 < want.sum() < len(full)


def test_repeats_in_long_texts(spark):
    """Texts of several stretches; the passages repeat within a text, over texts and across the ends of stretches."""
    rng = np.random.default_rng(7)
    long = bytes(rng.integers(97, 123, 3 * suffix.PIECE, np.uint8)).decode()
    edge = suffix.PIECE
    rows = [(1, long), (2, long[edge - 300 : edge + 300] + "é" * 40 + long[:50]), (3, "x" * 120 + long[2 * edge - 99 : 2 * edge + 99] + long[5:1000]), (4, long + long[:99]), (5, "y" + long[100 : edge + 500])]
    got = by_id(suffix.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string")))
    seen = set()
    for d, t in rows:
        raw = t.encode()
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - 99):
            h = hash(raw[k : k + 100])
            if h in seen:
                gone[k + 1 : k + 101] = True
            seen.add(h)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans) == (len(raw), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()))


# -- 8 -----------------------------------------------------------------------


def test_imatch(docs, empty, odd, fixture_rows):
    got = by_id(imatch.fingerprint_pairs(docs))
    order = sorted(texts_of(fixture_rows).items(), reverse=True)
    prints = {}
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)]
        n = len(t) // 3
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - n] + (nxt[1] or "")[:n]).encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.near_next == imatch.likeness(r.fingerprint, got[nxt[0]].fingerprint) and r.near_edited == imatch.likeness(r.fingerprint, r.edited_fingerprint)
    assert imatch.fingerprint_pairs(empty).count() == 0 and imatch.fingerprint_pairs(odd).count() == 14
    one = imatch.fingerprint_pairs(docs.where("doc_id = 110")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_lexicon_band(docs, fixture_rows):
    df = Counter(w for _, t in texts_of(fixture_rows).items() for w in set(WORD.findall((t or "").translate(LOWER))))
    n = len(fixture_rows)
    want = {common.xxhash.xxh64_intdigest(w.encode()) for w, c in df.items() if max(2, 0.05 * n) <= c <= 0.2 * n}
    assert set(imatch.lexicon(docs, 0.05, 0.2).tolist()) == want


def test_imatch_tells_hot_groups(spark):
    """A third of the rows are near copies of one text, a third copies of another: their terms stay in the lexicon."""
    import random

    r = random.Random(5)
    near, same = [f"n{k}" for k in range(200)], " ".join(f"s{k}" for k in range(200))
    rows = [" ".join([*near[:k], f"z{k}", *near[k + 1 :]]) for k in range(60)] + [same] * 60 + [" ".join(r.choices([f"v{k}" for k in range(900)], k=60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    terms = set(imatch.lexicon(docs).tolist())
    hashes = [common.xxhash.xxh64_intdigest(w.encode()) for w in [*near, *same.split()]]
    assert sum(h in terms for h in hashes) == len(hashes)
    got = by_id(imatch.fingerprint_pairs(docs))
    assert all(got[d].near_edited > 0 for d in range(61, 120)) and all(got[d].near_next >= 0.5 for d in range(1, 60))
    words = common.Words(pa.array(["a b c d e f g h", "a b c d e f g i"]))
    assert imatch.likeness(*imatch.Lexicon(np.zeros(0, np.uint64)).fingerprints(words)) > 0


# -- 9 -----------------------------------------------------------------------


def test_shards(docs, empty, odd, fixture_rows):
    got = by_id(sharding.shard_digest(docs, 5))
    for d, t in texts_of(fixture_rows).items():
        raw = (t or "").encode()
        assert (got[d]["size"], got[d].text_crc32, got[d].law, got[d].grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    per = Counter(r.shard for r in got.values())
    assert set(per) == set(range(5)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in got.values() if r.shard == s) == list(range(n)) for s, n in per.items())
    full = sharding.shuffle_to_shards(docs, 5)
    assert {"lang", "size", "pack"} <= set(full.columns) and full.count() == len(fixture_rows)
    # several buckets, columns named like the operator's own, another layout of the same rows
    clash = docs.withColumns({"_h": F.lit("mine"), "_bucket": F.lit(1.5)})
    many = by_id(sharding.shuffle_to_shards(clash, 5, bucket_bytes=2000))
    assert len(many) == len(fixture_rows) and {(r["_h"], r["_bucket"]) for r in many.values()} == {("mine", 1.5)}
    per = Counter(r.shard for r in many.values())
    assert set(per) == set(range(5)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in many.values() if r.shard == s) == list(range(n)) for s, n in per.items())
    other = by_id(sharding.shuffle_to_shards(clash.repartition(7, "text"), 5, bucket_bytes=2000))
    assert {d: (r.shard, r.slot) for d, r in other.items()} == {d: (r.shard, r.slot) for d, r in many.items()}
    assert sharding.shard_digest(empty).count() == 0 and sharding.shard_digest(odd, 3).count() == 14
    assert {d: (r.shard, r.slot) for d, r in got.items()} == {d: (r.shard, r.slot) for d, r in by_id(sharding.shard_digest(docs, 5)).items()}


# -- 10 ----------------------------------------------------------------------


def lm_by_hand(rows, counts=lambda c: int(bloomlm.TABLE[int(bloomlm.quantise(np.array([c]))[0]) - 1]) if c else 0):
    """held_out, n_tokens, n_known, train_tokens, base_score and score of each document, from dictionaries of n-grams."""
    toks = [(d, [*WORD.findall((t or "").translate(LOWER)), None]) for d, t in rows]
    out = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in toks]
    grams = Counter(tuple(ws[k : k + n]) for (_, ws), o in zip(toks, out, strict=True) if not o for n in (1, 2, 3) for k in range(len(ws) - n + 1))
    n, v = (f(c for g, c in grams.items() if len(g) == 1) for f in (sum, lambda x: len(list(x))))
    want = []
    for (d, ws), o in zip(toks, out, strict=True):
        base = score = 0.0
        for k, w in enumerate(ws):
            p = (grams[w,] + 1) / (n + v + 1)
            base += math.log10(p)
            for m in range(1, min(k, bloomlm.ORDER - 1) + 1):
                context = counts(grams[tuple(ws[k - m : k])])
                if context:
                    p = (min(context, counts(grams[tuple(ws[k - m : k + 1])])) + bloomlm.PRIOR * p) / (context + bloomlm.PRIOR)
            score += math.log10(p)
        want.append((d, o, len(ws), sum((w,) in grams for w in ws), n, round(base, 6), round(score, 6)))
    return sorted(want, key=str)


def lm_rows(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=str)


@pytest.mark.parametrize(("words", "size", "asked"), [(bloomlm.BATCH_WORDS, bloomlm.CHUNK_BYTES, bloomlm.REGION_BYTES), (150, 2000, 700)])
def test_lm(spark, docs, empty, odd, fixture_rows, monkeypatch, words, size, asked):
    """Batches, chunks and regions of any size give the scores of plain counts, quantised, where the filter has room enough to err nowhere."""
    for name, value in (("BATCH_WORDS", words), ("CHUNK_BYTES", size), ("REGION_BYTES", asked), ("BITS_A_KEY", 400)):
        monkeypatch.setattr(bloomlm, name, value)
    got, want = lm_rows(bloomlm.score_lm(docs)), lm_by_hand((r[0], r[1]) for r in fixture_rows)
    assert [r[:6] for r in got] == [r[:6] for r in want] and all(abs(x[6] - y[6]) < 1e-4 for x, y in zip(got, want, strict=True))
    assert bloomlm.score_lm(empty).count() == 0
    assert [r[:6] for r in lm_rows(bloomlm.score_lm(odd))] == [r[:6] for r in lm_by_hand((r.doc_id, r.text) for r in odd.collect())]


def test_lm_filter_errs_little(spark, docs, fixture_rows):
    got, want = lm_rows(bloomlm.score_lm(docs)), lm_by_hand((r[0], r[1]) for r in fixture_rows)
    assert sum(math.isclose(x[6], y[6], rel_tol=0.01) for x, y in zip(got, want, strict=True)) > 0.9 * len(want)


def test_lm_probabilities_sum_to_one():
    """Over all words known and one unknown, after a known context, with exact counts: the interpolation's sums."""
    texts = [(k, "a b a c a b d a a b c b a d") for k in (0, 1, 3)]
    c = Counter(w for _, t in texts for w in [*t.split(), None])
    pairs = Counter(x for _, t in texts for x in itertools.pairwise([*t.split(), None]))
    n = sum(c.values()) + len(c) + 1
    for ctx in "abcd":
        assert math.isclose(sum((pairs[ctx, w] + bloomlm.PRIOR * (c[w] + 1) / n) / (c[ctx] + bloomlm.PRIOR) for w in [*c, "unknown"]), 1)


def test_log_frequency_filter():
    rng = np.random.default_rng(4)
    h, c = rng.integers(0, 1 << 63, 3000).astype(np.uint64) << np.uint64(1), rng.integers(0, 5000, 3000)
    f = bloomlm.LogFrequencyFilter(h, c)
    got, q = f.levels(h), bloomlm.quantise(c)
    assert (got >= q).all() and (got > q).mean() < 0.02
    assert (f.levels(rng.integers(0, 1 << 63, 20000).astype(np.uint64)) > 0).mean() < 0.02
    assert all(bloomlm.TABLE[q[c > 0] - 1] <= c[c > 0]) and (bloomlm.quantise(np.arange(6)) == np.arange(6)).all()
    assert not bloomlm.LogFrequencyFilter(h[:0], c[:0]).levels(h).any()


# -- registered queries against their SQL ------------------------------------


@pytest.mark.parametrize("name", ["op5_license_scan", "op6_mix"])
def test_sql(spark, name):
    import duckdb

    from keyloom.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    r = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    df = queries.queries()[name](spark, "/root/testdata/sf0.001").select(*names)
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(r.fetchall(), key=key)
