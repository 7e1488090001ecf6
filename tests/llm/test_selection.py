"""Importance resampling, packing and hard negatives against brute force."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

try:
    import public_tokenizers

    TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
except ImportError:
    TOKENIZER = os.environ.get("RIDGELINE_TOKENIZER", "")


# --- importance resampling


def runs_of_words(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_resample(rows, targets, n, buckets, percent, least):
    spot = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(spot(g) for r in rows for g in runs_of_words(r[1], n)[1])
    t = Counter(spot(g) for x in targets for g in runs_of_words(x, n)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    out = []
    for r in rows:
        words, grams = runs_of_words(r[1], n)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(spot(g)) for g in grams)
        out.append([r[0], len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[1]))
    ranks = {id(x): k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return sorted([(*x[:4], ranks.get(id(x))) for x in out], key=str)


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 40), (2, 97, 100), (3, 50, 10)])
def test_resample_equals_brute_force(spark, odd, odd_rows, n, buckets, percent):
    from ridgeline.llm.importance import resample

    targets = [odd_rows[2][1], odd_rows[4][1], None, "", "A'B c-d  12"]
    target = spark.createDataFrame([(i, x) for i, x in enumerate(targets)], "item_id long, text string")
    got = resample(odd, target, percent, 20, n, buckets).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute_resample(odd_rows, targets, n, buckets, percent, 20)


def test_resample_edges(spark, odd, odd_rows, empty):
    from ridgeline.llm.importance import drawn, resample

    assert resample(empty, odd).count() == 0
    nothing = odd.limit(0)
    ranked = resample(odd, nothing, 50)
    assert ranked.count() == len(odd_rows)
    texts = drawn(odd, ranked)
    ranks = sorted(r["rank"] for r in texts.collect())
    assert ranks == list(range(1, len(ranks) + 1))
    assert {"doc_id", "text", "size", "label", "rank"} <= set(texts.columns)
    assert resample(odd, odd, 0).filter("rank is not null").count() == 0


def test_ranks_do_not_depend_on_segments_or_ties(spark):
    from ridgeline.llm import importance

    rng = random.Random(3)
    rows = [(i % 300, i, 30, 5, 0, rng.choice([7, 7, 7, rng.randrange(50)])) for i in range(1200)]
    data = spark.createDataFrame(rows, "doc_id long, key long, n_words long, n_features long, weight long, score long").repartition(7)
    got = importance.with_ranks(data, "n_words >= 20", 60).filter("rank is not null").orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (-r[5], r[0], -r[3], r[1]))[:720]
    assert [(r.doc_id, r.key, r["rank"]) for r in got] == [(r[0], r[1], k + 1) for k, r in enumerate(want)]


def test_crc_of_long_and_short_words():
    from ridgeline.llm.importance import crc32

    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = np.array([0, 10, 10, 700, 63, 64, 4999, 5])
    end = np.array([1, 10, 74, 4900, 128, 128, 5000, 70])
    assert crc32(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]


# --- packing


def least_sequences(lengths, capacity):
    """The optimum, by branch and bound over tiny inputs."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_patterns_use_every_piece_and_are_near_the_optimum():
    from ridgeline.llm.packing import patterns

    rng, over = random.Random(11), 0
    for _ in range(120):
        capacity = rng.randrange(5, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 12))]
        made = list(patterns(np.bincount(lengths, minlength=capacity + 1), capacity))
        assert all(sum(p) <= capacity and many >= 1 for p, many in made)
        assert Counter(n for p, many in made for n in p * many) == Counter(lengths)
        best = least_sequences(lengths, capacity)
        over += sum(m for _, m in made) - best
        assert sum(m for _, m in made) <= best + 1
    assert over <= 6


def test_exact_fills_keep_within_the_counts():
    from ridgeline.llm.packing import Available

    rng = random.Random(2)
    for _ in range(300):
        top = rng.randrange(3, 24)
        counts = np.array([0] + [rng.choice([0, 0, 1, 2, 5]) for _ in range(top)])
        stock, gap = Available(counts), rng.randrange(1, top + 1)
        have = [n for n in range(1, top + 1) for _ in range(min(counts[n], 3))]
        can = any(sum(c) == gap for k in (1, 2, 3) for c in itertools.combinations(have, k))
        found = stock.exact(gap)
        assert (found is not None) == can
        if found:
            assert sum(found) == gap and all(k <= counts[n] for n, k in Counter(found).items())
        pairs = Counter(a + b for a in range(1, top + 1) for b in range(a, top + 1) if counts[a] and counts[b] and (a != b or counts[a] > 1))
        assert {s: int(n) for s, n in enumerate(stock.pairs) if n} == pairs


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
@pytest.mark.parametrize("capacity", [2048, 128])
def test_packing_is_a_round_trip(spark, odd, odd_rows, empty, capacity):
    from tokenizers import Tokenizer

    from ridgeline.llm.packing import pack, sequences

    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in odd_rows]
    want = sorted(((r[0], k, s, len(x[s : s + capacity]), zlib.crc32(np.array(x[s : s + capacity], "<u4").tobytes())) for r, x in zip(odd_rows, ids, strict=True) for k, s in enumerate(range(0, len(x), capacity))), key=str)
    got = pack(odd, TOKENIZER, capacity).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want
    bins: dict = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= capacity and sorted(bins) == list(range(len(bins)))
    assert len(bins) <= -(-sum(w[3] for w in want) // capacity) + 2
    whole = sequences(odd, TOKENIZER, capacity).collect()
    assert sorted(len(r.ids) for r in whole) == sorted(bins.values())
    assert Counter(x for r in whole for x in r.ids) == Counter(x for i in ids for x in i)
    assert pack(empty, TOKENIZER, capacity).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
def test_ids_by_word_are_those_of_whole_texts(odd_rows, monkeypatch):
    from tokenizers import Tokenizer

    from ridgeline.llm import packing

    monkeypatch.setattr(packing, "WORDS", 40)
    rng = random.Random(8)
    odd_chars = [" ", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\u00a0", "\u2003", "\u0301", "e", "É", "ß", "İ", "Σ", "ς", "'", "'s", "'LL", "1", "٣", "<|endoftext|>", "<|startoftext|>", "</w>", "\ud55c", "\u1100", "\u1161", "🙂", "#", "...", "\ue000", "\ue001"]
    texts = [r[1] or "" for r in odd_rows] + ["".join(rng.choice(odd_chars) for _ in range(rng.randrange(60))) for _ in range(600)]
    whole, coder = Tokenizer.from_file(TOKENIZER), packing.Coder(TOKENIZER, True)
    for k in range(0, len(texts), 50):
        for text, got in zip(texts[k : k + 50], coder.ids(texts[k : k + 50]), strict=True):
            assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
def test_a_word_is_looked_up_once_for_many_texts():
    from ridgeline.llm import packing

    class Looked(dict):
        found = 0

        def __getitem__(self, word):
            self.found += 1
            return super().__getitem__(word)

    coder = packing.Coder(TOKENIZER, True)
    coder._known = Looked()
    texts = ["Yes~no yes, yes  ~ yes\n"] * 100 + ["", "~", " yes"]
    got = [x.tolist() for x in coder.ids(texts)]
    assert got == [x.ids for x in coder._tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder._known.found <= 6
    assert len(coder._tokenizer.encode(packing.MARK, add_special_tokens=False).ids) == 1


# --- hard negatives


def brute_negatives(rows, every, positives, negatives, low, high):
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a in {(i, lab, tuple(v)) for i, lab, v in ok if i is not None and i % every == 0}:
        scored = [(sum(x * y for x, y in zip(a[2], v, strict=True)), i, lab) for i, lab, v in ok if len(v) == len(a[2]) and i != a[0]]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p in [s for s in scored if s[2] == a[1]][:positives]:
            hard = [s for s in scored if s[2] != a[1] and low * p[0] <= 100 * s[0] <= high * p[0]][:negatives]
            out += [(a[0], p[1], k + 1, s[1], p[0], s[0]) for k, s in enumerate(hard)]
    return sorted(out, key=str)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(3))
        v = (centres[label if rng.random() < 0.7 else 3] + rng.normal(size=dim) * 0.4) * rng.choice([0.2, 1, 1, 3])
        rows.append((i, [float(x) for x in v], label))
    return rows


@pytest.mark.parametrize(("dim", "block", "low", "high"), [(12, 4096, 80, 100), (3, 7, 50, 90), (1, 20, 80, 100)])
def test_negatives_equal_brute_force(spark, monkeypatch, dim, block, low, high):
    from ridgeline.llm import negatives

    rows = vectors(400, dim, dim)
    rows += [(1000 + i, rows[10][1], 1) for i in range(40)] + [(2000 + i, rows[10][1], 2) for i in range(40)]  # ties
    rows += [(3000, [0.0] * dim, 0), (3001, [0.0] * dim, 1), (3010, [0.0] * dim, 1), rows[10], rows[11], rows[20], rows[20]]
    rows += [(None, rows[20][1], 0), (3100, None, 1), (3110, rows[0][1], None), (3120, [math.nan] * dim, 1), (3130, [math.inf] * dim, 1), (3140, [None] * dim, 1), (3150, [1.0] * (dim + 1), 1), (3160, [], 1), (3170, [], 2)]
    data = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, length int").repartition(4)
    got = negatives.mine(data, "vec_id % 10 = 0", 5, 5, low, high, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute_negatives(rows, 10, 5, 5, low, high)


def test_candidates_are_pruned_and_whole():
    from ridgeline.llm.negatives import Bucket, _anchor

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 200
    vecs = np.floor(centres[rng.integers(20, size=3000)] + rng.normal(size=(3000, 16)) * 20).astype(np.int64)
    bucket, looked = Bucket(vecs), 0
    for k in range(50):
        scores = vecs @ vecs[k]
        for theta in (int(np.sort(scores)[-5]), int(scores.max()), int(np.median(scores))):
            found = bucket.candidates(_anchor(0, 0, 0, vecs[k].tolist(), []), theta)
            assert set(np.flatnonzero(scores >= theta)) <= set(found.tolist())
            looked += len(found) if theta == np.sort(scores)[-5] else 0
    assert looked < 50 * 3000 * 0.3


def test_negatives_of_nothing(spark):
    from ridgeline.llm.negatives import mine

    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mine(none, "vec_id % 100 = 0").count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert mine(one, "vec_id % 100 = 0").collect() == []
