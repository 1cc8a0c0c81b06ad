import random

import pytest
from hypothesis import given, settings, strategies as st

from tidegauge.functions.words import words
from tidegauge.llm import overlap


def brute(left, right, s=0.8):
    found = {}
    for i, a in left:
        for j, b in right:
            x, y = set(words(a)), set(words(b))
            if x and y and len(x & y) >= s * len(x | y) - 1e-9:
                found[i, j] = len(x & y)
    return found


def run(spark, left, right, s=0.8):
    kind = "id long, text string, n int, side string"
    frames = [spark.createDataFrame([(i, t, 1, "x") for i, t in rows], kind) for rows in (left, right)]
    return overlap.cross_split_overlap(*frames, similarity=s).collect()


def near_copies(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + [f"rare{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        base = rng.choice(texts).split() if texts and rng.random() < 0.7 else rng.sample(vocabulary, rng.randint(1, 30))
        new = [w for w in base if rng.random() > 0.06] + rng.sample(vocabulary, rng.randint(0, 2))
        texts.append(" ".join(new) or "w1")
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, s", [(1, 0.8), (2, 0.8), (3, 0.6), (4, 0.95)])
def test_against_all_pairs(spark, seed, s):
    rows = near_copies(seed)
    left, right = rows[:80], rows[60:]  # some stand on both sides
    got = run(spark, left, right, s)
    expected = brute(left, right, s)
    assert {(r["left_id"], r["right_id"]): r["common"] for r in got} == expected and len(got) == len(expected) > 5


def test_hot_words_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_RECORDS", 3)
    monkeypatch.setattr(overlap, "REMEMBERED", 2)
    same = [(k, "one two three four five six") for k in range(50)]
    left = same + [(100, "one two three four five seven"), (101, "one two three four five")]
    right = [(200 + k, "six five four three two ONE!") for k in range(20)] + [(300, "other words")]
    got = run(spark, left, right)
    assert {(r["left_id"], r["right_id"]) for r in got} == set(brute(left, right)) and len(got) == 51 * 20


def test_edges(spark):
    left = [(1, None), (2, ""), (3, "?!"), (4, "Straße ﬁre １２"), (None, "a b"), (5, "x " * 100_000 + "y"), (6, "word"), (6, "word")]
    right = [(11, "strasse"), (12, "straße fire 12"), (13, None), (14, "X y"), (15, "word"), (16, " . ")]
    got = sorted((r["left_id"], r["right_id"]) for r in run(spark, left, right))
    assert set(got) == {(4, 12), (5, 14), (6, 15)}
    r = next(r for r in run(spark, left, right) if r["left_id"] == 4)
    assert r["similarity"] == 1.0 and r["cosine"] == pytest.approx(1.0)
    assert run(spark, [], right) == [] and run(spark, left, []) == [] and run(spark, [], []) == []


def test_counts(spark):
    pairs = spark.createDataFrame([(1, 11), (2, 11), (1, 12)], "left_id long, right_id long")
    right = spark.createDataFrame([(11, "test", None, 0), (12, "dev", "d", 0), (13, "dev", "d", 0)], "id int, split string, dataset string, pairs int")
    assert sorted(map(tuple, overlap.overlap_counts(pairs, right, ["split", "dataset"]).collect())) == [("dev", "d", 1, 1), ("test", None, 1, 2)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20, unique=True), st.randoms())
def test_set_hash_ignores_order(values, rng):
    import numpy as np

    mixed = values[:]
    rng.shuffle(mixed)
    a, b = (overlap._set_hashes(np.array(v, np.uint64), np.array([len(v)])) for v in (values, mixed))
    assert a[0][0] == b[0][0] and a[1][0] == b[1][0]


@pytest.mark.parametrize("seed, cosine", [(5, 0.8), (6, 0.6), (7, 0.9)])
def test_weighted_against_all_pairs(spark, seed, cosine):
    import math

    import numpy as np
    import xxhash

    rows = near_copies(seed)
    left, right = rows[:80], rows[60:]
    bucket = {w: xxhash.xxh3_64_intdigest(w) & (overlap.BUCKETS - 1) for _, t in rows for w in words(t)}
    df = np.zeros(overlap.BUCKETS)
    for _, t in left + right:
        for w in set(words(t)):
            df[bucket[w]] += 1
    weigh = lambda t: {w: 1 + math.log((len(left) + len(right) + 1) / (df[bucket[w]] + 1)) for w in set(words(t))}
    expected = {}
    for i, a in left:
        for j, b in right:
            x, y = weigh(a), weigh(b)
            dot = sum(x[w] * y[w] for w in x.keys() & y.keys()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            if dot >= cosine - 1e-9:
                expected[i, j] = dot
    frames = [spark.createDataFrame(r, "id long, text string") for r in (left, right)]
    got = {(r["left_id"], r["right_id"]): r["cosine"] for r in overlap.weighted_overlap(*frames, cosine=cosine).collect()}
    assert got.keys() == expected.keys() and len(got) > 5 and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    assert overlap.weighted_overlap(frames[0].limit(0), frames[1]).collect() == []


@pytest.mark.parametrize("block, own", [(1 << 16, 1 << 12), (40, 8), (1, 1)])
def test_lists_hold_equal_entries_of_many_tasks_once(monkeypatch, block, own):
    """Copies that tasks wrote into a list add no meetings, wherever batches and blocks end; whatever brute force lets through is met."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "OWN_BLOCK", own)
    monkeypatch.setattr(overlap, "ROWS_AT_ONCE", 2)
    rng, rows = np.random.default_rng(5), []
    bases = [rng.integers(0, 2, 256).astype(bool) for _ in range(3)]
    for word_set in range(150):
        flips = rng.random(256) < rng.choice([0.0, 0.01, 0.04])
        n = int(rng.integers(45, 60))
        bits = np.packbits(bases[word_set % 3] ^ flips).view(np.int64)
        rows.append((int(rng.integers(-4, 4)), word_set, n if rng.random() < 0.6 else -n, int(rng.integers(30, n + 1)), *bits.tolist()))
    frame = pd.DataFrame(rows, columns=["term", "word_set", "n", "rest", "b0", "b1", "b2", "b3"])
    expected, together = set(), [int.from_bytes(np.array(r[4:], np.int64).tobytes(), "big") for r in rows]
    for r, p in zip(rows, together):
        for s, q in zip(rows, together):
            size = r[2] - s[2]
            if r[0] == s[0] and r[2] > 0 > s[2] and min(r[3], s[3]) * 1.8 >= size * 0.8 - 1e-6 and (p ^ q).bit_count() <= size * 0.2 / 1.8 + 1e-6:
                expected.add((r[1], s[1]))
    copies = pd.concat([frame] * 7).sort_values("term", kind="stable", ignore_index=True)
    got = [tuple(p) for k in (13, 100, 5_000) for d in overlap._meetings(0.8, 8 / 9)(copies.iloc[i : i + k] for i in range(0, len(copies), k)) for p in d.itertuples(index=False)]
    assert len(got) == 3 * len(expected) > 20 and set(got) == expected
