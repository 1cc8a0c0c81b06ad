import random

import pytest

from tidegauge.llm import mixing, tokens


def test_flight_keeps_both_totals():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 50, 400):
        sizes, p = [rng.randint(0, 500) for _ in range(n)], [rng.choice([0.0, 1.0, rng.random(), 0.3]) for _ in range(n)]
        q = mixing.flight(sizes, p, rng.random)
        assert sum(q) == pytest.approx(sum(p), abs=1e-6) and sum(a * b for a, b in zip(q, sizes)) == pytest.approx(sum(a * b for a, b in zip(p, sizes)), abs=1e-3)
        assert sum(0 < v < 1 for v in q) <= 2
        assert all(v in (0.0, 1.0) for v in mixing.landing(q, rng.random))


def test_probabilities_are_kept():
    sizes, p = [10, 20, 30, 40, 50, 60], [0.2, 0.5, 0.5, 0.5, 0.8, 0.5]
    hits = [0] * 6
    rng = random.Random(1)
    for _ in range(4000):
        for k, v in enumerate(mixing.landing(mixing.flight(sizes, p, rng.random), rng.random)):
            hits[k] += v
    assert [h / 4000 for h in hits] == pytest.approx(p, abs=0.04)


def frames(spark):
    rng = random.Random(6)
    rows = [(k, "big" if k % 10 else "small", rng.randint(1, 300)) for k in range(4000)] + [(5000, None, 10), (5001, "other", 10), (5002, "big", 0)]
    sizes = spark.createDataFrame([(*r, 1) for r in rows], "id long, source string, tokens long, documents int")
    targets = spark.createDataFrame([("big", 0.6, 1, 0), ("small", 0.4, 5, 0), ("absent", 0.0, 2, 0), (None, 0.1, 1, 0)], "source string, target_share double, max_repeats int, available int")
    return sizes, targets


def test_shares(spark):
    sizes, targets = frames(spark)
    got = {r["source"]: r for r in mixing.shares(mixing.mix(sizes, targets), targets).collect()}
    assert got["big"]["share"] == pytest.approx(0.6, abs=0.002) and got["small"]["share"] == pytest.approx(0.4, abs=0.002)
    assert got["small"]["most"] <= 5 and got["big"]["most"] == 1 and got["absent"]["tokens"] == 0 and len(got) == 3


def test_blocks_and_partitions_do_not_matter(spark):
    sizes, targets = frames(spark)
    small = {tuple(r) for r in mixing.mix(sizes, targets, total=100_000.0, block=100).collect()}
    assert small == {tuple(r) for r in mixing.mix(sizes.repartition(7), targets, total=100_000.0, block=100).collect()}
    per = {r["source"]: r["tokens"] for r in mixing.shares(mixing.mix(sizes, targets, total=100_000.0, block=100), targets).collect()}
    assert per["big"] == pytest.approx(60_000, abs=600) and per["small"] == pytest.approx(40_000, abs=600)
    capped = {r["source"]: r["most"] for r in mixing.shares(mixing.mix(sizes, targets, total=1e9), targets).collect()}
    assert capped == {"big": 1, "small": 5, "absent": 0}


def test_many_blocks_land_in_levels(spark):
    sizes, targets = frames(spark)
    mixed = mixing.mix(sizes, targets, total=100_000.0, block=10)
    per = {r["source"]: (r["tokens"], r["most"]) for r in mixing.shares(mixed, targets).collect()}
    assert per["big"][0] == pytest.approx(60_000, abs=600) and per["small"][0] == pytest.approx(40_000, abs=600) and per["big"][1] == 1
    assert mixed.count() == mixed.select("id").distinct().count()


def test_nothing(spark):
    sizes, targets = frames(spark)
    assert mixing.mix(sizes.limit(0), targets).collect() == [] and mixing.mix(sizes, targets.limit(0)).collect() == []
    assert [r["tokens"] for r in mixing.shares(mixing.mix(sizes.limit(0), targets), targets).collect()] == [0, 0, 0]


def test_tokens(spark):
    long = "one two  three\n" * 40_000
    df = spark.createDataFrame([(1, "a", "Hello world"), (2, None, None), (3, "a", ""), (4, "a", long), (None, "a", "x")], "id int, source string, text string")
    got = {r["id"]: r["tokens"] for r in tokens.token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and len(got) == 4
    assert got[4] == len(tokens.encoding().encode_ordinary(long))
    assert tokens.token_counts(df.limit(0)).collect() == []
