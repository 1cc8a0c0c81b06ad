import math
import random

import pytest

from tidegauge.functions.geo import EARTH_KM, parse_point
from tidegauge.operators import nearby


def distance(a, b):
    (y, x), (v, u) = (tuple(map(math.radians, p)) for p in (a, b))
    s = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * EARTH_KM * math.asin(min(1, math.sqrt(s)))


def brute(points, km):
    found = set()
    for k, (i, *p) in enumerate(points):
        for j, *q in points[:k]:
            if i != j and distance(p, q) <= km:
                found.add((min(i, j), max(i, j)))
    return found


def places():
    rng = random.Random(5)
    out = [(k, rng.choice([0.0, 40.0, -33.3]) + rng.uniform(-0.03, 0.03), rng.choice([10.0, 179.99, -179.99]) + rng.uniform(-0.03, 0.03)) for k in range(300)]
    out += [(1000 + k, rng.choice([89.999, -89.995, 89.95]), rng.uniform(-180, 180)) for k in range(40)]
    out += [(2000 + k, 12.5, 33.25) for k in range(12)]  # many at one place
    return out + [(2000, 40.0, 10.0), (1, 12.5, 33.25)]  # ids with a second place


@pytest.mark.parametrize("block, km", [(20_000, 1.0), (5, 1.0), (20_000, 3.0)])
def test_near_pairs_against_all_pairs(spark, monkeypatch, block, km):
    monkeypatch.setattr(nearby, "BLOCK_POINTS", block)
    points = places()
    rows = [*points, points[0], (None, 1.0, 1.0), (7, None, 1.0), (8, 1.0, None), (9, float("nan"), 1.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, lat double, lon double, strip string, block int")
    got = [(r["a_id"], r["b_id"]) for r in nearby.near_pairs(df, km).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(points, km)


def test_near_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "id long, lat double, lon double")
    assert nearby.near_pairs(df, 1.0).collect() == []


def inside(y, x, ring):
    odd = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (a > y) != (c > y) and x < b + (y - a) / (c - a) * (d - b):
            odd = not odd
    return odd


@pytest.mark.parametrize("sent", [100_000, 0])
def test_regions_against_all_pairs(spark, sent):
    rng = random.Random(9)
    rings = []
    for k in range(12):
        y, x, n = rng.uniform(-60, 60), rng.choice([rng.uniform(-170, 170), 179.5]), rng.randint(3, 14)
        ring = [[y + math.sin(2 * math.pi * t / n) * rng.uniform(0.5, 3), x + math.cos(2 * math.pi * t / n) * rng.uniform(0.5, 3)] for t in range(n)]
        rings.append((k, ring[::-1] if k % 2 else ring))
    points = [(k, rng.choice(rings)[1][0][0] + rng.uniform(-3, 3), rng.choice(rings)[1][0][1] + rng.uniform(-3, 3)) for k in range(400)]
    points = [(k, y, (x + 180) % 360 - 180) for k, y, x in points]
    expected = {(k, a) for k, y, x in points for a, r in rings if any(inside(y, x + t, r) for t in (-360, 0, 360))}
    table = [(a, r + r[:1] if a % 3 else r, "n") for a, r in rings] + [(90, None, "n"), (91, [[1.0, 1.0]], "n"), (92, [], "n"), (None, rings[0][1], "n")]
    regions = spark.createDataFrame(table, "id long, ring array<array<double>>, lat string")
    df = spark.createDataFrame([*points, (500, None, 1.0), (501, 1.0, None)], "id long, lat double, lon double")
    got = [(r["point_id"], r["region_id"]) for r in nearby.containing_regions(df, regions, sent).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected
    assert nearby.containing_regions(df.limit(0), regions, sent).collect() == []
    assert nearby.containing_regions(df, regions.limit(0), sent).collect() == []


def test_spellings_of_points(spark):
    texts = ["(1.5, -2)", " ( 1.5 , -2 ) ", "(+1.5,-2)", "[1.5, -2.0]", "1.5 -2", "lat: 1.5, lon: -2", None, "", "None", "(nan, nan)", "(None, None)", "(95.0, 1.0)", "(1,2,3)"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["p"] for r in df.select("k", parse_point(df["t"]).alias("p")).collect()}
    assert all(tuple(got[k]) == (1.5, -2.0) for k in range(6)) and all(got[k] is None for k in range(6, len(texts)))


def test_crowded_blocks_copy_few_points(spark, monkeypatch):
    """A block of many points that are far apart for the radius is cut along its longitudes, not copied to parts."""
    monkeypatch.setattr(nearby, "BLOCK_POINTS", 50)
    rng = random.Random(2)
    points = [(k, 40.0 + rng.uniform(-0.02, 0.02), 10.0 + rng.uniform(-2, 2)) for k in range(3000)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = {(r["a_id"], r["b_id"]) for r in nearby.near_pairs(df, 0.2).collect()}
    assert got == brute(points, 0.2) and len(got) > 300


def test_region_of_many_corners_in_slices(spark, monkeypatch):
    monkeypatch.setattr(nearby, "_AT_ONCE", 100)
    ring = [[math.sin(2 * math.pi * t / 5000) * 2, 179 + math.cos(2 * math.pi * t / 5000) * 3] for t in range(5000)]
    points = spark.createDataFrame([(k, -1.9 + 0.2 * k, -180.0 + 0.1 * k) for k in range(20)], "id long, lat double, lon double")
    regions = spark.createDataFrame([(1, ring), (2, [[-90.0, -180.0], [-90.0, 180.0], [90.0, 180.0], [90.0, -180.0]])], "id long, ring array<array<double>>")
    expected = {(k, 1) for k in range(20) if any(inside(-1.9 + 0.2 * k, -180.0 + 0.1 * k + t, ring) for t in (0, 360))} | {(k, 2) for k in range(20)}
    for sent in (100_000, 0):
        assert {(r["point_id"], r["region_id"]) for r in nearby.containing_regions(points, regions, sent).collect()} == expected
