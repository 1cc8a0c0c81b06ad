"""Problem 4: points near other points, and the regions that contain points.

Near points: latitude is cut into strips a little higher than the radius. A point belongs to its own strip and
is also shown to the strip below, so every close pair meets in exactly one strip, that of its lower point.
Strips are cut into blocks of longitude in the same way (own block, and shown to the block to the west). A
block that holds very many points is cut again, into blocks about two radii wide, so its points are copied once or twice whatever their number. What
is still crowded there is no larger than a few squares whose points are all near each other, so its pairs grow with the square of its points anyway; it is cut into parts, each of
which owns some of the points and sees all, which copies one point for some thousand pairs that come out.
Within a block the points are sorted by longitude and swept: a window of longitudes moves along, what has left
it is forgotten, and each pair in it has its distance computed.

Regions: a ray is cast from the point along its parallel. Few corners are sent to the points. With many, points meet regions in cells
of both axes, of a size that fits the region, so that a region stands in four cells at most; then each pair meets those edges of its region that cross
the point's strip of latitude.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.geo import EARTH_KM
from ..session import cut

#: A block is cut into parts so that none owns more points than about this.
BLOCK_POINTS = 20_000
#: Corners of regions that may be sent to all tasks.
SENT_CORNERS = 100_000
_STRIP_DEGREES = 0.5
#: Numbers of finer blocks within a block.
_SUB_BLOCKS = 1 << 40
#: Pairs of points and corners that are looked at at once.
_AT_ONCE = 2_000_000


def _haversine(lat1, lon1, lat2, lon2):
    a, b = np.radians(lat1), np.radians(lat2)
    s = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(s)))


def _sweep(km: float):
    """Pairs of places from batches sorted by block and longitude; a block may go on in the next batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if batch.empty:
                continue
            old = 0 if held is None else len(held)
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            yield from _pairs(rows, old, km)
            # Active are the points of the last block that a later longitude may still reach.
            last = rows.iloc[-1]
            same = (rows["strip"].to_numpy() == last["strip"]) & (rows["block"].to_numpy() == last["block"]) & (rows["part"].to_numpy() == last["part"])
            held = rows[same & (rows["x"].to_numpy() + rows["reach"].to_numpy() >= last["x"])]

    return run


def _pairs(rows: pd.DataFrame, old: int, km: float) -> Iterator[pd.DataFrame]:
    n = len(rows)
    key = rows[["strip", "block", "part"]].to_numpy()
    group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))]) * 1e4
    x, mine, lat, px = (rows[c].to_numpy() for c in ("x", "mine", "lat", "px"))
    along, reach = x + group, rows["reach"].to_numpy()
    ends = np.minimum(np.searchsorted(along, along + reach + 1e-6, side="right"), np.searchsorted(group, group, side="right"))
    begins = np.maximum(np.arange(n) + 1, old)  # two held points have met before
    # The western point of a pair owns it: in the block where it lies, in the part that it falls to.
    many = np.where((mine & 2 > 0) & (rows["owner"].to_numpy() > 0), np.maximum(0, ends - begins), 0)
    for lo, hi in _slices(many):
        i = np.repeat(np.arange(lo, hi), many[lo:hi])
        if not len(i):
            continue
        j = np.arange(len(i)) - np.repeat(np.cumsum(many[lo:hi]) - many[lo:hi], many[lo:hi]) + begins[i]
        # Its strip is that of its lower point: one of the two must lie in the strip.
        keep = (mine[i] | mine[j]) & 1 > 0
        i, j = i[keep], j[keep]
        keep = _haversine(lat[i], x[i], lat[j], x[j]) <= km
        i, j = i[keep], j[keep]
        yield pd.DataFrame({"a_lat": lat[i], "a_x": px[i], "b_lat": lat[j], "b_x": px[j]})


def _slices(many: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` pairs each, so that no window is expanded at once."""
    total, lo = 0, 0
    for k, m in enumerate(many.tolist()):
        total += m
        if total >= most:
            yield lo, k + 1
            lo, total = k + 1, 0
    if lo < len(many):
        yield lo, len(many)


def near_pairs(points: DataFrame, km: float) -> DataFrame:
    """All pairs of ids with points at most ``km`` kilometres apart on the sphere; ``points`` has id (integer), lat, lon in degrees.

    Returns a_id < b_id, each pair once, however many points an id has. Points with a null are left out, longitudes are taken
    modulo 360, repeated points count once, an id is never its own partner, and an empty table gives an empty result. Other
    columns are ignored. Places are swept once each, whatever number of ids stands there.
    """
    high = math.degrees(km / EARTH_KM) * (1 + 1e-9) + 1e-12
    wide = max(64 * high, 0.25)
    last = math.floor(360 / wide)
    known = points.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.pmod(F.col("lon").cast("double") + 180, F.lit(360.0)).alias("px"))
    known = known.filter("id is not null and lat between -90 and 90 and px is not null and not isnan(px)").distinct()
    phi = F.radians(F.abs("lat"))
    ratio = math.sin(km / EARTH_KM) / F.greatest(F.cos(phi), F.lit(1e-12))
    reach = F.when((phi + km / EARTH_KM >= math.pi / 2) | (ratio >= 1), 360.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9) + 1e-9)
    spots = known.select("lat", "px").distinct().withColumn("reach", reach).withColumn("home_strip", F.floor((F.col("lat") + 90) / high))
    # Past the meridian where longitudes jump, points are shown once more, a turn further on.
    turn = F.explode(F.when(F.col("px") <= F.col("reach"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    spots = spots.withColumn("turn", turn).withColumn("x", F.col("px") + 360 * F.col("turn"))
    # A point is shown to its strip and the one below, and to its block and those that begin within its reach to the west.
    spots = spots.withColumn("strip", F.explode(F.array(F.col("home_strip"), F.col("home_strip") - 1)))
    home = F.floor(F.col("x") / wide)
    spots = spots.withColumn("home", home).withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("x") - F.col("reach")) / wide)), F.col("home"))))
    spots = spots.filter(F.col("block") <= last)
    in_block = (F.col("block") == F.col("home")) & (F.col("turn") == 0)
    spots = spots.withColumn("mine", (F.col("strip") == F.col("home_strip")).cast("int") + 2 * in_block.cast("int"))
    # Crowded blocks are cut finer: two times the longest reach within the strip, which holds points of the strip above, too.
    hot = spots.groupBy("strip", "block").agg(F.count("*").alias("held"), F.max("reach").alias("far")).filter(F.col("held") > BLOCK_POINTS)
    spots = spots.join(hot.select("strip", "block", (2 * F.col("far")).alias("fine")), ["strip", "block"], "left").withColumn("fine", F.least(F.coalesce("fine", F.lit(wide)), F.lit(wide)))
    within, most = F.col("x") - F.col("block") * wide, F.floor((wide - 1e-9) / F.col("fine"))
    spots = spots.withColumn("lies", F.least(F.floor(within / F.col("fine")), most)).withColumn("from", F.greatest(F.lit(0).cast("long"), F.floor((within - F.col("reach")) / F.col("fine"))))
    spots = spots.withColumn("sub", F.explode(F.sequence(F.least("from", "lies"), "lies")))
    spots = spots.withColumn("mine", F.when(F.col("sub") == F.col("lies"), F.col("mine")).otherwise(F.col("mine").bitwiseAND(F.lit(1))))
    spots = spots.withColumn("block", F.col("block") * _SUB_BLOCKS + F.col("sub")).drop("home", "home_strip", "fine", "lies", "from", "sub")
    crowded = spots.groupBy("strip", "block").agg(F.count("*").alias("held")).filter(F.col("held") > BLOCK_POINTS)
    spots = spots.join(crowded.select("strip", "block", F.ceil(F.col("held") / BLOCK_POINTS).cast("int").alias("parts")), ["strip", "block"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spots = spots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spots = spots.withColumn("owner", (F.pmod(F.xxhash64("lat", "px"), F.col("parts")) == F.col("part")).cast("int"))
    swept = (
        spots.select("strip", "block", "part", "x", "px", "lat", "reach", "mine", "owner")
        .repartition("strip", "block", "part")
        .sortWithinPartitions("strip", "block", "part", "x", "lat")
        .mapInPandas(_sweep(km), "a_lat double, a_x double, b_lat double, b_x double")
    )
    # A place is near itself: that matters where several ids stand there.
    shared = known.groupBy("lat", "px").agg(F.count("*").alias("ids")).filter("ids > 1")
    met = swept.unionByName(shared.select(F.col("lat").alias("a_lat"), F.col("px").alias("a_x"), F.col("lat").alias("b_lat"), F.col("px").alias("b_x")))
    one = known.select(F.col("id").alias("i"), F.col("lat").alias("a_lat"), F.col("px").alias("a_x"))
    two = known.select(F.col("id").alias("j"), F.col("lat").alias("b_lat"), F.col("px").alias("b_x"))
    pairs = met.join(one, ["a_lat", "a_x"]).join(two, ["b_lat", "b_x"]).filter("i != j")
    return pairs.select(F.least("i", "j").alias("a_id"), F.greatest("i", "j").alias("b_id")).distinct()


def _corners(regions: DataFrame) -> DataFrame:
    """Edges of the rings: the ring is closed, whether or not its first corner is repeated at its end."""
    ring = F.filter("ring", lambda p: p.isNotNull() & (F.size(p) >= 2) & F.try_element_at(p, F.lit(1)).isNotNull() & F.try_element_at(p, F.lit(2)).isNotNull())
    usable = regions.select(F.col("id").cast("long").alias("region"), ring.alias("ring")).filter("region is not null and size(ring) >= 3")
    edges = usable.select("region", F.size("ring").alias("n"), F.posexplode("ring").alias("k", "p"), "ring")
    after = F.element_at("ring", (F.pmod(F.col("k") + 1, F.col("n")) + 1).cast("int"))
    return edges.select("region", F.col("p")[0].alias("lat1"), F.col("p")[1].alias("lon1"), after[0].alias("lat2"), after[1].alias("lon2"))


_TURNS = (-360.0, 0.0, 360.0)


def _inside(edges):
    """Points of batches against all regions: an odd number of edges lies to the east of a point that is inside.

    A place that many points of a batch share is tested once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = edges.value
        regions, begins = np.unique(e["region"], return_index=True)
        ends = np.append(begins[1:], len(e["region"]))
        for batch in batches:
            ident = batch["point_id"].to_numpy()
            # Places come sorted by latitude.
            places, place = np.unique(batch[["lat", "lon"]].to_numpy(), axis=0, return_inverse=True)
            place = place.reshape(-1)
            lat, lon = places[:, 0], places[:, 1]
            for r, b, t in zip(regions, begins, ends):
                la, lo, lb, lp = (e[c][b:t] for c in ("lat1", "lon1", "lat2", "lon2"))
                low, up = np.searchsorted(lat, la.min(), side="left"), np.searchsorted(lat, la.max(), side="right")
                west, east = lo.min(), lo.max()
                here = lon[low:up]
                boxed = np.zeros(len(here), bool)
                for turn in _TURNS:
                    boxed |= (here + turn >= west) & (here + turn <= east)
                near = low + np.nonzero(boxed)[0]
                if not len(near):
                    continue
                hit = np.zeros(len(places), bool)
                step = max(1, _AT_ONCE // len(la))
                for k in range(0, len(near), step):
                    some = near[k : k + step]
                    y = lat[some, None]
                    cross = (la > y) != (lb > y)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        at = lo + (y - la) / (lb - la) * (lp - lo)
                    for turn in _TURNS:
                        hit[some] |= (cross & (lon[some, None] + turn < at)).sum(axis=1) % 2 == 1
                inside = ident[hit[place]]
                if len(inside):
                    yield pd.DataFrame({"point_id": inside, "region_id": np.full(len(inside), r)})

    return run


def containing_regions(points: DataFrame, regions: DataFrame, sent_corners: int = SENT_CORNERS) -> DataFrame:
    """Each point with each region whose ring holds it: point_id, region_id.

    ``points`` has id, lat, lon; ``regions`` has id, ring (corners [lat, lon]; either direction; closed or not; longitudes may
    run beyond 180) and unique ids. Edges are straight in degrees; a point on an edge counts as inside for one of the two sides
    only. Points with a null, rings of fewer than three corners and corners with a null are left out. Repeated points count each.
    Up to ``sent_corners`` corners are sent to all tasks, which then need no shuffle; beyond the join by cells is used.
    """
    spark = points.sparkSession
    asked = points.select(F.col("id").cast("long").alias("point_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    asked = asked.filter("point_id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    edges = _corners(regions)
    if edges.limit(sent_corners + 1).count() <= sent_corners:
        pdf = edges.orderBy("region").toPandas()
        if pdf.empty:
            return asked.filter("false").select("point_id", F.lit(0).cast("long").alias("region_id"))
        sent = spark.sparkContext.broadcast({c: pdf[c].to_numpy() for c in pdf.columns})
        return asked.mapInPandas(_inside(sent), "point_id long, region_id long")
    box = edges.groupBy("region").agg(F.min("lat1").alias("south"), F.max("lat1").alias("north"), F.min("lon1").alias("west"), F.max("lon1").alias("east"))
    # A cell is as wide as the region, rounded up to a power of two, so that the region stands in at most four.
    size = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"), F.lit(_STRIP_DEGREES))
    box = cut(box.withColumn("level", F.ceil(F.log2(size / _STRIP_DEGREES)).cast("int")).withColumn("wide", _STRIP_DEGREES * F.pow(F.lit(2.0), F.col("level"))))
    levels = [r[0] for r in box.select("level").distinct().collect()]  # few: a level is a power of two of degrees
    west, east = box.agg(F.min("west"), F.max("east")).first()
    spans = lambda low, up: F.sequence(F.floor(F.col(low) / F.col("wide")), F.floor(F.col(up) / F.col("wide")))
    cells = box.withColumn("row", F.explode(spans("south", "north"))).withColumn("column", F.explode(spans("west", "east")))
    places = asked.select("lat", "lon").distinct().withColumn("turn", F.explode(F.array(*(F.lit(t) for t in _TURNS)))).withColumn("x", F.col("lon") + F.col("turn")).filter(F.col("x").between(west, east))
    placed = places.withColumn("level", F.explode(F.array(*(F.lit(n) for n in levels)))).withColumn("wide", _STRIP_DEGREES * F.pow(F.lit(2.0), F.col("level")))
    placed = placed.withColumn("row", F.floor(F.col("lat") / F.col("wide"))).withColumn("column", F.floor(F.col("x") / F.col("wide"))).drop("wide")
    boxed = placed.join(cells, ["level", "row", "column"]).filter("lat between south and north and x between west and east").select("lat", "lon", "turn", "x", "region")
    low, up = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    strips = edges.withColumn("strip", F.explode(F.sequence(F.floor(low / _STRIP_DEGREES), F.floor(up / _STRIP_DEGREES))))
    at = F.col("lon1") + (F.col("lat") - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) * (F.col("lon2") - F.col("lon1"))
    met = boxed.withColumn("strip", F.floor(F.col("lat") / _STRIP_DEGREES)).join(strips, ["region", "strip"]).filter((F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat")))
    odd = met.groupBy("lat", "lon", "turn", "region").agg(F.sum((F.col("x") < at).cast("int")).alias("n")).filter("n % 2 = 1")
    return asked.join(odd.select("lat", "lon", "region").distinct(), ["lat", "lon"]).select("point_id", F.col("region").alias("region_id"))
