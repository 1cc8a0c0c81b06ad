"""Places of events: bounding boxes, the best centre of a footprint, and the images of a catalogue that fall on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HALF = 0.05
DAYS = 5


def bounding_box(places: Column) -> Column:
    """STRUCT<min_lon, min_lat, max_lon, max_lat> of ARRAY<STRUCT<..., lat, lon>>; null without places."""
    of = lambda f, c: f(F.transform(places, lambda p: p[c]))
    box = F.struct(of(F.array_min, "lon").alias("min_lon"), of(F.array_min, "lat").alias("min_lat"), of(F.array_max, "lon").alias("max_lon"), of(F.array_max, "lat").alias("max_lat"))
    return F.when(F.size(places) > 0, box)


def best_centres(rows: DataFrame, key: str, places: str, lat: str, lon: str, half: float = HALF) -> DataFrame:
    """Of each row the candidate whose square holds the most points and the given point too: key, n, lat, lon.

    Candidates are all latitudes with all longitudes of the points, the given one last; of equal counts the first in that
    order wins. Rows without places or without the given point are left out. A row is expanded to its candidate latitudes and
    put together again without leaving its partition's sort: its places are few.
    """
    known = rows.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.size(places) > 0))
    points = F.concat(F.transform(places, lambda p: F.struct(p["lat"].alias("y"), p["lon"].alias("x"))), F.array(F.struct(F.col(lat).alias("y"), F.col(lon).alias("x"))))
    each = known.select(key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), points.alias("_p")).select(key, "_lat", "_lon", "_p", F.posexplode("_p").alias("_i", "_c"))
    each = each.filter((F.col("_c.y") - half <= F.col("_lat")) & (F.col("_lat") <= F.col("_c.y") + half))
    near = F.filter("_p", lambda p: F.abs(p["y"] - F.col("_c.y")) <= half)
    each = each.select(key, "_lon", F.col("_c.y").alias("lat"), "_i", F.transform(near, lambda p: p["x"]).alias("_near"), F.posexplode(F.transform("_p", lambda p: p["x"])).alias("_j", "lon"))
    each = each.filter((F.col("lon") - half <= F.col("_lon")) & (F.col("_lon") <= F.col("lon") + half))
    counted = each.withColumn("n", F.size(F.filter("_near", lambda x: F.abs(x - F.col("lon")) <= half)))
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("less"), "_i", "_j", "lat", "lon")).alias("b"))
    return best.select(key, (-F.col("b.less")).alias("n"), "b.lat", "b.lon")


def window_of(begin: Column, end: Column, days: int = DAYS) -> Column:
    """STRUCT<first, last>: the dates of an incident with a margin; the last one is not included. Times after the tenth character are cut off."""
    first = F.try_to_date(F.substring(begin, 1, 10), "yyyy-MM-dd")
    last = F.try_to_date(F.substring(end, 1, 10), "yyyy-MM-dd")
    return F.struct(F.date_sub(first, days).alias("first"), F.date_add(last, days).alias("last"))


def catalogue_scan(events: DataFrame, images: DataFrame) -> DataFrame:
    """Images of the best source for each event: event, source, image_date.

    ``events`` has event, lat, lon, first, last; ``images`` event_hint (the equi key that cuts the catalogue), source (0 is the best), image_date
    (DATE), lat, lon. An image counts if it lies on the footprint and its date is from first to before last; of an event's
    sources only the best that has any image counts. Images are made distinct before they meet.
    """
    distinct = images.select("event_hint", "source", "image_date", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct()
    met = events.join(distinct, events["event"] == distinct["event_hint"]).filter(
        (F.col("image_date") >= F.col("first")) & (F.col("image_date") < F.col("last")) & (F.abs(F.col("_lat") - F.col("lat")) <= HALF) & (F.abs(F.col("_lon") - F.col("lon")) <= HALF)
    )
    dated = met.select("event", "source", "image_date").distinct()
    best = F.min("source").over(Window.partitionBy("event"))
    return dated.withColumn("_best", best).filter("source = _best").drop("_best")
