"""Coordinates: parsing, distances on the sphere, pixels of a footprint."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Mean Earth radius in kilometres.
EARTH_KM = 6371.0088

_NUMBER = r"[+-]?\d+(?:\.\d+)?"
#: Two numbers in any usual dress: "(a, b)", "[a, b]", "a b", "lat: a, lon: b"; anything else is no coordinate.
_PAIR = rf"^\s*[(\[]?\s*(?:lat(?:itude)?\s*[:=]\s*)?({_NUMBER})\s*(?:[,;]|\s)\s*(?:lon(?:gitude)?\s*[:=]\s*)?({_NUMBER})\s*[)\]]?\s*$"


def parse_point(text: Column) -> Column:
    """STRUCT<lat, lon> of a coordinate in any of the usual spellings; null if unset, unreadable or out of range.

    Longitudes up to 360 on either side are kept as written.
    """
    text = F.lower(text)
    lat = F.regexp_extract(text, _PAIR, 1).try_cast("double")
    lon = F.regexp_extract(text, _PAIR, 2).try_cast("double")
    fine = F.abs(lat).between(0, 90) & F.abs(lon).between(0, 360)
    return F.when(fine, F.struct(lat.alias("lat"), lon.alias("lon")))


def to_pixel(value: Column, centre: Column, span: float, size: int = 512) -> Column:
    """Pixel of a coordinate: the whole globe (``span`` degrees) over ``size`` pixels, cut toward zero; null if there is none."""
    return ((value - centre) * F.lit(size / span) + F.lit(size / 2)).try_cast("int")


def footprint(lat: Column, lon: Column, half: float = 0.05) -> list[Column]:
    """The four sides of the square of ``2 * half`` degrees around a centre."""
    return [(lon - half).alias("min_lon"), (lat - half).alias("min_lat"), (lon + half).alias("max_lon"), (lat + half).alias("max_lat")]
