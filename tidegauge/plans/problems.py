"""Queries of the general problems: packed values (1), near points and regions (4), rows that fail to parse (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import parse_point
from ..operators import nearby, packed_values
from ..sources import strict_rows
from ..sources.tables import table
from .registry import QUERIES, SQL


def event_centres(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct centres of events: id, lat, lon; unset and unreadable coordinates are left out."""
    rows = table(spark, folder, "consolidated", "event_id", "coordinates").distinct().withColumn("at", parse_point(F.col("coordinates")))
    return rows.filter("at is not null").select(F.col("event_id").alias("id"), "at.lat", "at.lon").distinct()


def record_centres(spark: SparkSession, folder: str) -> DataFrame:
    """The first pair of lat_lon of each training record: id, lat, lon."""
    first = F.try_element_at("lat_lon", F.lit(1))
    rows = table(spark, folder, "train_total", "id", "lat_lon")
    return rows.select("id", F.try_element_at(first, F.lit(1)).alias("lat"), F.try_element_at(first, F.lit(2)).alias("lon"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = nearby.near_pairs(event_centres(spark, folder), 1.0).select(F.lit("near").alias("kind"), "a_id", "b_id")
    areas = table(spark, folder, "area_rings", "area_id", "ring").withColumnRenamed("area_id", "id")
    inside = nearby.containing_regions(record_centres(spark, folder), areas).select(F.lit("inside").alias("kind"), F.col("point_id").alias("a_id"), F.col("region_id").alias("b_id"))
    both = near.unionByName(inside)
    return both.select("kind", F.col("a_id").cast("int").alias("a_id"), F.col("b_id").cast("int").alias("b_id"))


QUERIES["p4_found"] = p4_found


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed_values.split_packed(table(spark, folder, "consolidated", "row_id", "locations", "statements"), "row_id", "locations", "statements")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return strict_rows.failed_rows(table(spark, folder, "packed_rows", "line_no", "raw_line"))


def p5_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that load: the offset, the id and how much each holds."""
    rows = strict_rows.load_rows(table(spark, folder, "packed_rows", "line_no", "raw_line"))
    return rows.select("line_no", "event_id", "lat", "lon", F.size("locations").alias("places"), F.size("statements").alias("statements"))


QUERIES.update({"p1_found": p1_found, "p5_found": p5_found, "p5_loaded": p5_loaded})


_COORDS = r"\s*:?\s*\(\s*[+-]?\d+(?:\.\d+)?\s*,\s*[+-]?\d+(?:\.\d+)?\s*\)"
_NAMES = r"""'\s*"[^"]*"'|"\s*'[^']*'"|"[^"]*"|'[^']*'|[^,;|/\n\r\t"'\[\]{}()]+""".replace("'", "''")

# Names in quotes (perhaps within other quotes) are whole; the rest is cut at delimiters and brackets.
SQL["p1_found"] = (
    r"with l as (select row_id, list_filter(list_transform(regexp_extract_all(regexp_replace(locations, '{coords}', '', 'g'), '{names}'), lambda v: trim(v, ' ''' || chr(34))), lambda v: v <> '') as items from consolidated where locations is not null), "
    r"s as (select row_id, list_transform(regexp_extract_all(statements, '(\d{4}[-/]\d{2}[-/]\d{2})(?:\s*:|\s+[-–—]\s)', 1), lambda v: replace(v, '/', '-')) as items from consolidated where statements is not null), "
    r"b as (select row_id, 'locations' as field_name, items from l union all select row_id, 'statements', items from s) "
    r"select row_id, field_name, (i - 1)::int as pos, items[i] as item from (select *, unnest(range(1, len(items) + 1)) as i from b where len(items) >= 2)"
).replace("{coords}", _COORDS).replace("{names}", _NAMES)

SQL["p4_found"] = r"""with n as (select distinct event_id, regexp_extract_all(coordinates, '[+-]?\d+(?:\.\d+)?') as v from consolidated where coordinates is not null and event_id is not null),
c as (select distinct event_id, v[1]::double as lat, v[2]::double as lon from n where len(v) = 2),
near as (select distinct a.event_id as a_id, b.event_id as b_id from c a join c b on a.event_id < b.event_id and abs(a.lat - b.lat) < 0.01
  where 2 * 6371.0088 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) <= 1),
r as (select area_id, list_append(ring, ring[1]) as ring from area_rings),
e as (select area_id, ring[k][1] as y1, ring[k][2] as x1, ring[k + 1][1] as y2, ring[k + 1][2] as x2 from (select *, unnest(range(1, len(ring))) as k from r)),
p as (select distinct lat_lon[1][1] as y, lat_lon[1][2] as x from train_total where lat_lon[1][1] is not null and lat_lon[1][2] is not null),
i as (select y, x, area_id, t, sum(1) as n from p, e, (values (-360), (0), (360)) v(t) where (y1 > y) <> (y2 > y) and x + t < x1 + (y - y1) / (y2 - y1) * (x2 - x1) group by all),
h as (select distinct y, x, area_id from i where n % 2 = 1)
select 'near' as kind, a_id, b_id from near union all select 'inside', t.id, h.area_id from train_total t join h on t.lat_lon[1][1] = h.y and t.lat_lon[1][2] = h.x"""
