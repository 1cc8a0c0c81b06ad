"""Queries of the workflow from declarations to scored answers, each with the same result in SQL where SQL can express it.

SQL is written for DuckDB and runs on the whole tables, as the queries do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import fixed, geo
from ..functions.text import one_line
from ..operators import events, images, links, ordered, parsing, places, questions, records, scores
from ..sources.tables import table
from .registry import QUERIES, SQL

#: Phrases of statements that report nothing: the usual ones, and those of these tables.
QUIET = (*fixed.NO_EVENT_READ, "ties no event", "No change could be placed", "Nothing visible was reported")
QUIET_TEMPLATED = (*fixed.NO_EVENT_TEMPLATED, "ties no event", "No change could be placed", "Nothing visible was reported")
#: Substrings of addresses to drop, with one that occurs in these tables.
UNWANTED = (*fixed.BLACKLIST, "alert-")

#: What an event has without bound (links, texts, image paths) is given in ordered parts of at most so many.
PART = 100


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _holds(column: str, phrases) -> str:
    return "(" + " or ".join(f"contains({column}, '{p}')" for p in phrases) + ")"


# Shared SQL: dated statements (st), events of questions (ev), image dates (im, imd), places of packed lines (pl), first declarations (de).
_FLAT = "translate(statements, chr(10) || chr(13) || chr(9), '   ')"
_ST = rf"""st0 as (select row_id, event_id, regexp_extract_all(f, '(\d{{4}}-\d{{2}}-\d{{2}}):\s*', 1) ds, regexp_split_to_array(f, '\d{{4}}-\d{{2}}-\d{{2}}:') ts
  from (select row_id, event_id, {_FLAT} f from consolidated where statements is not null)),
st as (select row_id, event_id, (i - 1)::int as pos, ds[i] as date, regexp_replace(ts[i + 1], '^\s+|\s+$', '', 'g') as statement from (select *, unnest(range(1, len(ds) + 1)) i from st0)),
sq as (select *, {_holds("statement", QUIET)} as is_no_event from st)"""
_EV = f"{_ST}, ev as (select row_id, event_id, pos, date, statement as event from st where not {_holds('statement', QUIET_TEMPLATED)})"
_IM = r"""im as (select distinct folder_id, path, nullif(regexp_extract(regexp_extract(path, '[^/]*$'), '\d{4}-\d{2}-\d{2}'), '') as image_date from (select folder_id, unnest(video) as path from train_total) where path is not null and folder_id is not null),
imd as (select distinct folder_id, image_date from im where image_date is not null)"""
_PL = r"""pl0 as (select line_no, raw_line, unnest(string_split(inner_, '),')) as p, unnest(range(len(string_split(inner_, '),'))))::int as pos from (select line_no, raw_line, trim(regexp_extract(raw_line, '\{[^}]*\}'), '{}') as inner_ from packed_rows)),
pl1 as (select line_no, raw_line, pos, string_split(p, ':') h from pl0 where len(string_split(p, ':')) = 2),
pl2 as (select line_no, raw_line, pos, replace(replace(regexp_replace(regexp_replace(regexp_replace(h[1], '[''"]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '/', ' '), '\', ' ') as name, string_split(substr(h[2], 3), ',') e from pl1),
pl3 as (select line_no, raw_line, pos, name, try_cast(trim(e[1]) as double) as lat, try_cast(trim(trim(e[2], ')')) as double) as lon from pl2 where len(e) = 2),
pl as (select line_no, raw_line, pos, name, lat, lon from (select *, row_number() over (partition by line_no, name order by pos desc) rn from pl3 where abs(lat) <= 90 and abs(lon) <= 180) where rn = 1)"""
_DE = "de as (select * from (select *, row_number() over (partition by idx order by loaded_at nulls first, declaration_title nulls first, incident_end_date nulls first) rn from declarations) where rn = 1)"
_CO = r"""co as (select line_no, string_split(raw_line, ',')[1] as id, string_split(raw_line, ',')[2] as url, try_cast(trim(trim(string_split(raw_line, ',')[3], '(')) as double) as clat, try_cast(trim(trim(string_split(raw_line, ',')[4], ')')) as double) as clon from packed_rows where raw_line is not null)"""


_IDX = r"try_cast(nullif(regexp_extract(string_split(raw_line, ',')[1], '^\d+$'), '') as int)"


def _whole_number(c: str):
    """The id of a packed line, which counts only if it is all digits."""
    return F.regexp_extract(c, r"^\d+$", 0).try_cast("int")


def _statements(spark: SparkSession, folder: str, phrases=QUIET) -> DataFrame:
    rows = table(spark, folder, "consolidated", "row_id", "event_id", "statements").filter("statements is not null")
    return rows.select("row_id", "event_id", parsing.dated_statements(F.col("statements"), phrases).alias("st"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with events as questions see them, and the type of their declaration."""
    told = F.filter("st", lambda s: ~s["is_no_event"])
    rows = _statements(spark, folder, QUIET_TEMPLATED).withColumn("events", F.transform(told, lambda s: F.struct(s["pos"].alias("pos"), s["date"].alias("date"), s["statement"].alias("event"))))
    types = _declared(spark, folder).select(F.col("idx").alias("event"), F.col("incident_type").alias("event_type"))
    return events.with_type(rows.drop("st"), types, "event_id")


def _declared(spark: SparkSession, folder: str) -> DataFrame:
    return events.first_rows(table(spark, folder, "declarations"), "idx", "loaded_at", "declaration_title", "incident_end_date")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return events.image_files(table(spark, folder, "train_total", "folder_id", "video"), "folder_id", "video")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "packed_rows", "line_no", "raw_line")


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """Packed lines with their fields by commas and their places; coordinates that are no degrees are left out."""
    on_earth = lambda p: (F.abs(p["lat"]) <= 90) & (F.abs(p["lon"]) <= 180)
    rows = _packed(spark, folder).filter("raw_line is not null").withColumn("f", parsing.comma_fields(F.col("raw_line")))
    found = parsing.place_map(F.col("raw_line"), on_earth)
    return rows.select("line_no", "f.id", "f.url", F.col("f.lat").alias("clat"), F.col("f.lon").alias("clon"), found.alias("places"), "raw_line")


# --- declarations and links -------------------------------------------------------------------------------------------


@query("select idx, concat_ws(' ', " + ", ".join(f"coalesce({c}, 'nan')" for c in ("declaration_title", "incident_type", "designated_area", "state", "incident_begin_date")) + ") as query from declarations")
def search_query_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The search text of each declaration; nulls are written as nan."""
    parts = ("declaration_title", "incident_type", "designated_area", "state", "incident_begin_date")
    return table(spark, folder, "declarations", "idx", *parts).select("idx", links.search_text(*parts).alias("query"))


@query("select event_id, url, rank::int as rank from (select event_id, url, row_number() over (partition by event_id order by min(found_at), url) as rank from articles where url is not null group by event_id, url) where rank <= 5")
def top5_links_per_event(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "articles", "event_id", "url", "found_at").filter("url is not null").groupBy("event_id", "url").agg(F.min("found_at").alias("found_at"))
    return events.top_rows(found, "event_id", 5, "found_at", "url").select("event_id", "url", "rank")


def _in_parts(df: DataFrame, key: str, value: str, order: list) -> DataFrame:
    """key, part (from 0), n, and the values of the part in order as an array; all values of a key stand in its parts."""
    placed = ordered.within(df, key, *order, name="at").withColumn("part", F.floor(F.col("at") / PART).cast("int"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value])
    return placed.groupBy(key, "part").agg(values.alias("values"), F.count("*").alias("n"))


@query("""with l as (select event_id, url, row_number() over (partition by event_id order by found, url) - 1 as k from (select event_id, url, min(found_at) as found from articles where url is not null and event_id is not null group by event_id, url))
select event_id, (k // 100)::int as part, string_agg(url, chr(10) order by k) as links, count(*) as n from l group by event_id, k // 100""")
def links_per_event(spark: SparkSession, folder: str) -> DataFrame:
    """All distinct links of each event in the order in which they were first found, those without a time last, in parts of at most 100."""
    found = table(spark, folder, "articles", "event_id", "url", "found_at").filter("url is not null and event_id is not null").groupBy("event_id", "url").agg(F.min("found_at").alias("found_at"))
    parts = _in_parts(found, "event_id", "url", [F.col("found_at").isNull(), "found_at", "url"])
    return parts.select("event_id", "part", F.array_join("values", "\n").alias("links"), "n")


@query("select try_cast(split_part(line, ',', 1) as int) as event_id, split_part(line, ',', 2) as url from (select event_id || ',' || url || ',' as line from articles where url is not null)")
def link_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Link lines read back: the key before the first comma, the url up to the second, so one with a comma is cut."""
    line = F.concat(F.col("event_id").cast("string"), F.lit(","), F.col("url"), F.lit(","))
    rows = table(spark, folder, "articles", "event_id", "url").filter("url is not null").select(line.alias("line"))
    return rows.select(F.substring_index("line", ",", 1).try_cast("int").alias("event_id"), F.split("line", ",")[1].alias("url"))


@query(f"select event_id, url from articles where url is not null and not {_holds('url', UNWANTED)}")
def url_blacklist_filter(spark: SparkSession, folder: str) -> DataFrame:
    return links.kept_links(table(spark, folder, "articles", "event_id", "url"), unwanted=UNWANTED)


@query(f"with {_IM} select distinct event_id, url from articles where url is not null and event_id not in (select folder_id from imd group by folder_id having count(*) >= 5)")
def skip_processed_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Links of events that are not done yet, done being those with five image dates."""
    done = events.image_dates(_files(spark, folder)).filter(F.size("dates") >= 5)
    open_ = table(spark, folder, "articles", "event_id", "url").filter("url is not null and event_id is not null").distinct()
    return open_.join(done, open_["event_id"] == done["event"], "left_anti")


@query("""with d as (select doc_id, event_id, text, row_number() over (partition by event_id order by crawled_at, doc_id) - 1 as k from documents where event_id is not null and text is not null)
select event_id, (k // 100)::int as part, string_agg(text || chr(10), '' order by k) as article, count(*) as n from d group by event_id, k // 100""")
def article_concat(spark: SparkSession, folder: str) -> DataFrame:
    """All texts of each event after one another, each with a line end, in parts of at most 100 texts; the parts of an event joined in order are its article."""
    docs = table(spark, folder, "documents", "doc_id", "event_id", "text", "crawled_at").filter("event_id is not null and text is not null")
    parts = _in_parts(docs, "event_id", "text", [F.col("crawled_at").isNull(), "crawled_at", "doc_id"])
    return parts.select("event_id", "part", F.concat(F.array_join("values", "\n"), F.lit("\n")).alias("article"), "n")


def _page(title, text):
    """A page around a text, with much that is no paragraph; the paragraphs are written in several ways."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    head = F.coalesce(F.concat(F.lit("<TITLE>"), safe(title), F.lit("</TITLE>")), F.lit(""))
    body = F.replace(safe(text), F.lit("\n\n"), F.lit("</P><svg><path d='M0'/></svg><div>menu</div><p id=\"b\">"))
    return F.concat(F.lit("<html><head>"), head, F.lit("<script>var p = '<p>no</p>';</script></head><body><pre>code</pre><!-- <p>no</p> --><P class='a'>"), body, F.lit("<p>end <b>of</b> page</body></html>"))


# The SQL states what stands in the paragraphs from the text itself, without any page.
@query("select doc_id, coalesce(source, 'No title found') as title, replace(text, chr(10) || chr(10), ' ') || ' end of page' as content from documents where text is not null")
def html_title_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source", "text").filter("text is not null").withColumn("html", _page(F.col("source"), F.col("text")))
    return docs.select("doc_id", parsing.html_parts(F.col("html")).alias("h")).select("doc_id", "h.title", "h.content")


# --- images -----------------------------------------------------------------------------------------------------------


@query(f"with {_IM} select folder_id as event_id, string_agg(image_date, ',' order by image_date) as dates from imd group by folder_id")
def image_dates_from_names(spark: SparkSession, folder: str) -> DataFrame:
    return events.image_dates(_files(spark, folder)).select(F.col("event").alias("event_id"), F.array_join("dates", ",").alias("dates"))


@query(f"""with {_IM}, k as (select folder_id, path, row_number() over (partition by folder_id order by path) - 1 as k from im)
select folder_id as event_id, (k // 100)::int as part, count(*) as n, string_agg(path, ',' order by k) as paths, sum(contains(regexp_extract(path, '[^/]*$'), 'cloud')::int)::bigint as masks from k group by folder_id, k // 100""")
def image_paths_per_event(spark: SparkSession, folder: str) -> DataFrame:
    """All image paths of each event in order, in parts of at most 100, and how many of them are cloud masks."""
    parts = _in_parts(_files(spark, folder), "event", "path", ["path"])
    masks = F.size(F.filter("values", lambda p: F.contains(F.substring_index(p, "/", -1), F.lit("cloud")))).cast("long")
    return parts.select(F.col("event").alias("event_id"), "part", "n", F.array_join("values", ",").alias("paths"), masks.alias("masks"))


@query(
    """select l_returnflag, count(*) as n, sum(clear::int)::bigint as clear, round(sum(case when clear then l_extendedprice / 10000 else 0 end), 4) as reflectance, sum(case when l_linenumber % 3 <> 0 then 255 else 0 end)::bigint as mask
from (select *, ((l_orderkey % 4096) & 1024) = 0 and ((l_orderkey % 4096) & 2048) = 0 as clear from lineitem) group by l_returnflag"""
)
def cloud_bit_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Quality bits 10 and 11 must both be zero; clear values are scaled, masks are made of two values."""
    rows = table(spark, folder, "lineitem", "l_returnflag", "l_orderkey", "l_extendedprice", "l_linenumber")
    qa = F.pmod("l_orderkey", F.lit(4096))
    mask, value = images.two_valued(F.col("l_linenumber") % 3), F.coalesce(images.reflectance(F.col("l_extendedprice"), qa), F.lit(0.0))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(images.clear_sky(qa)).alias("clear"), F.round(F.sum(value), 4).alias("reflectance"), F.sum(mask).cast("long").alias("mask"))


_PX = "list_transform(embedding, lambda x: (floor(abs(x::double) * 1000)::int % 256))"


def _pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Images of 8 x 8 pixels made of the embeddings, as portable graymaps: some dark, some masks, some taken before, some that can't be read, some folders with one file."""
    pixels = F.transform("embedding", lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 1000).cast("int"), F.lit(256)))
    pixels = F.when(F.col("vec_id") % 5 == 0, F.transform(pixels, lambda x: (x % 20).cast("int"))).otherwise(pixels)
    digits = F.array_join(F.transform(pixels, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    kind = F.element_at(F.array(*(F.lit(k) for k in ("", "cloud_", "before_", ""))), (F.col("vec_id") % 4 + 1).cast("int"))
    name = F.concat(kind, F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 7 == 0, ".txt").otherwise(".pgm"))
    event = F.when(F.col("vec_id") % 11 == 0, F.concat(F.lit("s"), F.col("vec_id").cast("string"))).otherwise(F.floor(F.col("vec_id") / 10).cast("string"))
    rows = table(spark, folder, "embeddings", "vec_id", "embedding").select(event.alias("folder"), name.alias("name"), F.concat(F.when(F.col("vec_id") % 13 == 0, F.lit("P9")).otherwise("P5").cast("binary"), F.lit(" 8 8 255\n").cast("binary"), F.unhex(digits)).alias("content"))
    return rows.select(F.concat("folder", F.lit("/"), "name").alias("path"), "folder", "name", "content")


_PICTURES_SQL = f"""p as (select vec_id, case when vec_id % 11 = 0 then 's' || vec_id else (vec_id // 10)::varchar end as folder, ['', 'cloud_', 'before_', ''][vec_id % 4 + 1] || vec_id || case when vec_id % 7 = 0 then '.txt' else '.pgm' end as name,
  case when vec_id % 13 <> 0 then case when vec_id % 5 = 0 then list_transform({_PX}, lambda x: x % 20) else {_PX} end end as px from embeddings),
s as (select folder, name, list_avg(px) as mean, list_unique(px)::bigint as kinds, case when px is not null then len(list_filter(px, lambda x: x = 0)) end as zeros, count(*) over (partition by folder) as files from p)"""


@query(
    f"""with {_PICTURES_SQL} select folder, name, round(mean, 6) as mean, kinds, zeros,
  files > 1 and (name not like '%.pgm' or contains(name, 'cloud') or (coalesce(mean between 25 and 240 and kinds >= 3 and zeros <= 13107.2, false) and not contains(name, 'before'))) as keep from s"""
)
def array_validity_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of images and which are kept: not too dark or bright, three values or more, few zeros, not alone in the folder, not from before."""
    kept = images.kept_images(images.image_statistics(_pictures(spark, folder)))
    return kept.select("folder", "name", F.round("mean", 6).alias("mean"), "kinds", "zeros", "keep")


@query(f"with {_PICTURES_SQL} select folder, name, case when mean > 200 then 'drop' when mean < 30 then 'retry' else 'keep' end as first_try, case when mean > 200 then 'drop' else 'keep' end as second_try from s")
def download_choices(spark: SparkSession, folder: str) -> DataFrame:
    """What to do with each download by its brightness; an image that can't be read is left as it is."""
    seen = images.image_statistics(_pictures(spark, folder))
    return seen.select("folder", "name", images.download_choice(F.col("mean")).alias("first_try"), images.download_choice(F.col("mean"), True).alias("second_try"))


# --- packed text ------------------------------------------------------------------------------------------------------


@query(f"with {_ST} select row_id, pos, date, statement, is_no_event from sq")
def dated_statement_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _statements(spark, folder).select("row_id", F.explode("st").alias("s")).select("row_id", "s.pos", "s.date", "s.statement", "s.is_no_event")


@query(
    rf"""with t as (select row_id, trim({_FLAT}, '[]''') as f from consolidated where statements is not null),
y as (select row_id, list_concat([''], regexp_extract_all(f, '\d{{4}}-')) as ys, regexp_split_to_array(f, '\d{{4}}-') as rs from t),
p as (select row_id, (i - 1)::int as pos, ys[i] as year, rs[i] as rest from (select *, unnest(range(1, len(ys) + 1)) as i from y)),
e as (select row_id, pos, year || regexp_replace(split_part(rest, ':', 1), '^\s+|\s+$', '', 'g') as date, substr(rest, strpos(rest, ':') + 1) as event from p where strpos(rest, ':') > 0)
select row_id, pos, date, regexp_replace(event, '^\s+|\s+$', '', 'g') as event from e where not {_holds("event", QUIET_TEMPLATED)}"""
)
def event_list_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "consolidated", "row_id", "statements").filter("statements is not null")
    return rows.select("row_id", F.explode(parsing.event_list(F.col("statements"), QUIET_TEMPLATED)).alias("e")).select("row_id", "e.pos", "e.date", "e.event")


@query(f"with {_PL} select line_no, pos, name, lat, lon from pl")
def location_map_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _places(spark, folder).select("line_no", F.explode("places").alias("p")).select("line_no", "p.pos", "p.name", "p.lat", "p.lon")


@query(
    r"""select row_id, (i - 1)::int as pos, parts[i] as name from (select row_id, parts, unnest(range(1, len(parts) + 1)) as i from
(select row_id, string_split(case when regexp_matches(locations, '\[[^\]]*\]') then regexp_extract(locations, '\[([^\]]*)\]', 1) else locations end, ',') as parts from consolidated where locations is not null))"""
)
def place_list_slice(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "consolidated", "row_id", "locations").filter("locations is not null")
    return rows.select("row_id", F.posexplode(parsing.place_list(F.col("locations"))).alias("pos", "name"))


@query(
    r"""with l as (select line_no, raw_line, sum(regexp_matches(raw_line, '^\d+,')::int) over (order by line_no) as g from packed_rows where raw_line is not null and raw_line <> '')
select case when g = 0 then -1 else min(line_no) end as first, string_agg(raw_line, '' order by line_no) as record from l group by g"""
)
def record_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.reassembled(_packed(spark, folder), "line_no", "raw_line")


_RECORD = r"""^(\d+),(.*?),\((.*?)\),(.*?),\[(.*?)\]"?$"""


@query(
    rf"""select line_no, regexp_extract(l, '{_RECORD}', 1) as id, regexp_extract(l, '{_RECORD}', 2) as url, regexp_extract(l, '{_RECORD}', 3) as coordinates, replace(regexp_extract(l, '{_RECORD}', 4), '"', '') as locations, regexp_extract(l, '{_RECORD}', 5) as statements
from (select line_no, regexp_replace(raw_line, '[ \r\t]+$', '') as l from packed_rows) where regexp_matches(l, '{_RECORD}')"""
)
def csv2_record_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).select("line_no", parsing.record_fields(F.col("raw_line")).alias("r")).filter("r is not null").select("line_no", "r.*")


@query(rf"with {_CO} select line_no, id, url, clat as lat, clon as lon from co where clat is not null and clon is not null and abs(clat) <= 90 and abs(clon) <= 180")
def csv2_comma_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _places(spark, folder).filter("abs(clat) <= 90 and abs(clon) <= 180").select("line_no", "id", "url", F.col("clat").alias("lat"), F.col("clon").alias("lon"))


@query(
    """with l as (select string_split(concat_ws(',', idx, coalesce(incident_type, ''), incident_begin_date, coalesce(incident_end_date, ''), state, coalesce(designated_area, ''), declaration_title, coalesce(lat::varchar, ''), coalesce(lon::varchar, '')), ',') as p from declarations)
select p[1] as id, p[2] as event_type, p[3] as start_date, p[4] as end_date, p[5] as state, p[6] as county, p[7] as name, try_cast(p[8] as double) as latitude, try_cast(p[9] as double) as longitude from l where len(p) >= 9 and try_cast(p[8] as double) is not null and try_cast(p[9] as double) is not null"""
)
def positional_attributes(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "declarations")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws(",", F.col("idx").cast("string"), text("incident_type"), "incident_begin_date", text("incident_end_date"), "state", text("designated_area"), "declaration_title", text("lat"), text("lon"))
    return d.select(parsing.positional_fields(line).alias("f")).filter("f is not null").select("f.*")


# --- statements and image dates ---------------------------------------------------------------------------------------

_KEPT = f"""{_ST}, {_IM}, dn as (select folder_id, count(*) as n_dates from imd group by folder_id having count(*) <= 8),
kept as (select row_id, event_id, count(*) as n_statements, sum((not is_no_event)::int)::bigint as told from sq group by row_id, event_id having bool_or(not is_no_event))"""


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return events.kept_rows(_statements(spark, folder), events.image_dates(_files(spark, folder)), "event_id", "st")


@query(f"with {_KEPT} select row_id, n_statements, told, n_dates from kept join dn on event_id = folder_id")
def row_skip_rules(spark: SparkSession, folder: str) -> DataFrame:
    told = F.size(F.filter("st", lambda s: ~s["is_no_event"])).cast("long")
    return _kept(spark, folder).select("row_id", F.size("st").cast("long").alias("n_statements"), told.alias("told"), F.size("dates").cast("long").alias("n_dates"))


_BUCKETS = f"""{_KEPT}, ranges as (select i.folder_id, i.image_date, lag(i.image_date, 1, '0000-00-00') over (partition by i.folder_id order by i.image_date) as start from imd i join dn using (folder_id)),
b as (select k.row_id, r.image_date, coalesce(string_agg(s.statement, ' ' order by s.date, s.pos), '{fixed.FILLER}') as statements from kept k join ranges r on k.event_id = r.folder_id
  left join sq s on s.row_id = k.row_id and not s.is_no_event and s.date > r.start and s.date <= r.image_date group by k.row_id, r.image_date)"""


@query(f"with {_BUCKETS} select row_id, image_date, statements from b")
def consolidate_statements(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: statements assigned to the image that first shows them."""
    return events.consolidated(_kept(spark, folder), "row_id", "st")


@query(f"with {_BUCKETS} select row_id, '[' || string_agg(image_date || ': ' || statements || ' ', '' order by image_date) || ']' as consolidated from b group by row_id")
def consolidated_text(spark: SparkSession, folder: str) -> DataFrame:
    return events.repacked(consolidate_statements(spark, folder), "row_id")


_CASE_TYPE = "case " + " ".join(f"when {_holds('lower(t)', w)} then '{n}'" for n, w in fixed.EVENT_KEYWORDS.items()) + " else 'Unknown' end"
_CASE_PHRASE = "case " + " ".join(f"when contains(lower(t), '{p}') then '{p}'" for p in fixed.EVENT_PHRASES) + f" else coalesce(nullif(regexp_extract(t, '{fixed.DESCRIPTION}', 1), ''), 'event') end"


@query(f"with {_EV} select row_id, {_CASE_TYPE} as keyword_type, {_CASE_PHRASE} as description from (select row_id, string_agg(event, ' ' order by pos) as t from ev group by row_id)")
def event_keyword_class(spark: SparkSession, folder: str) -> DataFrame:
    """What the events of a row are, by the words of their joined texts; statements that report nothing are no events."""
    told = F.array_join(F.transform("events", lambda e: e["event"]), " ")
    rows = _events(spark, folder).filter(F.size("events") > 0).select("row_id", told.alias("t"))
    return rows.select("row_id", events.keyword_type(F.col("t")).alias("keyword_type"), events.description(F.col("t")).alias("description"))


_BEGIN = f"""coalesce(arg_min(date, pos) filter ({_holds("lower(event)", fixed.BEGINNING)}), arg_min(date, pos) filter (length(event) > 20 and not contains(event, 'No known significant events')), arg_min(date, pos))"""


@query(f"with {_EV} select row_id, {_BEGIN} as begin_date from ev group by row_id")
def event_begin_date(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).filter(F.size("events") > 0).select("row_id", events.begin_date(F.col("events")).alias("begin_date"))


@query(f"with {_EV} select row_id, (row_number() over (partition by row_id order by pos) - 1)::int as n, event as text from ev")
def event_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Events without their dates, by their number in the row."""
    return _events(spark, folder).select("row_id", F.explode(parsing.numbered_texts(F.col("events"))).alias("n", "text"))


# --- places -----------------------------------------------------------------------------------------------------------


@query(f"with {_PL} select line_no, min(lon) as min_lon, min(lat) as min_lat, max(lon) as max_lon, max(lat) as max_lat from pl group by line_no")
def bounding_box(spark: SparkSession, folder: str) -> DataFrame:
    return _places(spark, folder).select("line_no", places.bounding_box(F.col("places")).alias("b")).filter("b is not null").select("line_no", "b.*")


@query(
    f"""with {_PL}, {_DE}, c as (select distinct p.line_no, d.lat as flat, d.lon as flon from pl p join de d on d.idx = {_IDX.replace('raw_line', 'p.raw_line')} where d.lat is not null and d.lon is not null),
pts as (select p.line_no, row_number() over (partition by p.line_no order by p.pos) as k, p.lat, p.lon from pl p join c using (line_no) union all select line_no, 1000000, flat, flon from c),
cand as (select a.line_no, a.k as i, b.k as j, a.lat, b.lon, c.flat, c.flon from pts a join pts b using (line_no) join c using (line_no)),
n as (select cand.line_no, i, j, cand.lat, cand.lon, sum((abs(pts.lat - cand.lat) <= 0.05::double and abs(pts.lon - cand.lon) <= 0.05::double)::int)::int as n from cand join pts using (line_no)
  where cand.lat - 0.05::double <= flat and flat <= cand.lat + 0.05::double and cand.lon - 0.05::double <= flon and flon <= cand.lon + 0.05::double group by all)
select line_no, n, lat, lon from (select *, row_number() over (partition by line_no order by n desc, i, j) as rn from n) where rn = 1"""
)
def best_image_centre(spark: SparkSession, folder: str) -> DataFrame:
    declared = _declared(spark, folder).select("idx", F.col("lat").alias("flat"), F.col("lon").alias("flon"))
    rows = _places(spark, folder).withColumn("idx", _whole_number("id")).join(declared, "idx")
    return places.best_centres(rows, "line_no", "places", "flat", "flon")


@query(f"with {_DE} select idx, lon - 0.05::double as min_lon, lat - 0.05::double as min_lat, lon + 0.05::double as max_lon, lat + 0.05::double as max_lat from de where lat is not null and lon is not null")
def footprint(spark: SparkSession, folder: str) -> DataFrame:
    return _declared(spark, folder).filter("lat is not null and lon is not null").select("idx", *geo.footprint(F.col("lat"), F.col("lon")))


@query(
    """select idx, strftime(try_cast(substr(incident_begin_date, 1, 10) as date), '%Y-%m-%d, %A') as shown, try_cast(substr(incident_begin_date, 1, 10) as date) - 5 as first, try_cast(substr(incident_end_date, 1, 10) as date) + 5 as last from declarations"""
)
def weekday_and_buffer_dates(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "declarations", "idx", "incident_begin_date", "incident_end_date")
    shown = F.date_format(F.try_to_date(F.substring("incident_begin_date", 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd, EEEE")
    return d.withColumn("w", places.window_of(F.col("incident_begin_date"), F.col("incident_end_date"))).select("idx", shown.alias("shown"), "w.first", "w.last")


@query(
    rf"""with {_DE}, e as (select idx as event, lat, lon, try_cast(substr(incident_begin_date, 1, 10) as date) - 5 as first, try_cast(substr(incident_end_date, 1, 10) as date) + 5 as last from de),
i as (select distinct folder_id, id % 3 as source, try_cast(nullif(regexp_extract(path, '\d{{4}}-\d{{2}}-\d{{2}}'), '') as date) as image_date, lat_lon[1][1] as lat, lat_lon[1][2] as lon from (select folder_id, id, lat_lon, unnest(video) as path from train_total)),
m as (select distinct e.event, i.source, i.image_date from e join i on e.event = i.folder_id where i.image_date >= e.first and i.image_date < e.last and abs(i.lat - e.lat) <= 0.05::double and abs(i.lon - e.lon) <= 0.05::double)
select event, source, image_date from (select *, min(source) over (partition by event) as best from m) where source = best"""
)
def catalogue_window_scan(spark: SparkSession, folder: str) -> DataFrame:
    first = F.try_element_at("lat_lon", F.lit(1))
    train = table(spark, folder, "train_total", "id", "folder_id", "video", "lat_lon")
    images = train.select(F.col("folder_id").alias("event_hint"), F.pmod("id", F.lit(3)).alias("source"), F.explode("video").alias("path"), F.try_element_at(first, F.lit(1)).alias("lat"), F.try_element_at(first, F.lit(2)).alias("lon"))
    images = images.withColumn("image_date", F.try_to_date(F.regexp_extract("path", r"\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")).drop("path")
    declared = _declared(spark, folder).withColumn("w", places.window_of(F.col("incident_begin_date"), F.col("incident_end_date")))
    return places.catalogue_scan(declared.select(F.col("idx").alias("event"), "lat", "lon", "w.first", "w.last"), images)


_PIXEL = "trunc((pl.lon - clon) * (512.0::double / 360.0::double) + 256.0::double)::int as x, trunc((pl.lat - clat) * (512.0::double / 180.0::double) + 256.0::double)::int as y"


def _pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Packed lines whose centre is known, each place with its pixel."""
    rows = _places(spark, folder).filter("abs(clat) <= 90 and abs(clon) <= 180")
    pixel = lambda p: F.struct(p["name"].alias("name"), p["lat"].alias("lat"), p["lon"].alias("lon"), geo.to_pixel(p["lon"], F.col("clon"), 360).alias("x"), geo.to_pixel(p["lat"], F.col("clat"), 180).alias("y"), p["pos"].alias("pos"))
    return rows.withColumn("places", F.transform("places", pixel))


@query(f"with {_PL}, {_CO} select line_no, name, {_PIXEL} from pl join co using (line_no) where abs(clat) <= 90 and abs(clon) <= 180")
def geo_to_pixel(spark: SparkSession, folder: str) -> DataFrame:
    return _pixels(spark, folder).select("line_no", F.explode("places").alias("p")).select("line_no", "p.name", "p.x", "p.y")


@query(
    rf"""with {_PL}, {_CO}, px as (select pl.line_no, pl.pos, name, {_PIXEL} from pl join co using (line_no) where abs(clat) <= 90 and abs(clon) <= 180),
s as (select line_no, list(name || chr(1) || name || ' (' || x || ', ' || y || ')' order by pos) as specs from px group by line_no)
select line_no, list_reduce(list_concat([regexp_extract(raw_line, '(?s)\[.*')], coalesce(specs, [])), lambda a, x: regexp_replace(a, '\b\Q' || split_part(x, chr(1), 1) || '\E\b', split_part(x, chr(1), 2), 'g')) as text
from packed_rows join co using (line_no) left join s using (line_no) where abs(clat) <= 90 and abs(clon) <= 180"""
)
def augment_locations(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each packed line with the pixel after every place that it names."""
    rows = _pixels(spark, folder).withColumn("text", F.regexp_extract("raw_line", r"(?s)\[.*", 0))
    return rows.select("line_no", parsing.augmented(F.col("text"), F.col("places")).alias("text"))


@query(f"with {_PL}, g as (select name, arg_min(lat, (line_no, pos)) as lat, arg_min(lon, (line_no, pos)) as lon from pl group by name) select event_id, name, g.lat, g.lon from (select distinct {_IDX} as event_id, name from pl) join g using (name)")
def offline_geocode(spark: SparkSession, folder: str) -> DataFrame:
    """Place names of all lines looked up in a gazetteer, here made of the first place of each name; names that it lacks are dropped."""
    found = _places(spark, folder).select("line_no", _whole_number("id").alias("event_id"), F.explode("places").alias("p"))
    at = F.struct("line_no", "p.pos")
    gazetteer = found.groupBy(F.col("p.name").alias("name")).agg(F.min_by("p.lat", at).alias("lat"), F.min_by("p.lon", at).alias("lon"))
    asked = found.select("event_id", F.col("p.name").alias("name")).distinct()
    return asked.join(gazetteer, "name").select("event_id", "name", "lat", "lon")


# --- questions --------------------------------------------------------------------------------------------------------


def _draw_sql(n: str, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::bigint % ({n}))::int"


def _options_sql(task: str, key: str) -> str:
    """Options and label from pool (list) and correct in the row, ordered by hashes as questions.options() does."""
    generic = ", ".join(f"'{o}'" for o in fixed.GENERIC_OPTIONS)
    filled = f"case when len(pool) < 3 then list_concat(pool, [{generic}]) else pool end"
    others = f"list_filter({filled}, lambda o: o <> correct)"
    md5 = lambda kind: f"md5(concat_ws(':', '{kind}', '{questions.SEED}', '{task}', {key}::varchar, o))"
    ranked = f"list_sort(list_transform({others}, lambda o, i: {{'h': {md5('draw')}, 'i': i, 'o': o}}))"
    taken = f"list_transform(({ranked})[1:3], lambda r: r.o)"
    mixed = f"list_transform(list_sort(list_transform(list_append({taken}, correct), lambda o, i: {{'h': {md5('mix')}, 'i': i, 'o': o}})), lambda r: r.o)"
    return mixed


def _question_sql(ctes: str, source: str, task: str, key: str, question: str, explanation: str) -> str:
    return f"""with {ctes}, q as (select *, {_options_sql(task, key)} as mixed from ({source}))
select {key}, '{task}' as task, {question} as question, array_to_string(list_transform(mixed, lambda o, i: chr((96 + i)::int) || '. ' || o), chr(10)) as options, chr((96 + list_position(mixed, correct))::int) as label, correct, {explanation} as explanation from q"""


def _template_sql(task: str, key: str, **values: str) -> str:
    choices = ", ".join("'" + t + "'" for t in fixed.TEMPLATES[task])
    text = f"([{choices}])[1 + {_draw_sql(str(len(fixed.TEMPLATES[task])), repr(str(questions.SEED)), repr('template'), repr(task), key + '::varchar')}]"
    for name, value in values.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("options", F.array_join("options", "\n"))


_TYPED = f"{_EV}, {_DE}, er as (select ev.*, coalesce(de.incident_type, '{fixed.DEFAULT_TYPE}') as event_type from ev left join de on ev.event_id = de.idx)"


@query(
    _question_sql(
        _TYPED,
        f"select row_id, event_type, {_BEGIN} as correct, list_sort(list_distinct(list(date))) as dates, list_append(list_sort(list_distinct(list(date))), '{fixed.NO_DATE_OPTION}') as pool from er group by row_id, event_type having count(*) >= 2 and count(distinct date) >= 3",
        "temporal_grounding", "row_id",
        _template_sql("temporal_grounding", "row_id", dates="array_to_string(dates, ', ')", event_type="event_type"),
        "'The ' || lower(event_type) || ' began on ' || correct || ' as indicated by the satellite imagery.'",
    )
)
def mcq_temporal(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(questions.temporal_grounding(_events(spark, folder), "row_id"))


_TYPES = ", ".join(f"'{t}'" for t in fixed.EVENT_TYPES)


@query(
    _question_sql(
        _TYPED,
        f"select distinct row_id, event_type as correct, [{_TYPES}] as pool from er where not contains(lower(event_type), 'disaster')",
        "event_type", "row_id", _template_sql("event_type", "row_id"), "'The satellite images show a ' || lower(correct) || ' event.'",
    )
)
def mcq_event_type(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(questions.event_type(_events(spark, folder), "row_id"))


_SEQUENCE = ", ".join(
    f"list_transform(list_sort(list_transform(s, lambda e: {{'h': md5(concat_ws(':', '{questions.SEED}', 'order', '{k}', row_id::varchar, e.pos::varchar)), 'e': e}})), lambda m: m.e) as s{k}" for k in range(3)
)


def _told_sql(s: str) -> str:
    return f"array_to_string(list_transform(({s})[1:3], lambda e: e.date || ': ' || substr(e.event, 1, 30) || '...'), '; ')"


_SWAPPED = [f"case when s{k} = s then list_concat([s{k}[2], s{k}[1]], s{k}[3:]) else s{k} end" for k in range(3)]


@query(
    _question_sql(
        f"{_TYPED}, sq0 as (select row_id, event_type, list_sort(list({{'date': date, 'pos': pos, 'event': event}})) as s from er group by row_id, event_type having count(*) >= 3), sq1 as (select *, {_SEQUENCE} from sq0)",
        f"select row_id, event_type, s, {_told_sql('s')} as correct, [{_told_sql('s')}, {', '.join(_told_sql(x) for x in _SWAPPED)}] as pool from sq1",
        "event_sequence", "row_id",
        _template_sql("event_sequence", "row_id", event_type="event_type", dates="array_to_string(list_sort(list_distinct(list_transform(s, lambda e: e.date))), ', ')"),
        "'The correct sequence of events is: ' || correct",
    )
)
def mcq_sequence(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(questions.event_sequence(_events(spark, folder), "row_id"))


def _place_rows(spark: SparkSession, folder: str) -> DataFrame:
    told = parsing.event_list(F.regexp_extract("raw_line", r"\[[^\]]*\]", 0), QUIET_TEMPLATED)
    rows = _pixels(spark, folder).withColumn("events", told)
    types = _declared(spark, folder).select(F.col("idx").alias("event"), F.col("incident_type").alias("event_type"))
    return events.with_type(rows.withColumn("event_id", _whole_number("id")), types, "event_id")


_PLACED = rf"""{_PL}, {_CO}, {_DE}, px as (select pl.line_no, pl.raw_line, pl.pos, name, lat, lon, {_PIXEL} from pl join co using (line_no) where abs(clat) <= 90 and abs(clon) <= 180),
le as (select line_no, raw_line, trim(translate(regexp_extract(raw_line, '\[[^\]]*\]'), chr(10) || chr(13) || chr(9), '   '), '[]''') as f from packed_rows),
lr as (select line_no, unnest(regexp_split_to_array(f, '\d{{4}}-')) as rest from le),
lv as (select distinct line_no from lr where strpos(rest, ':') > 0 and not {_holds("substr(rest, strpos(rest, ':') + 1)", QUIET_TEMPLATED)}),
ps as (select px.line_no, px.raw_line, list({{'name': px.name, 'lat': px.lat, 'lon': px.lon, 'x': px.x, 'y': px.y}} order by pos) as ps from px semi join lv using (line_no) group by px.line_no, px.raw_line having count(*) >= 2),
pt as (select ps.*, coalesce(de.incident_type, '{fixed.DEFAULT_TYPE}') as event_type from ps left join de on {_IDX} = de.idx)"""


def _wrong_sql(k: int) -> str:
    return f"'(' || {_draw_sql('512', repr(str(questions.SEED)), repr('x'), repr(str(k)), 'line_no::varchar')} || ', ' || {_draw_sql('512', repr(str(questions.SEED)), repr('y'), repr(str(k)), 'line_no::varchar')} || ')'"


@query(
    _question_sql(
        f"{_PLACED}, pp as (select line_no, event_type, ps[1 + {_draw_sql('len(ps)', repr(str(questions.SEED)), repr('place'), 'line_no::varchar')}] as p from pt)",
        f"select line_no, p, '(' || p.x || ', ' || p.y || ')' as correct, [{', '.join(_wrong_sql(k) for k in range(3))}, '(' || p.x || ', ' || p.y || ')'] as pool from pp",
        "location_identification", "line_no", f"replace('{fixed.TEMPLATES['location_identification'][0]}', '{{location}}', p.name || ' (' || p.lat || ', ' || p.lon || ')')",
        "'The ' || p.name || ' is located at ' || correct || ' as shown in the satellite imagery.'",
    )
)
def mcq_location(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(questions.location_identification(_place_rows(spark, folder), "line_no"))


_DAMAGE = "Which place was damaged most by the {event_type}?"


@query(
    _question_sql(
        f"{_PLACED}, pp as (select line_no, event_type, list_transform(ps, lambda q: q.name) as pool, ps[1 + {_draw_sql('len(ps)', repr(str(questions.SEED)), repr('damage'), 'line_no::varchar')}].name as correct from pt)",
        "select * from pp", "damage_assessment", "line_no", f"replace('{_DAMAGE}', '{{event_type}}', event_type)",
        "'The satellite images show that ' || correct || ' experienced the greatest damage from the ' || lower(event_type) || '.'",
    )
)
def mcq_damage(spark: SparkSession, folder: str) -> DataFrame:
    """Not among the usual questions, for it has no template; this one is the query's own."""
    return _flat(questions.damage_assessment(_place_rows(spark, folder), "line_no", _DAMAGE))


@query(
    f"""with asked as ({SQL["mcq_temporal"]}), rows as (with {_EV} select row_id, event_id, count(distinct date)::int as dates, array_to_string(list_sort(list_distinct(list(date))), ',') as timestamps from ev group by row_id, event_id),
paths as (with {_IM} select folder_id, count(*)::int as images from im group by folder_id), declared as (with {_DE} select idx, lat, lon from de where lat is not null and lon is not null)
select (row_number() over (order by a.row_id) - 1)::bigint as id, a.row_id, r.event_id as folder_id, 'FrameEvents' as dataset, a.task, images, r.dates, r.timestamps,
  '{fixed.INTRODUCTION}(' || d.lat || ', ' || d.lon || '):' || chr(10) || '<video>' || chr(10) || a.question || chr(10) || a.options as human, a.label || ' ' || chr(10) || a.explanation as gpt
from asked a join rows r using (row_id) join paths on r.event_id = paths.folder_id join declared d on r.event_id = d.idx"""
)
def qa_record_build(spark: SparkSession, folder: str) -> DataFrame:
    """Whole records of the templated questions on dates, with images, centre and conversation."""
    rows = _events(spark, folder)
    asked = questions.temporal_grounding(rows, "row_id").join(rows.select("row_id", "event_id", "events"), "row_id")
    # Questions of a hot event would each repeat all its paths: a record refers to them by the event, and only their number is carried here.
    paths = _files(spark, folder).groupBy("event").agg(F.count("*").cast("int").alias("images"))
    declared = _declared(spark, folder).filter("lat is not null and lon is not null").select("idx", "lat", "lon")
    whole = asked.join(paths, asked["event_id"] == paths["event"]).join(declared, F.col("event_id") == F.col("idx"))
    human, gpt = records.templated_turns(F.col("question"), F.col("options"), F.col("label"), F.col("explanation"), F.col("lat"), F.col("lon"))
    dates = F.array_sort(F.array_distinct(F.transform("events", lambda e: e["date"])))
    columns = records.record(F.col("event_id"), F.array().cast("array<string>"), F.col("lat"), F.col("lon"), dates, F.col("task"), human, gpt, "FrameEvents")
    built = whole.select("row_id", "images", *columns)
    return ordered.with_ordinal(built, "row_id", name="id").select(
        "id", "row_id", "folder_id", "dataset", "task", "images", F.size("lat_lon").alias("dates"), F.array_join("timestamps", ",").alias("timestamps"),
        F.col("conversations")[0]["value_text"].alias("human"), F.col("conversations")[1]["value_text"].alias("gpt"),
    )


_SPLIT = "sp as (select row_id, case when row_number() over (order by row_id) - 1 < floor(0.8 * count(*) over ()) then 'train' else 'test' end as split from (select row_id from consolidated where statements is not null and event_id is not null))"


@query(
    f"""with a as (select 0 as k, * from ({SQL["mcq_temporal"]}) union all by name select 1 as k, * from ({SQL["mcq_event_type"]}) union all by name select 2 as k, * from ({SQL["mcq_sequence"]})), {_SPLIT}, shown as (with {_IM} select distinct folder_id from im)
select split, (row_number() over (partition by split order by a.row_id, k) - 1)::bigint as id, a.row_id, a.task, a.question, a.options, a.label, a.explanation
from a join sp using (row_id) join consolidated c using (row_id) where c.event_id in (select folder_id from shown)"""
)
def templated_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """All templated questions of the rows that have images, for both splits by position; ids begin anew in each split."""
    rows = _events(spark, folder).filter("event_id is not null")
    asked = questions.templated(rows, "row_id", [questions.temporal_grounding, questions.event_type, questions.event_sequence])
    shown = rows.join(_files(spark, folder).select(F.col("event").alias("event_id")).distinct(), "event_id", "left_semi").select("row_id")
    split = records.positional_split(rows.select("row_id"), "row_id").select("row_id", "split").join(shown, "row_id", "left_semi")
    numbered = ordered.within(asked.join(split, "row_id"), "split", "row_id", "k", name="id")
    return _flat(numbered).select("split", "id", "row_id", "task", "question", "options", "label", "explanation")


# --- model responses --------------------------------------------------------------------------------------------------

# A response of a model, made of a record with options: its question three times, with the third missing in some and the first broken in some.
_ASKED = "split_part(conversations[1].value_text, chr(10), 3)"
_SHOWN = "array_to_string(list_transform(metadata.all_options, lambda o: upper(o.letter) || ') ' || o.option_text), chr(10))"
_RESPONSE_SQL = f"""'**Question 1:** ' || q || chr(10) || case when id % 7 = 0 then '' else s end || chr(10) || '**Correct Answer 1:** ' || l || chr(10) || chr(10) || '**Question 2:** ' || q || chr(10) || s || chr(10) || '**Correct Answer 2:** ' || l || chr(10)
 || case when id % 5 = 0 then '' else '**Question 3:** ' || q || chr(10) || s || chr(10) || '**Correct Answer 3:** ' || l end"""
_RESPONSES = f"""r as (select id, {_RESPONSE_SQL} as t from (select id, {_ASKED} as q, {_SHOWN} as s, upper(metadata.correct_answer) as l from train_total where task = 'multiple_choice_q_a' and metadata is not null))"""


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "train_total", "id", "task", "conversations", "metadata").filter("task = 'multiple_choice_q_a' and metadata is not null")
    rows = rows.select("id", F.split(F.col("conversations")[0]["value_text"], "\n")[2].alias("q"), F.array_join(F.transform("metadata.all_options", lambda o: F.concat(F.upper(o["letter"]), F.lit(") "), o["option_text"])), "\n").alias("s"), F.upper("metadata.correct_answer").alias("l"))
    return rows.select("id", F.expr(_RESPONSE_SQL.replace("chr(", "char(")).alias("t"))


def _choices_sql() -> str:
    out = []
    for i in (1, 2, 3):
        ask, answer, following = f"**Question {i}:**", f"**Correct Answer {i}:**", f"**Question {i + 1}:**"
        stop = f"strpos(t, '{following}') - 1" if i < 3 else "length(t)"
        said = f"case when strpos(substr(t, aend), '{following}') > 0 then substr(substr(t, aend), 1, strpos(substr(t, aend), '{following}') - 1) else substr(t, aend) end" if i < 3 else "substr(t, aend)"
        out.append(
            f"""select id, {i} as pos, trim(string_split(block, chr(10))[1], ' ' || chr(10)) as question, len(options)::int as n_options, array_to_string(options, '|') as options, answer as correct_answer from (select id, regexp_replace(block, '^\\s+|\\s+$', '', 'g') as block,
  list_filter(list_transform((string_split(regexp_replace(block, '^\\s+|\\s+$', '', 'g'), chr(10)))[2:], lambda o: regexp_replace(o, '^\\s+|\\s+$', '', 'g')), lambda o: regexp_matches(o, '^[ABCD]\\)')) as options, regexp_replace({said}, '^\\s+|\\s+$', '', 'g') as answer
  from (select id, t, substr(t, b, strpos(substr(t, b), '{answer}') - 1) as block, strpos(t, '{answer}') + {len(answer)} as aend, b from (select id, t, strpos(t, '{ask}') + {len(ask)} as b from r where strpos(t, '{ask}') > 0)
    where strpos(substr(t, b), '{answer}') > 0 and b - 1 + strpos(substr(t, b), '{answer}') - 1 <= {stop})) where len(options) > 0 and answer <> ''"""
        )
    return " union all ".join(out)


@query(f"with {_RESPONSES} {_choices_sql()}")
def llm_mcq_parse(spark: SparkSession, folder: str) -> DataFrame:
    found = parsing.generated_choices(_responses(spark, folder), "id", "t")
    shown = F.array_join(F.transform("options", lambda o: F.concat(o["letter"], F.lit(") "), o["text"])), "|")
    return found.select("id", "pos", "question", F.size("options").alias("n_options"), shown.alias("options"), "correct_answer")


_QA_RESPONSE = "'**Question 1:** ' || q || '**Answer 1:** ' || a || chr(10) || '**Question 2:** ' || a || '**Answer 2:** ' || q || case when id % 3 = 0 then '' else '**Question 3:** ' || q || ' **Answer 3:** ' || a end"


@query(
    f"""with r as (select id, {_QA_RESPONSE} as t from (select id, coalesce(conversations[1].value_text, '') as q, coalesce(conversations[2].value_text, '') as a from train_total where task = 'q_a'))
{" union all ".join(rf"select id, {i} as pos, " + rf"regexp_replace(nullif(regexp_extract(t, '(?s)(\*\*Question {i}:\*\*.*?)\*\*Answer {i}:\*\*', 1), ''), '^\*\*Question {i}:\*\*\s*|\s+$', '', 'g') as question, " + (rf"regexp_replace(nullif(regexp_extract(t, '(?s)(\*\*Answer {i}:\*\*.*?)\*\*Question {i + 1}:\*\*', 1), ''), '^\*\*Answer {i}:\*\*\s*|\s+$', '', 'g')" if i < 3 else rf"regexp_replace(nullif(regexp_extract(t, '(?s)\*\*Answer {i}:\*\*.*$'), ''), '^\*\*Answer {i}:\*\*\s*|\s+$', '', 'g')") + " as answer from r" for i in (1, 2, 3))}"""
)
def llm_qa_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "train_total", "id", "task", "conversations").filter("task = 'q_a'")
    rows = rows.select("id", F.coalesce(F.col("conversations")[0]["value_text"], F.lit("")).alias("q"), F.coalesce(F.col("conversations")[1]["value_text"], F.lit("")).alias("a"))
    rows = rows.select("id", F.expr(_QA_RESPONSE.replace("chr(", "char(")).alias("t"))
    return rows.select("id", F.explode(parsing.generated_answers(F.col("t"))).alias("p")).select("id", "p.pos", "p.question", "p.answer")


_INTRO = "'" + fixed.GENERATED_INTRODUCTION.replace("\n", "' || chr(10) || '") + "'"


@query(
    f"""with {_RESPONSES}, c as ({_choices_sql()}), o as (select *, string_split(options, '|') as os from c)
select id, pos, {_INTRO} || question || chr(10) || chr(10) || array_to_string(os, chr(10)) as human, 'The correct answer is ' || correct_answer || ') ' || coalesce(substr(list_filter(os, lambda x: substr(x, 1, 1) = correct_answer)[1], 4), '') as gpt from o"""
)
def generated_mcq_records(spark: SparkSession, folder: str) -> DataFrame:
    """What is asked and answered in records made of a model's responses with options."""
    found = parsing.generated_choices(_responses(spark, folder), "id", "t")
    human, gpt = records.generated_turns(F.col("question"), F.col("options"), F.col("correct_answer"))
    return found.select("id", "pos", human.alias("human"), gpt.alias("gpt"))


@query(f"select id, pos, {_INTRO} || question as human, answer as gpt from ({SQL['llm_qa_parse']}) where question is not null and answer is not null")
def generated_qa_records(spark: SparkSession, folder: str) -> DataFrame:
    """What is asked and answered in records made of a model's free answers; those that lack a part are left out."""
    found = llm_qa_parse(spark, folder).filter("question is not null and answer is not null")
    return found.select("id", "pos", F.concat(F.lit(fixed.GENERATED_INTRODUCTION), "question").alias("human"), F.col("answer").alias("gpt"))


# --- records ----------------------------------------------------------------------------------------------------------


@query("select doc_id, (row_number() over (order by doc_id) - 1)::bigint as ordinal, case when row_number() over (order by doc_id) - 1 < floor(0.8 * count(*) over ()) then 'train' else 'test' end as split from documents")
def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    return records.positional_split(table(spark, folder, "documents", "doc_id"), "doc_id").select("doc_id", "ordinal", "split")


_PARTS = (("temporal_grounding", "event_type", "location_identification"), ("multiple_choice_q_a",), ("q_a",))
_MERGE = "select (row_number() over (order by case when task = 'q_a' then 2 when task = 'multiple_choice_q_a' then 1 else 0 end, id) - 1)::bigint as new_id, id as old_id, task from train_total"


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "train_total", "id", "task").withColumnRenamed("id", "old_id")
    return records.merged([(rows.filter(F.col("task").isin(*tasks)), ["old_id"]) for tasks in _PARTS], "new_id")


@query(_MERGE)
def merge_reid(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder).select("new_id", "old_id", "task")


@query(f"select * from ({_MERGE}) where new_id % 10 = 0")
def tiny_every_10th(spark: SparkSession, folder: str) -> DataFrame:
    """The small variant of the merged set: every tenth record is the feature itself."""
    return records.every(_merged(spark, folder), 10, "new_id").select("new_id", "old_id", "task")


@query(
    f"""select t.id, t.folder_id, coalesce(d.incident_type, '{fixed.DEFAULT_TYPE}') as event_type, d.declaration_title as event_name, d.state, d.designated_area as county
from train_total t left join (select * from (select *, row_number() over (partition by idx order by loaded_at desc nulls last, declaration_title desc nulls last, incident_end_date desc nulls last) rn from declarations) where rn = 1) d on t.folder_id = d.idx"""
)
def attribute_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """Records with the attributes of their declaration; of repeated declarations the last one counts."""
    d = table(spark, folder, "declarations")
    last = events.first_rows(d, "idx", F.col("loaded_at").desc(), F.col("declaration_title").desc(), F.col("incident_end_date").desc())
    train = table(spark, folder, "train_total", "id", "folder_id")
    joined = train.join(last, train["folder_id"] == last["idx"], "left")
    return joined.select("id", "folder_id", F.coalesce("incident_type", F.lit(fixed.DEFAULT_TYPE)).alias("event_type"), F.col("declaration_title").alias("event_name"), "state", F.col("designated_area").alias("county"))


# --- scores -----------------------------------------------------------------------------------------------------------

_RIGHT = "lower(substr(case when coalesce(length(predicted), 0) = 0 then 'F' else predicted end, 1, 1)) = lower(substr(ground_truth, 1, 1))"
_ONCE = f"once as (select *, {_RIGHT} as correct from (select *, row_number() over (partition by model_name, qid order by ans_id) as rn from answers where task <> 'q_a' and length(ground_truth) > 0) where rn = 1)"


def _choices_once(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to questions with choices, one per model and question."""
    rows = table(spark, folder, "answers").filter("task != 'q_a' and length(ground_truth) > 0")
    once = rows.groupBy("model_name", "qid").agg(F.min_by(F.struct("predicted", "ground_truth", "task"), "ans_id").alias("a"))
    return once.select("model_name", "qid", "a.*").withColumn("correct", scores.correct_choice(F.col("predicted"), F.col("ground_truth")))


@query(f"with {_ONCE} select model_name, task, count(*) as questions, sum(correct::int)::bigint as right, round(sum(correct::int) * 100.0::double / count(*), 6) as accuracy from once group by model_name, task")
def mcq_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return scores.accuracy(_choices_once(spark, folder), "model_name", "task").withColumn("accuracy", F.round("accuracy", 6))


@query("select model_name, count(*) as answers, count(distinct qid) as questions, count(distinct length(predicted)) as lengths from answers group by model_name")
def answer_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Answers, questions and distinct lengths per model: whether models can be compared at all."""
    return table(spark, folder, "answers", "model_name", "qid", "predicted").groupBy("model_name").agg(F.count("*").alias("answers"), F.countDistinct("qid").alias("questions"), F.countDistinct(F.length("predicted")).alias("lengths"))


_TABLE = f"{_ONCE}, ct as (select x.model_name as model_1, y.model_name as model_2, count(*) as n, sum((x.correct and not y.correct)::int)::bigint as b, sum((not x.correct and y.correct)::int)::bigint as c from once x join once y on x.qid = y.qid and x.model_name < y.model_name group by 1, 2)"


@query(f"with {_TABLE} select model_1, model_2, n, b, c, case when b + c >= 20 then round((abs(b - c) - 1) ** 2 / (b + c)::double, 6) end as chi2 from ct")
def mcnemar_table(spark: SparkSession, folder: str) -> DataFrame:
    tested = scores.mcnemar(scores.contingency(_choices_once(spark, folder)))
    return tested.select("model_1", "model_2", "n", "b", "c", F.round("chi2", 6).alias("chi2"))


# The tail of the normal distribution by Simpson's rule, and the two-sided binomial test.
_TAIL = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 4001), lambda k: (case when k = 0 or k = 4000 then 1 when k % 2 = 1 then 4 else 2 end) * exp(0 - (z + k * 0.0025) * (z + k * 0.0025)))) * 0.0025 / 3"
_EXACT = "least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: (factorial((b + c)::int) / (factorial(k::int) * factorial((b + c - k)::int)))::double)) / 2::double ** (b + c))"


@query(
    f"""with {_TABLE}, x as (select *, case when b + c >= 20 then (abs(b - c) - 1) ** 2 / (b + c)::double end as chi2 from ct), z as (select *, sqrt(chi2 / 2) as z from x),
p as (select *, case when b + c = 0 then 1 when b + c < 20 then {_EXACT} else {_TAIL} end as p from z)
select model_1, model_2, n, b, c, round(chi2, 6) as chi2, round(p, 6) as p_value, case when p < 0.001 then 'p < 0.001' when p < 0.01 then 'p < 0.01' when p < 0.05 then 'p < 0.05' else 'p > 0.05' end as significance from p"""
)
def mcnemar_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """McNemar's test of all pairs of models, with p-values and their label."""
    tested = scores.mcnemar(scores.contingency(_choices_once(spark, folder)))
    return tested.select("model_1", "model_2", "n", "b", "c", F.round("chi2", 6).alias("chi2"), F.round("p_value", 6).alias("p_value"), "significance")


_JUDGED = " || chr(10) || ".join(f"'{said}: ' || case when ans_id % {k + 11} = 0 then '4.5' else ((ans_id * {k + 1}) % 6)::varchar end || '/5'" for k, said in enumerate(fixed.CRITERIA.values()))
_JUDGE_SQL = ", ".join(rf"coalesce(try_cast(nullif(regexp_extract(t, '{said}:\s*(\d+)/5', 1), '') as int), 0) as {name}" for name, said in fixed.CRITERIA.items())


def _judgements(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for k, said in enumerate(fixed.CRITERIA.values()):
        n = F.when(F.col("ans_id") % (k + 11) == 0, F.lit("4.5")).otherwise((F.col("ans_id") * (k + 1) % 6).cast("string"))
        parts.append(F.concat(F.lit(f"{said}: "), n, F.lit("/5")))
    return table(spark, folder, "answers", "ans_id", "model_name").withColumn("t", F.concat_ws("\n", *parts))


@query(f"select ans_id, {_JUDGE_SQL} from (select ans_id, {_JUDGED} as t from answers)")
def judge_score_parse(spark: SparkSession, folder: str) -> DataFrame:
    return _judgements(spark, folder).select("ans_id", *parsing.judge_scores(F.col("t")))


@query(f"with s as (select model_name, {_JUDGE_SQL} from (select model_name, ans_id, {_JUDGED} as t from answers)) select model_name, count(*) as answers, " + ", ".join(f"round(avg({n}), 6) as {n}" for n in fixed.CRITERIA) + " from s group by model_name")
def judge_averages(spark: SparkSession, folder: str) -> DataFrame:
    parsed = _judgements(spark, folder).select("model_name", *parsing.judge_scores(F.col("t")))
    means = scores.averages(parsed, fixed.CRITERIA, "model_name")
    return means.select("model_name", "answers", *(F.round(n, 6).alias(n) for n in fixed.CRITERIA))


@query(
    r"""select a.ans_id, t.id as question_id, case when contains(q, '>') then string_split(q, '>')[2] else q end as question, t.g as reference from (select *, try_cast(split_part(qid, '_', 1) as int) as n from answers) a
join (select id, conversations[1].value_text as q, conversations[2].value_text as g from test_total) t on t.id = a.n"""
)
def judge_align(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with the bare question and the reference answer that their key names; keys that name none are dropped."""
    given = table(spark, folder, "answers", "ans_id", "qid").withColumn("n", F.substring_index("qid", "_", 1).try_cast("int"))
    asked = table(spark, folder, "test_total", "id", "conversations").select(F.col("id").alias("question_id"), F.col("conversations")[0]["value_text"].alias("q"), F.col("conversations")[1]["value_text"].alias("reference"))
    return given.join(asked, F.col("n") == F.col("question_id")).select("ans_id", "question_id", parsing.bare_question(F.col("q")).alias("question"), "reference")


@query()
def text_scores(spark: SparkSession, folder: str) -> DataFrame:
    """BLEU, METEOR and ROUGE-L of every answer."""
    return scores.text_scores(table(spark, folder, "answers", "ans_id", "predicted", "ground_truth"))


@query()
def text_score_averages(spark: SparkSession, folder: str) -> DataFrame:
    models = table(spark, folder, "answers", "ans_id", "model_name", "task")
    return scores.averages(text_scores(spark, folder).join(models, "ans_id"), scores.METRICS, "model_name", "task")


_GRAMS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"


@query(
    f"""with t as (select ans_id, {_GRAMS.format("predicted")} as p, {_GRAMS.format("ground_truth")} as g from answers),
a as (select ans_id, w, count(*) as n from (select ans_id, unnest(p) as w from t) group by all), b as (select ans_id, w, count(*) as n from (select ans_id, unnest(g) as w from t) group by all),
m as (select ans_id, sum(least(a.n, b.n)) as common from a join b using (ans_id, w) group by ans_id)
select ans_id, round(case when common is null then 0 else common / len(p)::double * case when len(p) > len(g) then 1 else exp(1 - len(g) / len(p)::double) end end, 9) as bleu_1 from t left join m using (ans_id)"""
)
def bleu_1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram precision with its brevity penalty."""
    return text_scores(spark, folder).select("ans_id", F.round("bleu_1", 9).alias("bleu_1"))


_TITLES = [n.replace("_", " ").title() for n in fixed.CRITERIA]
_SHOWN_MEANS = ", ".join(f"format('{{:.2f}}', {n}) as {n}" for n in fixed.CRITERIA)
_REPORT = " || chr(10) || ".join(
    ["'EVALUATION RESULTS'", "repeat('=', 50)", "''", "'Average Scores (0-5 scale):'", *(f"'{t}: ' || {n}" for t, n in zip(_TITLES, fixed.CRITERIA)), "''", "'Table Row (tab-separated):'", "concat_ws(chr(9), " + ", ".join(fixed.CRITERIA) + ")", "''", "'Markdown Table:'",
     "'| " + " | ".join(_TITLES) + " |'", "'|" + "|".join("-------" for _ in _TITLES) + "|'", "'| ' || concat_ws(' | ', " + ", ".join(fixed.CRITERIA) + ") || ' |'", "''"]
)


@query(f"select model_name, {_REPORT} as report from (select model_name, {_SHOWN_MEANS} from ({SQL['judge_averages']}))")
def judge_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The averages of each model as a report."""
    return scores.reports(judge_averages(spark, folder), "model_name", list(fixed.CRITERIA))
