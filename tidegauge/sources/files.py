"""File sources and sinks of the workflow: link lists, packed text, records and predictions in JSON, image folders, score tables.

All reads name their schema. Writes are committed by Spark's own protocol; where lines were once appended and flushed, a
job appends a file. Rejected files are never deleted: the choice of files is a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import one_line

DECLARATIONS_RAW = "declarationTitle string, incidentType string, designatedArea string, state string, incidentBeginDate string"
DECLARATIONS = "index int, incidentBeginDate string, incidentEndDate string, incidentType string, lat double, lon double"
RECORD = (
    "folder_id int, video array<string>, dataset string, lat_lon array<array<double>>, timestamp array<string>, sensor array<string>, task string, "
    "conversations array<struct<from:string,value:string>>, id int, metadata struct<correct_answer:string,all_options:array<struct<letter:string,text:string>>>"
)
PREDICTION = "map<string, struct<predicted:string,ground_truth:string,task:string>>"


def read_declarations(spark: SparkSession, path: str, schema: str = DECLARATIONS) -> DataFrame:
    """Declarations from CSV with a header; columns are taken by name, others are not read."""
    return spark.read.option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", "_bad").csv(path).select(
        *(F.col(name).try_cast(kind).alias(name) for name, kind in (c.strip().split(" ") for c in schema.split(",")))
    )


def read_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """Lines of text with their number from 0 in the order of the files' names and the lines in them: line_no, line. Blank lines count but are left out unless asked for.

    Within a split lines are numbered as they are read; one row per split tells where it starts. No text is shuffled.
    """
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(split.alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = lines.groupBy("split").agg(F.min("at").alias("least"), F.count("*").alias("n"))
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = splits.select(F.col("split").alias("of"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift"))
    rows = lines if blank else lines.filter(F.trim("line") != "")
    return rows.join(starts, F.col("split") == F.col("of")).select((F.col("at") + F.col("shift")).alias("line_no"), "line")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Link lines "id,url,": event_id, url; a url with a comma is cut there; lines without a whole number are dropped."""
    parts = F.split("line", ",", -1)
    rows = spark.read.text(path).withColumnRenamed("value", "line").select(F.substring_index("line", ",", 1).try_cast("int").alias("event_id"), F.try_element_at(parts, F.lit(2)).alias("url"))
    return rows.filter("event_id is not null and url is not null")


def append_links(links: DataFrame, path: str) -> None:
    """Appends lines "id,url," to the folder."""
    links.select(F.concat_ws(",", F.col("event_id").cast("string"), "url", F.lit(""))).write.mode("append").text(path)


def write_packed(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes lines "id,url,(coordinates),locations,data" with line ends as blanks; ``rows`` has id, url, coordinates, locations, data."""
    line = F.concat(F.col("id").cast("string"), F.lit(","), "url", F.lit(",("), "coordinates", F.lit("),"), "locations", F.lit(","), "data")
    rows.select(one_line(line)).write.mode(mode).text(path)


def read_records(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Question-answer records: one JSON object per line, or ``array`` of them in one file."""
    return spark.read.schema(RECORD).option("multiLine", array).json(path)


def write_records(records: DataFrame, path: str) -> None:
    """Records as one JSON object per line, which needs no closing bracket and so never breaks off."""
    records.write.mode("overwrite").json(path)


def read_predictions(spark: SparkSession, path: str, model: str | None = None, lines: bool = False) -> DataFrame:
    """Predictions from a JSON object keyed by question, one per file or with ``lines`` one per line: qid, predicted, ground_truth, task, and model if named."""
    whole = spark.read.text(path, wholetext=not lines).select(F.from_json("value", PREDICTION).alias("m"))
    rows = whole.select(F.explode("m").alias("qid", "a")).select("qid", "a.predicted", "a.ground_truth", "a.task")
    return rows.withColumn("model_name", F.lit(model)) if model else rows


def write_predictions(rows: DataFrame, path: str, size: int = 1000) -> None:
    """Predictions (qid unique, predicted, ground_truth, task) as JSON objects keyed by question, one per line, each of about ``size`` questions."""
    parts = F.greatest(F.lit(1), F.ceil(F.lit(rows.count() / size)))
    entry = F.struct("qid", F.struct("predicted", "ground_truth", "task").alias("a"))
    objects = rows.groupBy(F.pmod(F.xxhash64("qid"), parts).alias("_part")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    objects.select(F.to_json("m", {"ignoreNullFields": "false"})).write.mode("overwrite").text(path)


def read_models(spark: SparkSession, paths: dict[str, str], lines: bool = False) -> DataFrame:
    """Predictions of several models; files that are missing or can't be read are skipped with a warning."""
    import warnings

    found = None
    for model, path in paths.items():
        try:
            one = read_predictions(spark, path, model, lines)
            one.schema  # resolves the path
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"{model}: {path} is left out ({type(e).__name__})", stacklevel=2)
            continue
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "qid string, predicted string, ground_truth string, task string, model_name string")
    return found


def list_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Files below a folder: path, folder (name of the parent), name, length, and content if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    columns = ["path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.substring_index("path", "/", -1).alias("name"), "length"]
    return files.select(*columns, *(["content"] if content else []))


def event_folders(files: DataFrame) -> DataFrame:
    """Distinct events that have a folder, those named by digits."""
    return files.filter(F.rlike("folder", F.lit(r"^\d+$"))).select(F.col("folder").cast("int").alias("event")).distinct()


def write_scores(scores: DataFrame, path: str) -> None:
    """A score table as CSV with a header."""
    scores.write.mode("overwrite").option("header", True).csv(path)


def write_report(text: str, path: str, spark: SparkSession) -> None:
    """A short text as one file in the folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
