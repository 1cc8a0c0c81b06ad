"""Queries through the files of the workflow: tables are written in its formats, read back by its readers, and must be what they were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import scores
from ..session import cut, scratch
from ..sources import files
from ..sources.tables import table
from .reference import judge_averages, query
from .registry import SQL


@query("select idx as event_id, incident_begin_date as begin_date, incident_end_date as end_date, incident_type, lat, lon from declarations")
def declarations_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Declarations from CSV with a header and columns that aren't read."""
    names = {"idx": "index", "incident_begin_date": "incidentBeginDate", "incident_end_date": "incidentEndDate", "incident_type": "incidentType"}
    with scratch(spark) as path:
        table(spark, folder, "declarations").drop("loaded_at").withColumnsRenamed(names).write.option("header", True).csv(path)
        d = cut(files.read_declarations(spark, path))
    return d.select(F.col("index").alias("event_id"), F.col("incidentBeginDate").alias("begin_date"), F.col("incidentEndDate").alias("end_date"), F.col("incidentType").alias("incident_type"), "lat", "lon")


@query("select event_id, string_split(url, ',')[1] as url from articles where url is not null and event_id is not null")
def link_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Links appended as lines in two runs and read back; a url with a comma is cut there."""
    rows = table(spark, folder, "articles", "event_id", "url").filter("url is not null and event_id is not null")
    with scratch(spark) as path:
        files.append_links(rows.filter("event_id % 2 = 0"), path)
        files.append_links(rows.filter("event_id % 2 != 0"), path)
        return cut(files.read_links(spark, path))


@query("select line_no, line from (select (row_number() over (order by line_no) - 1)::bigint as line_no, rtrim(raw_line, chr(13)) as line from packed_rows where raw_line is not null) where trim(line) <> ''")
def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of several files, numbered in the order of the files."""
    with scratch(spark) as path:
        lines = table(spark, folder, "packed_rows", "line_no", "raw_line").filter("raw_line is not null")
        lines.repartitionByRange(5, "line_no").sortWithinPartitions("line_no").select(F.rtrim("raw_line", F.lit("\r"))).write.text(path)
        return cut(files.read_lines(spark, path))


@query("select translate(row_id || ',' || url || ',(' || coordinates || '),' || locations || ',' || statements, chr(10) || chr(13) || chr(9), '   ') as line from consolidated where url is not null and coordinates is not null and locations is not null and statements is not null")
def packed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Consolidated rows as packed lines, overwritten and appended to."""
    rows = table(spark, folder, "consolidated", "row_id", "url", "coordinates", "locations", "statements").dropna()
    rows = rows.select(F.col("row_id").alias("id"), "url", "coordinates", "locations", F.col("statements").alias("data"))
    with scratch(spark) as path:
        files.write_packed(rows.filter("id % 2 = 0"), path)
        files.write_packed(rows.filter("id % 2 = 1"), path, "append")
        return cut(files.read_lines(spark, path, blank=True).select("line"))


@query(
    """select id, folder_id, dataset, task, len(video)::int as images, len(lat_lon)::int as centres, array_to_string(timestamps, ',') as timestamps, conversations[1].value_text as human, conversations[2].value_text as gpt,
  metadata.correct_answer as correct_answer, len(metadata.all_options)::int as options from train_total"""
)
def records_json(spark: SparkSession, folder: str) -> DataFrame:
    """Question-answer records as JSON lines."""
    t = table(spark, folder, "train_total")
    turns = F.transform("conversations", lambda c: F.struct(c["from_role"].alias("from"), c["value_text"].alias("value")))
    shown = F.transform("metadata.all_options", lambda o: F.struct(o["letter"].alias("letter"), o["option_text"].alias("text")))
    data = F.when(F.col("metadata").isNotNull(), F.struct(F.col("metadata.correct_answer").alias("correct_answer"), shown.alias("all_options")))
    with scratch(spark) as path:
        files.write_records(t.withColumnRenamed("timestamps", "timestamp").withColumn("conversations", turns).withColumn("metadata", data), path)
        r = cut(files.read_records(spark, path))
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return r.select(
        "id", "folder_id", "dataset", "task", n("video").alias("images"), n("lat_lon").alias("centres"), F.array_join("timestamp", ",").alias("timestamps"),
        F.col("conversations")[0]["value"].alias("human"), F.col("conversations")[1]["value"].alias("gpt"), "metadata.correct_answer", n("metadata.all_options").alias("options"),
    )


@query("select model_name, qid, predicted, ground_truth, task from (select *, row_number() over (partition by model_name, qid order by ans_id) as rn from answers) where rn = 1")
def predictions_json(spark: SparkSession, folder: str) -> DataFrame:
    """The first prediction of each model for each question, through one set of JSON objects per model; a model whose file is missing is skipped."""
    rows = table(spark, folder, "answers").groupBy("model_name", "qid").agg(F.min_by(F.struct("predicted", "ground_truth", "task"), "ans_id").alias("a")).select("model_name", "qid", "a.*")
    models = [r[0] for r in rows.select("model_name").distinct().orderBy("model_name").toLocalIterator()]  # models are few
    with scratch(spark) as path:
        paths = {m: f"{path}/{k}" for k, m in enumerate(models)}
        for m, p in paths.items():
            files.write_predictions(rows.filter(F.col("model_name") == m), p)
        return cut(files.read_models(spark, paths, lines=True).select("model_name", "qid", "predicted", "ground_truth", "task"))


@query(f"select model_name, answers::bigint as answers, overall_score from ({SQL['judge_averages']})")
def score_table_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A table of scores as CSV."""
    with scratch(spark) as path:
        files.write_scores(judge_averages(spark, folder), path)
        return cut(spark.read.option("header", True).csv(path).select("model_name", F.col("answers").cast("long").alias("answers"), F.col("overall_score").cast("double").alias("overall_score")))


@query(f"select model_name, report from ({SQL['judge_reports']})")
def report_files(spark: SparkSession, folder: str) -> DataFrame:
    """The report of each model written as a text file of its own; models are few."""
    made = cut(scores.reports(judge_averages(spark, folder), "model_name", list(_criteria())))
    found = None
    with scratch(spark) as path:
        for k, (model, text) in enumerate(made.toLocalIterator()):
            files.write_report(text, f"{path}/{k}", spark)
            one = cut(spark.read.text(f"{path}/{k}", wholetext=True).select(F.lit(model).alias("model_name"), F.expr("substr(value, 1, length(value) - 1)").alias("report")))
            found = one if found is None else found.unionByName(one)
    return made if found is None else found


def _criteria():
    from ..functions.fixed import CRITERIA

    return CRITERIA
