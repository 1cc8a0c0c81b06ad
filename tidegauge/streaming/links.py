"""The gathering of links as a stream: files of declarations come in, link lines are appended, what was done is remembered.

The checkpoint takes the place of flushed files and of the list of what to skip; foreachBatch writes each batch once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

PARTS = ("declaration_title", "incident_type", "designated_area", "state", "incident_begin_date")


def search_queries(declarations: DataFrame) -> DataFrame:
    """event_id and search text of each declaration, batch or stream."""
    return declarations.select(F.col("idx").alias("event_id"), F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in PARTS)).alias("query"))


#: Parts of the sink by event; a batch reads only those that its events fall into.
SINK_PARTS = 64


def gather_links(spark: SparkSession, source: str, schema, find: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream: new Parquet files below ``source`` become queries, ``find`` gives event_id and url of each, new links go to ``sink``.

    Links that the sink already holds are not written again, so a batch that is repeated after a failure adds nothing. The sink is partitioned by
    event, and only the parts of the batch's events are read; that a sink can't be read is an error, only a sink that isn't there yet is none.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        part = F.pmod(F.hash("event_id"), F.lit(SINK_PARTS))
        links = find(batch).select("event_id", "url").dropna().distinct().withColumn("part", part).persist()
        try:
            place = session._jvm.org.apache.hadoop.fs.Path(sink)
            if place.getFileSystem(session._jsc.hadoopConfiguration()).exists(place):
                parts = [r[0] for r in links.select("part").distinct().collect()]  # at most SINK_PARTS
                held = session.read.parquet(sink).filter(F.col("part").isin(parts)).select("event_id", "url")
                links.join(held, ["event_id", "url"], "left_anti").withColumn("batch", F.lit(epoch)).write.mode("append").partitionBy("part").parquet(sink)
            else:
                links.withColumn("batch", F.lit(epoch)).write.partitionBy("part").parquet(sink)
        finally:
            links.unpersist()

    stream = search_queries(spark.readStream.schema(schema).parquet(source))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, time: str, key: str, lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events per window and key, with a watermark for those that come late; batch or stream."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select("window.start", "window.end", key, "n")
