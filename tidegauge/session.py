"""Session helpers: builder, lineage cuts in the shared folder, numeric limits of broadcasts."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast by hand only if it was counted and has at most this many rows.
BROADCAST_ROWS = 200_000


def build(app: str = "tidegauge", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the plans assume: UTC, adaptive execution, skew joins, Arrow."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.executorEnv.PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir; checkpoints stand below it.

    Only a session on one machine, as in tests, may lack the setting and gets a folder of its own; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="tidegauge-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with checkpoint() in the shared folder, so that what was cut survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A path in the shared folder that is removed at the end; what was read from it must have been cut by then."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slots(spark: SparkSession) -> int:
    """The number of partitions that a shuffle made by hand gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
