"""Where streams keep their files, and rows of a table told in several batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; a local session that names none takes a temporary one, else that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def in_batches(rows: DataFrame, number: str, count: int, folder: str, start: Callable[[DataFrame], None]) -> None:
    """Land the rows by number (0 to count - 1), and let start(stream) process what has landed after each; its checkpoint carries on."""
    landed = f"{folder}/landed"
    schema = rows.drop(number).schema
    for n in range(count):
        rows.filter(F.col(number) == n).drop(number).write.mode("append").parquet(landed)
        start(rows.sparkSession.readStream.schema(schema).parquet(landed))
