"""Tables that a stream keeps by foreachBatch: every batch writes a folder under its number, so that a batch that is run again changes nothing.

A batch reads what earlier batches wrote, never its own, and overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ingest import chunk_sections


def earlier(spark: SparkSession, folder: str, number: int, schema: str) -> DataFrame:
    """What batches before number wrote to folder; schema names the columns, which the batch is not one of."""
    try:
        found = spark.read.option("basePath", folder).schema(f"{schema}, batch long").parquet(f"{folder}/batch=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], f"{schema}, batch long")
    return found.filter(F.col("batch") < number)


def run(df: DataFrame, folder: str, write: Callable[[DataFrame, int], None]) -> None:
    """Process what there is with write(batch, number); the checkpoint stands beside folder."""
    query = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()


def write_batch(rows: DataFrame, folder: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def upsert_writer(folder: str, schema: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Keeps the last row of each key by order. Keys are in buckets by hash; a batch writes those that it touches anew."""
    names = [c.split()[0] for c in schema.split(", ")]

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(*names).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        before = earlier(batch.sparkSession, folder, number, f"{schema}, bucket int").filter(F.col("bucket").isin(touched))
        both = newest_buckets(before).drop("batch").unionByName(rows)
        best = both.groupBy("bucket", *keys).agg(F.max_by(F.struct(*names), F.struct(*order, *names)).alias("row"))
        write_batch(best.select("row.*", "bucket").repartition("bucket"), folder, number)

    return write


def newest_buckets(rows: DataFrame) -> DataFrame:
    """Of each bucket the rows of its newest batch; buckets are few, so their batches are broadcast."""
    newest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), ["bucket", "batch"], "left_semi")


def upserted(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table that upsert_writer() keeps."""
    return newest_buckets(earlier(spark, folder, 1 << 62, f"{schema}, bucket int")).drop("bucket", "batch")


STORE = "path string, sha256 string, chunk_index int, chunk string"


def inbox_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """Keeps the chunks of files (path, sha256, text) whose bytes no earlier batch has chunked, however long ago; of equal files of a batch the first by path."""

    def write(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("sha256").agg(F.min_by(F.struct("path", "text"), "path").alias("f"))
        known = earlier(batch.sparkSession, folder, number, STORE).select("sha256").distinct()
        fresh = first.join(known, "sha256", "left_anti").select("f.path", "sha256", F.col("f.text").alias("body"))
        write_batch(chunk_sections(fresh).select("path", "sha256", F.col("chunk_index").cast("int"), "chunk"), folder, number)

    return write


def stored_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return earlier(spark, folder, 1 << 62, STORE).drop("batch")


LEDGER = "start timestamp, late boolean, n long, total decimal(38,6), newest timestamp"


def ledger_writer(folder: str, at: str, value: str, length: str, slide: str, delay: str) -> Callable[[DataFrame, int], None]:
    """Keeps, for each batch and window of `at`, the number of rows and the total of `value`.

    A row is late in a window that had ended when the batch began, by the newest time of earlier batches less
    delay; what had been reported of the window is corrected by such rows. Null times are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        mark = earlier(batch.sparkSession, folder, number, LEDGER).agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("mark"))
        rows = batch.filter(F.col(at).isNotNull()).select(F.col(at).alias("at"), F.col(value).cast("decimal(28,6)").alias("v"), F.window(at, length, slide).alias("w"))
        rows = rows.crossJoin(F.broadcast(mark)).withColumn("late", F.coalesce(F.col("w.end") <= F.col("mark"), F.lit(False)))
        summed = rows.groupBy(F.col("w.start").alias("start"), "late").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("at").alias("newest"))
        write_batch(summed, folder, number)

    return write


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(start, n, total, late_n, late_total) of each window: what was counted in time, and what corrects it."""
    rows = earlier(spark, folder, 1 << 62, LEDGER)
    own = lambda late, c: F.coalesce(F.sum(F.when(F.col("late") == late, F.col(c))), F.lit(0))
    return rows.groupBy("start").agg(own(False, "n").alias("n"), own(False, "total").alias("total"), own(True, "n").alias("late_n"), own(True, "total").alias("late_total"))
