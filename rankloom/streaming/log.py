"""The judgement log as a stream: lines are appended as JSON, the latest of each key is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.judgements import latest

SCHEMA = "key long, record_id long, query_id string, phase string, valid boolean, recorded_at timestamp"


def read_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Lines as they are appended; a torn last line has no key and is left out."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder).filter("key IS NOT NULL")


def keep_latest(stream: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch into the table at ``state``, one generation of files a batch.

    A generation is written whole before the next reads it, so that a batch run again gives the same files.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        rows = latest(batch, ["key"], ["record_id"])
        if number:
            old = spark.read.parquet(f"{state}/generation={number - 1}")
            rows = latest(old.unionByName(rows), ["key"], ["record_id"])
        rows.write.mode("overwrite").parquet(f"{state}/generation={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_coverage(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, phase, windows, invalid): counts by time of recording; lines later than the watermark are dropped."""
    w = stream.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", width), "phase")
    return w.agg(F.count("*").alias("windows"), F.count_if(~F.col("valid")).alias("invalid")).select(F.col("window.start").alias("start"), "phase", "windows", "invalid")
