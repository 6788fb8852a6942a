"""Streaming ingestion of events: windows with late data, and first and last sightings folded into an index per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def fresh(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first arrival of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, width: str, *by: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sightings(batch: DataFrame, key: str, time: str) -> DataFrame:
    return batch.groupBy(key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("n"))


def merge_sightings(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """Both folded by key; the union is grouped once."""
    both = new if old is None else old.unionByName(new)
    return both.groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"))


def run_index(stream: DataFrame, folder: str, checkpoint: str, key: str, time: str):
    """A query that writes version v of the index from version v - 1 and batch v: running a batch again gives the same."""

    def merge(batch: DataFrame, v: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{folder}/v={v - 1}") if v > 0 else None
        merge_sightings(old, sightings(batch, key, time), key).write.mode("overwrite").parquet(f"{folder}/v={v}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
