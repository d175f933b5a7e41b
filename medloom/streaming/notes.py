"""Reports as a stream: the same row-wise operators on files as they come in, and windowed counts.

Every clinical operator works on one row, so it runs on a stream as it is. Counts over event time
take a watermark, which bounds the state that is kept for late reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from medloom.operators import entities as E

SCHEMA = "report_id string, text string, ts timestamp"


def read_stream(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """JSON reports that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", most_files).json(path)


def entity_stream(reports: DataFrame) -> DataFrame:
    """A row for each entity of each report that comes in."""
    return reports.select("report_id", "ts", F.explode(E.entities(F.col("text"))).alias("e")).select("report_id", "ts", "e.*")


def entity_counts(reports: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Entities by label and window of event time; reports later than `late` are left out."""
    rows = entity_stream(reports).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window).alias("window"), "label").agg(F.count("*").alias("n"))
