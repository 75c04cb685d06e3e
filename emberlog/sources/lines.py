"""Numbered physical lines of files, however the files are split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import prepared

#: Splits, one small row each, up to which their line counts are broadcast.
MOST_SPLITS = 200_000
#: What every parser takes: one row for each physical line, blank ones included.
LINE_COLUMNS = ("session_id", "source_path", "source_name", "record_number", "raw_source")


def source_name(path: Column) -> Column:
    """The file's name of a path as Spark tells it, which is a URI: %20 there is a blank in the name."""
    last = F.substring_index(path, "/", -1)
    return F.when(F.contains(last, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)).otherwise(last)


def read_lines(spark: SparkSession, paths: str | list[str], session_id: str = "default") -> DataFrame:
    """LINE_COLUMNS of text files. Numbers count from 1 and include blank lines; a trailing carriage return goes.

    Lines are counted by split; the sums of the counts before a split are added to the
    place within it. Only the counts are shuffled, not the lines.
    """
    prepared(spark)
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("value"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")
    )
    counts = raw.groupBy("_path", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_path", "_block", (before - F.col("_first") + 1).alias("_shift"))
    if raw.rdd.getNumPartitions() + len(raw.inputFiles()) <= MOST_SPLITS:
        starts = F.broadcast(starts)
    numbered = raw.join(starts, ["_path", "_block"])
    return numbered.select(
        F.lit(session_id).alias("session_id"), F.col("_path").alias("source_path"), source_name(F.col("_path")).alias("source_name"),
        (F.col("_at") + F.col("_shift")).alias("record_number"), F.when(F.contains("value", F.lit("\r")), F.regexp_replace("value", r"\r$", "")).otherwise(F.col("value")).alias("raw_source"),
    )


def read_documents(spark: SparkSession, paths: str | list[str], session_id: str = "default") -> DataFrame:
    """(session_id, source_path, source_name, document): each file whole, in one row."""
    prepared(spark)
    raw = spark.read.text(paths, wholetext=True).select(F.col("value").alias("document"), F.col("_metadata.file_path").alias("source_path"))
    return raw.select(F.lit(session_id).alias("session_id"), "source_path", source_name(F.col("source_path")).alias("source_name"), "document")


def not_blank(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("raw_source").rlike(r"\S"))
