"""Ingest and timelines of growing logs.

Three ways, by what a file is:

* follow_records: lines that need no others, as a plain stream. Line numbers are not
  known there: a line is named by its file and its text.
* follow_files: files that are complete when they arrive, in any format.
* follow_pieces: files that are pieces of growing sources. Line numbers, the active
  directive and notes on a source go on from piece to piece.

The latter two ingest each micro-batch of files as a batch job, so that a large file is
read by many tasks. A batch writes partitions of its own number; if it is run again after
a failure it replaces them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.normalize import SEVERITIES
from ..plans.ingest import SOURCE, IngestResult
from ..plans.reingest import escaped
from ..profile import Profile
from ..session import prepared, stored
from ..sources.lines import read_lines, source_name
from ..sources.registry import LINE_FORMATS, ingest
from ..sources.w3c import last_directives

LIVE_FORMATS = ("json-lines", "regex-text", "key-value", "syslog")
PIECE_FORMATS = (*LIVE_FORMATS, "iis-w3c")
# Fixed value: the columns of Spark's listing of files.
LISTING = "path string, modificationTime timestamp, length long, content binary"
STATE = "session_id string, source_path string, source_name string, lines long, names array<string>, noted boolean"


def follow_lines(spark: SparkSession, path: str, session_id: str = "live", files_per_trigger: int = 1_000) -> DataFrame:
    """LINE_COLUMNS of new files under a folder, record_number null."""
    prepared(spark)
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select("value", F.col("_metadata.file_path").alias("source_path"))
    return raw.select(F.lit(session_id).alias("session_id"), "source_path", source_name(F.col("source_path")).alias("source_name"), F.lit(None).cast("long").alias("record_number"), F.regexp_replace("value", r"\r$", "").alias("raw_source"))


def follow_records(lines: DataFrame, profile: Profile, **more) -> DataFrame:
    """Records of a stream of lines, in a format that reads each line by itself. more goes to the format's function, such as syslog's reference_date."""
    if profile.format_id not in LIVE_FORMATS:
        raise ValueError(f"{profile.format_id} needs whole sources")
    return LINE_FORMATS[profile.format_id](lines, profile, **more).records


def live_timeline(records: DataFrame, interval: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(session_id, bucket_start, bucket_end, counters) by tumbling windows; records later than late are dropped."""
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]
    grouped = records.withWatermark("event_ts", late).groupBy("session_id", F.window("event_ts", interval)).agg(F.count("*").alias("total"), *counts)
    return grouped.select("session_id", F.col("window.start").alias("bucket_start"), F.col("window.end").alias("bucket_end"), "total", *[s.lower() for s in SEVERITIES])


def write_live(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what there is, then stops; the checkpoint makes the next call go on from there."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _write_batch(result: IngestResult, out: str, batch_id: int) -> None:
    for kind in ("records", "diagnostics", "stats"):
        rows = getattr(result, kind).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "batch").parquet(f"{out}/{kind}")


def _each_batch(spark: SparkSession, path: str, checkpoint: str, files_per_trigger: int, take: Callable[[SparkSession, list[str], int], None]) -> StreamingQuery:
    """Calls take with the files of each micro-batch, at most files_per_trigger names; their contents are not read here."""
    prepared(spark)
    listed = spark.readStream.format("binaryFile").schema(LISTING).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(path).select("path")

    def each(batch: DataFrame, batch_id: int) -> None:
        if names := sorted(r["path"] for r in batch.collect()):
            take(batch.sparkSession, escaped(names), batch_id)

    return listed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_files(spark: SparkSession, path: str, profile: Profile, out: str, checkpoint: str, session_id: str = "live", files_per_trigger: int = 1_000, **more) -> StreamingQuery:
    """Ingests new files under a folder, each a whole source of the profile's format, then stops; the checkpoint makes the next call go on from there.

    Writes records, diagnostics and stats under out, by session and batch. more goes to ingest().
    """
    return _each_batch(spark, path, checkpoint, files_per_trigger, lambda s, names, b: _write_batch(ingest(s, names, profile, session_id, **more), out, b))


def follow_pieces(spark: SparkSession, path: str, profile: Profile, out: str, checkpoint: str, session_id: str = "live", files_per_trigger: int = 1_000, **more) -> StreamingQuery:
    """Like follow_files, but a source is a folder under path and its files are pieces of whole lines, in the order of their names.

    What later pieces need of earlier ones is one row for each source under out/state:
    the lines so far, the fields of the last W3C directive, and whether its note on
    inferred years was made. Each batch writes that table anew under its number.
    """
    if profile.format_id not in PIECE_FORMATS:
        raise ValueError(f"{profile.format_id} needs whole sources")

    def take(s: SparkSession, names: list[str], batch_id: int) -> None:
        old = s.read.schema(STATE).parquet(f"{out}/state/batch={batch_id - 1}") if batch_id else s.createDataFrame([], STATE)
        lines, counts = _continued(read_lines(s, names, session_id), old)
        if profile.format_id == "iis-w3c":
            result = LINE_FORMATS[profile.format_id](lines, profile, before=old.where("names is not null").select(*SOURCE, "names"), **more)
            last = last_directives(lines)
        else:
            result = LINE_FORMATS[profile.format_id](lines, profile, **more)
            last = counts.select(*SOURCE, F.lit(None).cast("array<string>").alias("names"))
        found = stored(result.diagnostics, "live-notes")
        inferred = F.col("code") == "SYSLOG_LEGACY_TIMESTAMP_INFERRED"
        again = old.where("noted").select(*SOURCE, F.lit("SYSLOG_LEGACY_TIMESTAMP_INFERRED").alias("code"))
        _write_batch(IngestResult(result.records, lambda: found.join(again, [*SOURCE, "code"], "left_anti").select(*found.columns), lambda: result.stats), out, batch_id)
        noted = found.where(inferred).select(*SOURCE, F.lit(True).alias("_noted")).distinct()
        new = counts.join(last, list(SOURCE), "left").join(noted, list(SOURCE), "left").select(*SOURCE, F.col("lines").alias("_lines"), F.col("names").alias("_names"), "_noted")
        state = old.join(new, list(SOURCE), "full").select(
            *SOURCE, (F.coalesce("lines", F.lit(0)) + F.coalesce("_lines", F.lit(0))).alias("lines"), F.coalesce("_names", "names").alias("names"), (F.coalesce("noted", F.lit(False)) | F.coalesce("_noted", F.lit(False))).alias("noted")
        )
        state.write.mode("overwrite").parquet(f"{out}/state/batch={batch_id}")

    return _each_batch(spark, path, checkpoint, files_per_trigger, take)


def _continued(lines: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines of pieces as lines of their sources, numbered on from the pieces before; and (SOURCE, lines) counted in these pieces.

    One row for each piece is broadcast, as many as a micro-batch has files.
    """
    parts = F.split("source_path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    pieces = lines.groupBy("session_id", "source_path").agg(F.max("record_number").alias("_n")).select("session_id", F.col("source_path").alias("_piece"), folder.alias("source_path"), source_name(folder).alias("source_name"), "_n")
    pieces = stored(pieces, "live-pieces")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*SOURCE).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = pieces.withColumn("_before", before).join(old.select(*SOURCE, "lines"), list(SOURCE), "left")
    shifts = shifts.select("_piece", F.col("source_path").alias("_path"), F.col("source_name").alias("_name"), (F.col("_before") + F.coalesce("lines", F.lit(0))).alias("_shift"))
    moved = lines.join(F.broadcast(shifts), F.col("source_path") == F.col("_piece"))
    moved = moved.select("session_id", F.col("_path").alias("source_path"), F.col("_name").alias("source_name"), (F.col("record_number") + F.col("_shift")).alias("record_number"), "raw_source")
    return moved, pieces.groupBy(*SOURCE).agg(F.sum("_n").alias("lines"))


def total_stats(stats: DataFrame) -> DataFrame:
    """Stats of batches summed up for each source."""
    return stats.groupBy(*SOURCE).agg(*[F.sum(c).alias(c) for c in ("processed", "imported", "skipped")], *[F.bool_or(c).alias(c) for c in ("has_warnings", "has_errors")])
