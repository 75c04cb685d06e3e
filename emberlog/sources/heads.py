"""The first lines or records of files, without reading more than their heads.

Lines come from a limit on each listed file, which ends its scan. Of documents each file is one partition, and its
task stops when it has enough; what is read ahead then is what the sockets to Python hold, some megabytes. Neither
grows with the files. Meant for the files that a user looks at: each is a branch of the plan.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ingest import SOURCE, finish, no_notes
from ..profile import Profile, problems
from ..session import importable, prepared
from . import json_structure, xml_source
from .json_sources import as_object, with_fields
from .lines import source_name
from .splits import read_pieces

#: No file is as large, so none is split.
NO_SPLIT = 1 << 50
#: Rows that a task asks for at once, and lines of directives that a head may have besides.
BATCH, HEADER_LINES = 64, 32


def listing(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_path, source_name, bytes) of files that are not empty; nothing is read."""
    path = F.col("path")
    return spark.read.format("binaryFile").load(paths).select(path.alias("source_path"), source_name(path).alias("source_name"), F.col("length").alias("bytes"))


def whole_files(spark: SparkSession, paths: str | list[str]) -> SparkSession:
    """A session of its own in which each of these files is one partition."""
    own = prepared(spark.newSession())
    own.conf.set("spark.sql.files.maxPartitionBytes", str(NO_SPLIT))
    own.conf.set("spark.sql.files.openCostInBytes", str(NO_SPLIT))
    # As many partitions are wanted as there are files; Spark packs files together else.
    own.conf.set("spark.sql.files.minPartitionNum", str(max(1, listing(spark, paths).count())))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    importable(own)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return own


def read_heads(spark: SparkSession, paths: str | list[str], n: int, session_id: str = "default", uncounted: str = "") -> DataFrame:
    """LINE_COLUMNS of the first n lines of each file that are not blank; lines that begin with uncounted are not counted but kept, if they are among the first HEADER_LINES or counted ones."""
    own = whole_files(spark, paths)
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    path = F.col("_metadata.file_path")
    out = None
    for (file,) in listing(spark, paths).select("source_path").orderBy("source_path").collect():
        lines = own.read.option("lineSep", "\n").text(file).select(F.lit(session_id).alias("session_id"), path.alias("source_path"), source_name(path).alias("source_name"), (F.monotonically_increasing_id() + 1).alias("record_number"), F.regexp_replace("value", r"\r$", "").alias("raw_source"))
        some = lines.where(F.col("raw_source").rlike(r"\S"))
        head = some.limit(n + HEADER_LINES) if uncounted else some.limit(n)
        if uncounted:
            first = F.row_number().over(Window.partitionBy(F.col("raw_source").startswith(uncounted)).orderBy("record_number"))
            head = head.withColumn("_n", first).where(F.col("raw_source").startswith(uncounted) | (F.col("_n") <= n)).drop("_n")
        out = head if out is None else out.union(head)
    return own.createDataFrame([], "session_id string, source_path string, source_name string, record_number long, raw_source string") if out is None else out


def preview_files(spark: SparkSession, paths: str | list[str], profile: Profile, n: int = 50, session_id: str = "default", **more) -> tuple[DataFrame, DataFrame]:
    """The records among the first n source records of each file, and whether it has more: (SOURCE, truncated).

    Read are the heads of files only. A document is looked at up to its record n + 1, so what is wrong behind that
    is not seen. more goes to the format's function. ValueError for a profile that cannot be used or an n below 1.
    """
    from .registry import LINE_FORMATS

    if n <= 0:
        raise ValueError("n must be positive")
    if found := problems(profile):
        raise ValueError("; ".join(found))
    if profile.format_id in LINE_FORMATS:
        # One line more than is asked for tells whether there are more; a header or directives come on top.
        extra = profile.format_id in ("csv", "tsv")
        lines = read_heads(spark, paths, n + 1 + extra, session_id, uncounted="#" if profile.format_id == "iis-w3c" else "")
        result = LINE_FORMATS[profile.format_id](lines, profile, **more)
        place = lines.where(F.col("raw_source").rlike(r"\S") & (~F.col("raw_source").startswith("#") if profile.format_id == "iis-w3c" else F.lit(True)))
        # The place of each counted line among those of its file.
        ends = place.groupBy(*SOURCE).agg(F.sort_array(F.collect_list("record_number")).alias("_at"))
        limits = ends.select(F.col("source_path").alias("_path"), F.try_element_at("_at", F.lit(n + extra)).alias("_last"))
        records = result.records.join(limits, F.col("source_path") == F.col("_path")).where(F.col("_last").isNull() | (F.col("record_number") <= F.col("_last"))).select(result.records.columns)
        return records, ends.select(*SOURCE, (F.size("_at") > n + extra).alias("truncated"))
    own = whole_files(spark, paths)
    path = [p for p in profile.record_path.strip().split(".") if p]
    if profile.format_id == "xml":
        cuts = xml_source.cut(read_pieces(own, paths, ">", session_id), path, limit=n)
        rows = cuts.where("k > 0").withColumn("record_number", F.col("k")).withColumns({"others": F.col("lists"), "notes": no_notes()})
        result = finish(rows, replace(profile), None)
    else:
        cuts = json_structure.cut(read_pieces(own, paths, "{", session_id), path, limit=n)
        elements = cuts.where("k > 0 and whole").withColumn("_v", F.try_parse_json("raw_source")).where("_v is not null")
        error = F.when(as_object(F.col("_v")).isNull(), F.struct(F.lit("STRUCTURED_JSON_RECORD_NOT_OBJECT").alias("code"), F.lit("the element is not an object").alias("message")))
        rows = elements.select(*SOURCE, F.col("k").alias("record_number"), F.col("_v").cast("string").alias("raw_source"), "_v", error.alias("error"), no_notes().alias("notes"))
        result = finish(with_fields(rows, "_v", profile), profile, None)
    more_there = cuts.where("k < 0").select(*SOURCE, (-1 - F.col("k") > n).alias("truncated"))
    return result.records.where(F.col("record_number") <= n), more_there


def suggest_file_formats(spark: SparkSession, paths: str | list[str], session_id: str = "default") -> DataFrame:
    """suggest_formats() of files by their first lines only; a file without any line is suggested by its extension."""
    from .registry import suggest_formats

    lines = read_heads(spark, paths, HEADER_LINES, session_id)
    filled = {r["source_path"].partition(":")[2].lstrip("/") for r in listing(spark, paths).collect()}
    empty = [p for p in spark.read.text(paths).inputFiles() if p.partition(":")[2].lstrip("/") not in filled]
    if not empty:
        return suggest_formats(lines)
    none = lines.sparkSession.createDataFrame([(session_id, p, p.rpartition("/")[2], 1, "") for p in empty], lines.schema)
    return suggest_formats(none.union(lines))
