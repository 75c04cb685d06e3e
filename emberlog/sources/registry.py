"""Formats by id, bounded previews, format suggestions and attribute discovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ingest import SOURCE, IngestResult
from ..profile import COMBINED_LINE, COMMON_LINE, Profile, line_pattern, problems
from .json_sources import as_object, ingest_json_lines
from .json_structure import ingest_json_files
from .lines import read_lines
from .syslog import MODERN, header_words, ingest_syslog, legacy_header, priority
from .text_sources import KEY_VALUE_LINE, PAIR, ingest_delimited, ingest_key_value, ingest_regex
from .w3c import ingest_w3c
from .xml_source import ingest_xml_files

LINE_FORMATS: dict[str, Callable[..., IngestResult]] = {"json-lines": ingest_json_lines, "regex-text": ingest_regex, "key-value": ingest_key_value, "syslog": ingest_syslog, "iis-w3c": ingest_w3c, "csv": ingest_delimited, "tsv": ingest_delimited}
FILE_FORMATS: dict[str, Callable[..., IngestResult]] = {"structured-json": ingest_json_files, "xml": ingest_xml_files}


def ingest(spark: SparkSession, paths: str | list[str], profile: Profile, session_id: str = "default", **more) -> IngestResult:
    """Reads files by the profile's format. more goes to the format's function; ValueError for a profile that cannot be used."""
    if found := problems(profile):
        raise ValueError("; ".join(found))
    if profile.format_id in FILE_FORMATS:
        return FILE_FORMATS[profile.format_id](spark, paths, profile, session_id, **more)
    return LINE_FORMATS[profile.format_id](read_lines(spark, paths, session_id), profile, **more)


def preview(result: IngestResult, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The first n records of each source, and for each source whether there are more: (SOURCE, truncated).

    The lowest n are found by a window that keeps n rows a source before the shuffle.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    order = Window.partitionBy(*SOURCE).orderBy("record_number")
    first = result.records.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
    return first, result.stats.select(*SOURCE, (F.col("processed") > n).alias("truncated"))


# The namespace of Windows events, and which extensions tell a format.
EVENT_NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"
EXTENSIONS = {"jsonl": "json-lines", "ndjson": "json-lines", "json": "structured-json", "xml": "xml", "csv": "csv", "tsv": "tsv", "syslog": "syslog"}
HEADER_LINES, SAMPLE_LINES = 32, 5


def looks_like(line: Column) -> dict[str, Column]:
    """Whether a trimmed line has the look of each format."""
    timed = lambda p: line.rlike(f"^{p}$") & F.try_to_timestamp(F.regexp_extract(line, p, 4), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).isNotNull()
    return {
        "json-lines": as_object(F.try_parse_json(line)).isNotNull(),
        "syslog": priority(line).isNotNull() & (line.rlike(MODERN) | legacy_header(header_words(line)).isNotNull()),
        "web-combined": timed(line_pattern(COMBINED_LINE, named=False)),
        "apache-common": timed(line_pattern(COMMON_LINE, named=False)),
        "key-value": line.rlike(KEY_VALUE_LINE) & (F.size(F.regexp_extract_all(line, F.lit(PAIR), F.lit(0))) >= 2),
    }


def is_w3c_header(line: Column) -> Column:
    names = F.split(F.lower(F.trim(F.substr(line, F.lit(9)))), r"\s+")
    has = lambda *n: F.arrays_overlap(names, F.array(*map(F.lit, n)))
    return F.lower(line).startswith("#fields:") & has("date") & has("time") & has("cs-method", "cs-uri-stem") & has("sc-status", "time-taken")


def suggest_formats(lines: DataFrame) -> DataFrame:
    """(SOURCE, format_id, preset_id) of each source: by extension, by a W3C header, else by what its first lines all look like; null for none.

    Only the first HEADER_LINES lines of a source that are not blank are kept before anything is looked at.
    """
    some = lines.where(F.col("raw_source").rlike(r"\S")).withColumn("_line", F.trim("raw_source"))
    first = some.withColumn("_n", F.row_number().over(Window.partitionBy(*SOURCE).orderBy("record_number"))).where(F.col("_n") <= HEADER_LINES)
    data_before = F.max(~F.col("_line").startswith("#")).over(Window.partitionBy(*SOURCE).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("_open", ~F.coalesce(data_before, F.lit(False)))
    looks = looks_like(F.col("_line"))
    sampled = F.col("_n") <= SAMPLE_LINES
    xml = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]))
    found = first.groupBy(*SOURCE).agg(F.bool_or(F.col("_open") & is_w3c_header(F.col("_line"))).alias("_w3c"), *[F.bool_and(F.when(sampled, c)).alias(f"_{k}") for k, c in looks.items()], xml.alias("_head"))
    every = lines.groupBy(*SOURCE).agg(F.count("*").alias("_all")).join(found, list(SOURCE), "left")
    suffix = F.lower(F.regexp_extract("source_name", r"\.([^.]+)$", 1))
    by_suffix = F.coalesce(*[F.when(suffix == k, F.lit(v)) for k, v in EXTENSIONS.items()])
    looked = F.coalesce(F.when(F.col("_w3c"), F.lit("iis-w3c")), *[F.when(F.col(f"_{k}"), F.lit(k)) for k in looks])
    root = F.regexp_extract("_head", r"(?s)^(?:<\?.*?\?>|<!--.*?-->|\s)*<([^\s/>!?]+)", 1)
    event = F.contains("_head", F.lit(EVENT_NAMESPACE))
    windows = F.when((by_suffix == "xml") & event & (root == "Event"), F.lit("windows-event-xml")).when((by_suffix == "xml") & event & (root == "Events"), F.lit("windows-event-xml-collection"))
    web = F.when(by_suffix.isNull() & looked.isin("web-combined", "apache-common", "iis-w3c"), looked)
    return every.select(*SOURCE, F.coalesce(by_suffix, F.when(looked.isin("web-combined", "apache-common"), F.lit("regex-text")).otherwise(looked)).alias("format_id"), F.coalesce(windows, web).alias("preset_id"))


def discover_attributes(records: DataFrame, profile: Profile) -> DataFrame:
    """(name): attribute names of the records that the profile does not map, in case-insensitive order."""
    names = records.select(F.explode(F.map_keys("attributes")).alias("name")).distinct()
    taken = {*profile.custom, *profile.mapped()}
    return names.where(~F.col("name").isin(list(taken)) if taken else F.lit(True)).orderBy(F.lower("name"), "name")
