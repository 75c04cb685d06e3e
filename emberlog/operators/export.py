"""Wide tables and CSV files of records, and the text of one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analysis import attribute_names

HEADERS = {"event_ts_text": "Timestamp", "severity": "Severity", "subsystem": "Subsystem", "event_code": "Event Code", "entity_id": "Entity ID", "message": "Message"}
#: Attribute columns of one wide table; more need the long form.
MOST_COLUMNS = 2_000
#: A field is quoted only if it has a comma, a quote or a line break, and blanks stay blank.
CSV_OPTIONS = {"header": "true", "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def wide(records: DataFrame, names: list[str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, the six headers, and a column for each attribute name, in case-insensitive order; blank where absent.

    names are found if they are not given; more than MOST_COLUMNS raise ValueError.
    """
    if names is None:
        names = [r[0] for r in attribute_names(records).limit(MOST_COLUMNS + 1).collect()]
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} attributes; use long_form()")
    text = lambda c: F.coalesce(c, F.lit(""))
    return records.select(*keys, *[text(F.col(c)).alias(h) for c, h in HEADERS.items()], *[text(F.try_element_at("attributes", F.lit(n))).alias(n) for n in names])


def long_form(records: DataFrame) -> DataFrame:
    """(session_id, record_id, attribute, value): a row for each attribute."""
    return records.select("session_id", "record_id", F.explode_outer("attributes").alias("attribute", "value"))


def visible_columns(records: DataFrame) -> DataFrame:
    """(column): canonical columns that have any value, then attributes."""
    seen = records.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in HEADERS])
    pairs = F.array_compact(F.array(*[F.when(F.col(c), F.struct(F.lit(i).alias("at"), F.lit(h).alias("column"))) for i, (c, h) in enumerate(HEADERS.items())]))
    fixed = seen.select(F.explode(pairs).alias("x")).select("x.at", "x.column")
    return fixed.union(attribute_names(records).select(F.lit(len(HEADERS)), "attribute")).orderBy("at", F.lower("column"), "column").select("column")


def write_csv(records: DataFrame, path: str, names: list[str] | None = None) -> None:
    """The wide table as CSV files, rows in the order of records."""
    wide(records, names).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def detail_text() -> Column:
    """A record as labelled lines, attributes in case-insensitive order of their names."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")))
    by_name = lambda a, b: F.when(F.lower(a["key"]) < F.lower(b["key"]), -1).when(F.lower(a["key"]) > F.lower(b["key"]), 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    own = F.transform(F.array_sort(F.map_entries("attributes"), by_name), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.concat(F.array(*[line(h, F.col(c)) for c, h in HEADERS.items()], line("Source", F.col("source_name")), line("Record", F.col("record_number").cast("string"))), own), "\n")


def write_findings(findings: DataFrame, path: str) -> None:
    """Reviewed findings (see state.findings_review) as CSV files."""
    names = {"session_id": "Session", "record_number": "Record", "event_ts_text": "Timestamp", "status": "Status", "text": "Finding"}
    findings.select(*[F.col(c).alias(n) for c, n in names.items()]).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
