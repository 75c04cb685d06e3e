"""From parsed source fields to records, diagnostics and counts.

A parser gives one row for each processed source record:

    session_id, source_path, source_name, record_number, raw_source,
    error    struct<code, message>, null for a record
    notes    array<struct<code, message, severity>>, kept with the record
    fields   map<string, string>: flat dot path -> text; lists and objects as compact JSON
    lists    array<string>: paths whose value is a list or an object
    others   array<string>: paths whose value is not a string, so no canonical text
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import blank_to_null, display_timestamp, parse_severity, parse_timestamp, record_id, severity_rank
from ..profile import Profile
from ..session import stored

SOURCE = ("session_id", "source_path", "source_name")
NOTE = "struct<code:string,message:string,severity:string>"
RECORD_COLUMNS = ("session_id", "record_id", "event_ts", "event_ts_text", "severity", "severity_rank", "subsystem", "event_code", "entity_id", "message", "attributes", "structured", "raw_source", "source_path", "source_name", "record_number")


class IngestResult:
    """records, diagnostics (code, message, severity and source), and one row of stats for each source.

    The latter two are planned when they are first asked for.
    """

    def __init__(self, records: DataFrame, diagnostics: Callable[[], DataFrame], stats: Callable[[], DataFrame], once: Callable[[], IngestResult] | None = None):
        self.records = records
        self._diagnostics, self._stats, self._once = diagnostics, stats, once

    def once(self) -> IngestResult:
        """The same from a table in the shared folder: what asks for more than one of the three parses once."""
        return self._once() if self._once else self

    @cached_property
    def diagnostics(self) -> DataFrame:
        return self._diagnostics()

    @cached_property
    def stats(self) -> DataFrame:
        return self._stats()


def note(code: str, message: Column | str, severity: str = "Warning") -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), text.alias("message"), F.lit(severity).alias("severity"))


def no_notes() -> Column:
    return F.array().cast(f"array<{NOTE}>")


def error_when(*cases: tuple[Column, str, Column | str]) -> Column:
    """The first case that holds as struct<code, message>, else null."""
    out = None
    for holds, code, message in cases:
        made = F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))
        out = F.when(holds, made) if out is None else out.when(holds, made)
    return out if out is not None else F.lit(None).cast("struct<code:string,message:string>")


def canonical_text(path: str) -> Column:
    """Trimmed text at a path, of the element's own text if it has attributes; null if blank or not a string."""
    if not path:
        return F.lit(None).cast("string")
    own = F.when(~F.array_contains(F.coalesce("others", F.array().cast("array<string>")), path), F.try_element_at("fields", F.lit(path)))
    return blank_to_null(F.coalesce(own, F.try_element_at("fields", F.lit(path + ".#text"))))


def map_records(parsed: DataFrame, profile: Profile) -> DataFrame:
    """parsed with the record columns and all notes added; rows with an error keep it and have no record."""
    texts = {k: canonical_text(profile.path(k)) for k in ("timestamp", "severity", "subsystem", "event_code", "entity_id", "message")}
    made = parsed.withColumns({f"_{k}": c for k, c in texts.items()})
    ts = parse_timestamp(F.col("_timestamp"), profile.timestamp_rules)
    severity = parse_severity(F.col("_severity"), profile.severity_aliases)
    mapped = profile.mapped()

    def free(k: Column) -> Column:
        # Few names have a dot; the others cannot lie below a mapped path.
        below = F.lit(False)
        for p in mapped:
            below = below | k.startswith(p + ".")
        return ~k.isin(list(mapped)) & ~(F.contains(k, F.lit(".")) & below) if mapped else F.lit(True)

    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter("fields", lambda k, _: free(k)) if profile.preserve_unmapped else none
    names = F.coalesce("lists", F.array().cast("array<string>"))
    if profile.custom:
        pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.coalesce(F.try_element_at("fields", F.lit(p.strip())), F.try_element_at("fields", F.lit(p.strip() + ".#text")) if profile.format_id == "xml" else F.lit(None).cast("string")).alias("v")) for n, p in profile.custom.items()])
        own = F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))
        # Custom names win over source names.
        kept = F.map_concat(F.map_filter(kept, lambda k, _: ~k.isin(list(profile.custom))), own)
        lists = F.array(*[F.when(F.array_contains(names, p.strip()), F.lit(n)) for n, p in profile.custom.items()])
        names = F.concat(names, F.array_compact(lists))
    made = made.withColumns({"event_ts": ts, "severity": severity, "attributes": F.coalesce(kept, none), "_names": names})
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_timestamp").isNotNull() & F.col("event_ts").isNull(), note("INVALID_TIMESTAMP", F.concat(F.lit("not a timestamp by the profile's rules: "), "_timestamp"))),
            F.when(F.col("_severity").isNotNull() & F.col("severity").isNull(), note("UNMAPPED_SEVERITY", F.concat(F.lit("not a severity: "), "_severity"))),
        )
    )
    return made.withColumns(
        {
            "notes": F.concat(F.coalesce("notes", no_notes()), F.when(F.col("error").isNull(), warnings).otherwise(no_notes())),
            "structured": F.filter("_names", lambda k: F.map_contains_key(F.col("attributes"), k)),
            "record_id": record_id(F.col("source_path"), F.col("source_name"), F.col("record_number"), F.col("raw_source")),
            "event_ts_text": display_timestamp(F.col("event_ts")),
            "severity_rank": severity_rank(F.col("severity")),
            "subsystem": F.col("_subsystem"),
            "event_code": F.col("_event_code"),
            "entity_id": F.col("_entity_id"),
            "message": F.col("_message"),
        }
    )


def parsed_once(parsed: DataFrame) -> DataFrame:
    """The columns of a parser's rows, made by a generator.

    Without it a filter on a record's columns would move below the parser's expressions,
    each use with a copy of them.
    """
    made = F.struct(*[F.col(c) for c in ("error", "notes", "fields", "lists", "others")])
    return parsed.select(*SOURCE, "record_number", "raw_source", F.inline(F.array(made)))


def finish(parsed: DataFrame, profile: Profile, sources: DataFrame | None = None) -> IngestResult:
    """Splits parsed rows, which are parsed once whatever is asked of them. sources(session_id, source_path, source_name, code, message, severity) are notes on whole sources; those of level Error reject the source's rows before they get here."""
    return _result(map_records(parsed_once(parsed), profile), sources)


def _result(made: DataFrame, sources: DataFrame | None) -> IngestResult:
    records = made.where("error is null").select(*RECORD_COLUMNS)

    def diagnostics() -> DataFrame:
        place = [*SOURCE, "record_number"]
        found = made.select(*place, F.explode(F.concat(F.array_compact(F.array(F.when(F.col("error").isNotNull(), F.struct(F.col("error.code"), F.col("error.message"), F.lit("Error").alias("severity"))))), "notes")).alias("d")).select(*place, "d.*")
        if sources is not None:
            found = found.unionByName(sources.select(*SOURCE, F.lit(None).cast("long").alias("record_number"), "code", "message", "severity"))
        return found

    def stats() -> DataFrame:
        counted = made.groupBy(*SOURCE).agg(
            F.count("*").alias("processed"),
            F.count_if(F.col("error").isNull()).alias("imported"),
            F.bool_or((F.size("notes") > 0) & F.exists("notes", lambda n: n["severity"] == "Warning")).alias("_warn"),
            F.bool_or(F.col("error").isNotNull()).alias("_bad"),
        )
        if sources is not None:
            levels = sources.groupBy(*SOURCE).agg(F.bool_or(F.col("severity") == "Warning").alias("_sw"), F.bool_or(F.col("severity") == "Error").alias("_se"))
            counted = counted.join(levels, list(SOURCE), "full")
        else:
            counted = counted.withColumns({"_sw": F.lit(False), "_se": F.lit(False)})
        no = lambda c: F.coalesce(F.col(c), F.lit(False))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        return counted.select(
            *SOURCE,
            zero("processed").alias("processed"),
            zero("imported").alias("imported"),
            F.greatest(F.lit(0).cast("long"), zero("processed") - zero("imported")).alias("skipped"),
            (no("_warn") | no("_sw")).alias("has_warnings"),
            (no("_bad") | no("_se")).alias("has_errors"),
        )

    return IngestResult(records, diagnostics, stats, lambda: _result(stored(made.select(*RECORD_COLUMNS, "error", "notes"), "mapped"), sources))


def clustered(records: DataFrame) -> DataFrame:
    """records in ranges of session and time, each in order: a written row group spans little time, so filters on time skip most of them.

    Ranges are cut from a sample of the rows, so a large session is spread over many tasks.
    """
    order = ["session_id", "event_ts", "record_number"]
    return records.repartitionByRange(*order).sortWithinPartitions(*order)


def write_result(result: IngestResult, path: str, mode: str = "overwrite", by_time: bool = False) -> None:
    """records and diagnostics by session, and stats, as Parquet; overwriting replaces only the sessions that are there. by_time: see clustered."""
    options = {"partitionOverwriteMode": "dynamic"}
    records = clustered(result.records) if by_time else result.records
    records.write.mode(mode).options(**options).partitionBy("session_id").parquet(f"{path}/records")
    result.diagnostics.write.mode(mode).options(**options).partitionBy("session_id").parquet(f"{path}/diagnostics")
    result.stats.write.mode(mode).options(**options).partitionBy("session_id").parquet(f"{path}/stats")
