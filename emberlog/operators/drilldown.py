"""From cells of summaries back to records, and criteria widened to show hidden records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import ISSUES, epoch_ms, floor_ms
from .filters import FLAGS, Criteria, match_flags


def issue_cells(records: DataFrame, active: tuple[str, ...] = ()) -> DataFrame:
    """Records behind every cell of the issue summary, with its column as cell: warnings, errors or total.

    Active severities narrow a cell; nothing is behind records without a subsystem.
    """
    wanted = [s for s in ISSUES if not active or s in active]
    issues = records.where(F.col("severity").isin(wanted) & (F.coalesce("subsystem", F.lit("")) != "")) if wanted else records.where(F.lit(False))
    cells = F.array(F.lit("total"), F.when(F.col("severity") == "WARN", F.lit("warnings")).otherwise(F.lit("errors")))
    return issues.withColumn("cell", F.explode(cells))


def bucket_records(records: DataFrame, interval_ms: int, start_ms: int | None = None, end_ms: int | None = None, severities: tuple[str, ...] = ()) -> DataFrame:
    """Records behind every timeline bucket, with from_ms and to_ms of the bucket, clamped to the effective range."""
    ms = epoch_ms(F.col("event_ts"))
    out = records.where("event_ts is not null").withColumn("bucket", floor_ms(ms, interval_ms))
    a, z = F.col("bucket"), F.col("bucket") + (interval_ms - 1)
    if start_ms is not None:
        out, a = out.where(ms >= start_ms), F.greatest(a, F.lit(start_ms).cast("long"))
    if end_ms is not None:
        out, z = out.where(ms <= end_ms), F.least(z, F.lit(end_ms).cast("long"))
    if severities:
        out = out.where(F.col("severity").isin(list(severities)))
    return out.withColumns({"from_ms": a, "to_ms": z})


def relax_for(records: DataFrame, criteria: Criteria) -> DataFrame:
    """One row for each of the given records that criteria hide, with only what hides it widened.

    Columns: session_id, record_id, the FLAGS, and the criteria as they must be: sets get
    the record's value, or are dropped where it has none; the search is cleared; the
    bound that is violated moves; a field gets the attribute's value or is dropped;
    bookmarked_only is switched off.
    """
    c = criteria.clean()
    hidden = match_flags(records, c).where("not all_match")

    def widened(values: tuple[str, ...], column: str, flag: str):
        own = F.array(*map(F.lit, values)).cast("array<string>")
        more = F.when(F.trim(column) != "", F.array_union(own, F.array(column))).otherwise(F.array().cast("array<string>"))
        return F.when(F.col(flag), own).otherwise(more)

    start, end = (F.to_timestamp(F.lit(t)) if t else F.lit(None).cast("timestamp") for t in (c.start, c.end))
    out_of_time, no_time = ~F.col("time_match"), F.col("event_ts").isNull()
    fields = {}
    for k, values in c.fields.items():
        own = F.array(*map(F.lit, values))
        text = F.try_element_at("attributes", F.lit(k))
        fields[k] = F.when(text.isNull(), F.lit(None)).when(text.isin(list(values)), own).otherwise(F.array_union(own, F.array(text)))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()]) if fields else F.array().cast("array<struct<key:string,value:array<string>>>")
    status = widened(c.statuses, "status", "status_match") if c.statuses else F.array().cast("array<string>")
    return hidden.select(
        "session_id", "record_id", *FLAGS,
        widened(c.severities, "severity", "severity_match").alias("severities"),
        widened(c.subsystems, "subsystem", "subsystem_match").alias("subsystems"),
        widened(c.event_codes, "event_code", "event_code_match").alias("event_codes"),
        widened(c.entity_ids, "entity_id", "entity_match").alias("entity_ids"),
        F.when(out_of_time & no_time, F.lit(None)).otherwise(F.when(start.isNotNull(), F.least(start, F.col("event_ts")))).alias("start"),
        F.when(out_of_time & no_time, F.lit(None)).otherwise(F.when(end.isNotNull(), F.greatest(end, F.col("event_ts")))).alias("end"),
        F.when(F.col("search_match"), F.lit(c.search)).otherwise(F.lit("")).alias("search"),
        F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("fields"),
        status.alias("statuses"),
        (F.lit(c.bookmarked_only) & F.col("bookmark_match")).alias("bookmarked_only"),
    )
