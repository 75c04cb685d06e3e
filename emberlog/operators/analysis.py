"""Summaries and timelines; every one is grouped by session, so many sessions are one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import ISSUES, SEVERITIES, epoch_ms, floor_ms

NO_SUBSYSTEM = "(No subsystem)"
SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000
# Steps of automatic intervals in milliseconds, and the buckets that they aim at.
STEPS = (1, 10, 100, 500, SECOND, 5 * SECOND, 15 * SECOND, 30 * SECOND, MINUTE, 5 * MINUTE, 15 * MINUTE, 30 * MINUTE, HOUR, 3 * HOUR, 6 * HOUR, 12 * HOUR, DAY, 3 * DAY, 7 * DAY)
TARGET_BUCKETS = 20
#: Buckets of a session up to which a timeline is made, and how many of them a task makes from one row.
MOST_BUCKETS, BLOCK_BUCKETS = 10_000_000_000, 65_536
COUNTERS = ("total", *[s.lower() for s in SEVERITIES])


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES]


def severity_summary(records: DataFrame, visible: Column | None = None) -> DataFrame:
    """(session_id, visible, total, one count for each severity of the visible records)."""
    seen = F.lit(True) if visible is None else visible
    counts = [F.count_if(seen & (F.col("severity") == s)).alias(s.lower()) for s in SEVERITIES]
    return records.groupBy("session_id").agg(F.count_if(seen).alias("visible"), F.count("*").alias("total"), *counts)


def issue_summary(records: DataFrame) -> DataFrame:
    """(session_id, subsystem, warnings, errors, total) of warnings and worse; CRITICAL counts as error.

    In order of session, total (largest first) and subsystem.
    """
    name = F.coalesce(F.nullif(F.col("subsystem"), F.lit("")), F.lit(NO_SUBSYSTEM)).alias("subsystem")
    issues = records.where(F.col("severity").isin(list(ISSUES)))
    counts = issues.groupBy("session_id", name).agg(F.count_if(F.col("severity") == "WARN").alias("warnings"), F.count_if(F.col("severity") != "WARN").alias("errors"), F.count("*").alias("total"))
    return counts.orderBy("session_id", F.desc("total"), "subsystem")


def bucket_label(start: Column, interval: Column, several_dates: Column) -> Column:
    """The text of a bucket: as short as its interval and the range of dates allow."""
    at = F.timestamp_millis(start)
    short = lambda a, b: F.when(several_dates, F.date_format(at, a)).otherwise(F.date_format(at, b))
    return (
        F.when(interval < SECOND, short("MM-dd HH:mm:ss.SSS", "HH:mm:ss.SSS"))
        .when(interval < MINUTE, short("MM-dd HH:mm:ss", "HH:mm:ss"))
        .when(interval < DAY, short("yyyy-MM-dd HH:mm", "HH:mm"))
        .otherwise(F.date_format(at, "yyyy-MM-dd"))
    )


def occupied(records: DataFrame, interval_ms: int) -> DataFrame:
    """(session_id, bucket, counters) of buckets that have records."""
    bucket = floor_ms(epoch_ms(F.col("event_ts")), interval_ms).alias("bucket")
    return records.where("event_ts is not null").groupBy("session_id", bucket).agg(F.count("*").alias("total"), *_severity_counts())


def _spine(bounds: DataFrame, interval_ms: int) -> DataFrame:
    """(session_id, _dates, bucket) of every bucket between _from and _to; blocks of buckets are dealt out before the buckets are made.

    A session of more than MOST_BUCKETS fails with their number before any is made.
    """
    n = F.floor((F.col("_to") - F.col("_from")) / interval_ms) + 1
    told = F.concat(F.lit("a timeline of "), n.cast("string"), F.lit(f" buckets is more than {MOST_BUCKETS}: take a longer interval, a narrower range or a window of buckets"))
    n = F.when(n > MOST_BUCKETS, F.raise_error(told).cast("long")).otherwise(n)
    sized = bounds.where("_from <= _to").select("session_id", "_dates", "_from", n.alias("_n"))
    # A number is given, since adaptive execution would bring the few small rows into one partition.
    tasks = int(bounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK_BUCKETS))).alias("_block")).repartition(tasks, "session_id", "_block")
    place = F.col("_block") * BLOCK_BUCKETS
    first = F.col("_from") + place * interval_ms
    last = F.col("_from") + (F.least(place + BLOCK_BUCKETS, F.col("_n")) - 1) * interval_ms
    return blocks.select("session_id", "_dates", F.explode(F.sequence(first, last, F.lit(interval_ms).cast("long"))).alias("bucket"))


def _filled(bounds: DataFrame, counts: DataFrame, interval_ms: int) -> DataFrame:
    filled = _spine(bounds, interval_ms).join(counts, ["session_id", "bucket"], "left").fillna(0, list(COUNTERS))
    return filled.select("session_id", "bucket", bucket_label(F.col("bucket"), F.lit(interval_ms), F.col("_dates")).alias("label"), *COUNTERS)


def _several_dates() -> Column:
    return F.timestamp_millis("_first").cast("date") != F.timestamp_millis("_last").cast("date")


def timeline(records: DataFrame, interval_ms: int, start_ms: int | None = None, end_ms: int | None = None, start_index: int = 0, count: int | None = None) -> DataFrame:
    """(session_id, bucket, label, counters): every bucket from a session's first to its last, empty ones too.

    start_ms and end_ms narrow the range, which is otherwise that of the data.
    start_index and count choose a window of buckets; records outside of it are left out
    before they are grouped. An interval that is not positive gives no rows. One wrong
    time may make a range of decades: its buckets are made by many tasks, and beyond
    MOST_BUCKETS the query fails with their number; bucket_count() tells it before.
    """
    none = records.sparkSession.createDataFrame([], "session_id string, bucket long, label string, " + ", ".join(f"{c} long" for c in COUNTERS))
    if interval_ms <= 0 or start_index < 0 or (count is not None and count <= 0):
        return none
    ms = epoch_ms(F.col("event_ts"))
    inside = records.where("event_ts is not null")
    if start_ms is not None:
        inside = inside.where(ms >= start_ms)
    if end_ms is not None:
        inside = inside.where(ms <= end_ms)
    first = F.lit(start_ms) if start_ms is not None else F.min(ms)
    last = F.lit(end_ms) if end_ms is not None else F.max(ms)
    bounds = inside.groupBy("session_id").agg(first.cast("long").alias("_a"), last.cast("long").alias("_z"))
    bounds = bounds.withColumns({"_first": floor_ms(F.col("_a"), interval_ms), "_last": floor_ms(F.col("_z"), interval_ms)})
    bounds = bounds.withColumn("_dates", _several_dates())
    bounds = bounds.withColumns({"_from": F.col("_first") + start_index * interval_ms, "_to": F.least(F.col("_last"), F.col("_first") + (start_index + count - 1) * interval_ms) if count is not None else F.col("_last")})
    if start_index or count is not None:
        limits = bounds.select(F.col("session_id").alias("_s"), "_from", F.col("_to").alias("_until"))
        inside = inside.join(limits, F.col("session_id").eqNullSafe(F.col("_s"))).where((ms >= F.col("_from")) & (ms < F.col("_until") + interval_ms)).drop("_s", "_from", "_until")
    return _filled(bounds, occupied(inside, interval_ms), interval_ms)


def rolled_up(counts: DataFrame, interval_ms: int) -> DataFrame:
    """occupied() of a coarser interval from stored counts of a finer one that divides it; records are not read again."""
    bucket = floor_ms(F.col("bucket"), interval_ms).alias("bucket")
    return counts.groupBy("session_id", bucket).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def timeline_of_counts(counts: DataFrame, interval_ms: int) -> DataFrame:
    """As timeline() over all records, from stored occupied() counts of an interval that divides this one."""
    coarse = rolled_up(counts, interval_ms)
    bounds = coarse.groupBy("session_id").agg(F.min("bucket").alias("_first"), F.max("bucket").alias("_last"))
    return _filled(bounds.select("*", _several_dates().alias("_dates"), F.col("_first").alias("_from"), F.col("_last").alias("_to")), coarse, interval_ms)


def timeline_by_minutes(records: DataFrame, minutes: int = 1, **more) -> DataFrame:
    return timeline(records, minutes * MINUTE, **more)


def bucket_count(records: DataFrame, interval_ms: int) -> DataFrame:
    """(session_id, buckets) without making them; 0 for sessions without times and for bad intervals."""
    ms = epoch_ms(F.col("event_ts"))
    if interval_ms <= 0:
        return records.select("session_id").distinct().withColumn("buckets", F.lit(0).cast("long"))
    n = (floor_ms(F.max(ms), interval_ms) - floor_ms(F.min(ms), interval_ms)) / interval_ms + 1
    return records.groupBy("session_id").agg(F.coalesce(n.cast("long"), F.lit(0).cast("long")).alias("buckets"))


def timeline_scale(records: DataFrame, interval_ms: int) -> DataFrame:
    """(session_id, max_total, max_series): the largest total and the largest single series of any bucket."""
    return occupied(records, interval_ms).groupBy("session_id").agg(F.max("total").alias("max_total"), F.max(F.greatest(*[F.col(s.lower()) for s in SEVERITIES])).alias("max_series"))


def capabilities(records: DataFrame) -> DataFrame:
    """(session_id, has_severity, ...): which columns have any value, in one pass."""
    some = lambda c: F.bool_or(F.col(c).isNotNull())
    return records.groupBy("session_id").agg(
        some("severity").alias("has_severity"), some("subsystem").alias("has_subsystem"), some("event_code").alias("has_event_code"),
        some("entity_id").alias("has_entity"), F.bool_or(F.size("attributes") > 0).alias("has_attributes"), some("event_ts").alias("has_timestamp"), some("message").alias("has_message"),
    )


def distinct_values(records: DataFrame) -> DataFrame:
    """(session_id, kind, value) for filters, kinds subsystem, event_code, entity_id and attribute, in case-insensitive order."""
    named = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("subsystem", "event_code", "entity_id")]
    keys = F.transform(F.map_keys("attributes"), lambda k: F.struct(F.lit("attribute").alias("kind"), k.alias("value")))
    pairs = records.select("session_id", F.explode(F.concat(F.array(*named), keys)).alias("x")).select("session_id", "x.kind", "x.value")
    return pairs.where("value is not null").distinct().orderBy("session_id", "kind", F.lower("value"), "value")


def attribute_names(records: DataFrame) -> DataFrame:
    """(attribute): names over all sessions, in case-insensitive order."""
    names = records.select(F.explode(F.map_keys("attributes")).alias("attribute")).distinct()
    return names.orderBy(F.lower("attribute"), "attribute")


def time_range(records: DataFrame) -> DataFrame:
    """(session_id, first_ms, last_ms) over records that have a time."""
    ms = epoch_ms(F.col("event_ts"))
    return records.groupBy("session_id").agg(F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


def effective_range(records: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """time_range() narrowed by a filter's bounds."""
    a = F.greatest("first_ms", F.lit(start_ms).cast("long")) if start_ms is not None else F.col("first_ms")
    z = F.least("last_ms", F.lit(end_ms).cast("long")) if end_ms is not None else F.col("last_ms")
    return time_range(records).select("session_id", a.alias("first_ms"), z.alias("last_ms"))


def automatic_interval(first_ms: Column, last_ms: Column) -> Column:
    """The smallest of STEPS that gives at most TARGET_BUCKETS, else whole days; a minute if the range is not valid."""
    span = F.greatest(F.lit(1).cast("long"), last_ms - first_ms + 1)
    steps = F.array(*[F.lit(s).cast("long") for s in STEPS])
    fit = F.try_element_at(F.filter(steps, lambda s: F.ceil(span / s) <= TARGET_BUCKETS), F.lit(1))
    days = F.greatest(F.lit(1), F.ceil(F.ceil(span / TARGET_BUCKETS) / DAY)).cast("long") * DAY
    return F.when(first_ms.isNull() | last_ms.isNull() | (first_ms > last_ms), F.lit(MINUTE).cast("long")).otherwise(F.coalesce(fit, days))


def session_intervals(records: DataFrame) -> DataFrame:
    """(session_id, interval_ms): the automatic interval of each session."""
    return time_range(records).select("session_id", automatic_interval(F.col("first_ms"), F.col("last_ms")).alias("interval_ms"))


def frequencies(records: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, records) of a canonical column, most frequent first."""
    out = records.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("records")).orderBy(F.desc("records"), "value")
    return out if top is None else out.limit(top)


def trends(records: DataFrame, column: str, interval_ms: int) -> DataFrame:
    """(session_id, value, bucket, records): a column's values over time."""
    bucket = floor_ms(epoch_ms(F.col("event_ts")), interval_ms).alias("bucket")
    return records.where(F.col("event_ts").isNotNull() & F.col(column).isNotNull()).groupBy("session_id", F.col(column).alias("value"), bucket).agg(F.count("*").alias("records"))


def compare_sessions(records: DataFrame, a: str, b: str, column: str) -> DataFrame:
    """(value, records_a, records_b, only_in) of a column in two sessions."""
    counts = records.where(F.col("session_id").isin(a, b) & F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count_if(F.col("session_id") == a).alias("records_a"), F.count_if(F.col("session_id") == b).alias("records_b"))
    return counts.withColumn("only_in", F.when(F.col("records_b") == 0, F.lit(a)).when(F.col("records_a") == 0, F.lit(b)))


def session_rates(records: DataFrame) -> DataFrame:
    """(session_id, records, issues, duration_ms, per_minute): per_minute is null where all times are equal."""
    ms = epoch_ms(F.col("event_ts"))
    issues = F.count_if(F.col("severity").isin(list(ISSUES)))
    sums = records.groupBy("session_id").agg(F.count("*").alias("records"), issues.alias("issues"), (F.max(ms) - F.min(ms)).alias("duration_ms"))
    return sums.withColumn("per_minute", F.col("records") * F.lit(60_000.0) / F.nullif("duration_ms", F.lit(0).cast("long")))
