"""Analyst state: an append-only log of bookmarks, notes and statuses, and its joins with records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["session_id", "record_id"]
STATUSES = ("Open", "Resolved", "Dismissed")


def current_state(annotations: DataFrame) -> DataFrame:
    """(KEYS, bookmarked, note, status) from annotations(session_id, record_id, field, value, seq).

    For each field the value with the highest seq counts. Blank record ids are ignored;
    a state without bookmark, note and status is none.
    """
    last = lambda f: F.max_by("value", F.when(F.col("field") == f, F.col("seq")))
    own = annotations.where(F.trim("record_id") != "").groupBy(*KEYS).agg(last("bookmarked").alias("b"), last("note").alias("n"), last("status").alias("s"))
    status = F.when(F.col("s").isin(*STATUSES), F.col("s")).otherwise(F.lit("None"))
    state = own.select(*KEYS, (F.coalesce("b", F.lit("false")) == "true").alias("bookmarked"), F.coalesce("n", F.lit("")).alias("note"), status.alias("status"))
    return state.where("bookmarked or note <> '' or status <> 'None'")


def with_state(records: DataFrame, state: DataFrame) -> DataFrame:
    """records with bookmarked, note and status; records without state have the defaults. Spark broadcasts the state only if it is small."""
    joined = records.join(state, KEYS, "left")
    return joined.withColumns({"bookmarked": F.coalesce("bookmarked", F.lit(False)), "note": F.coalesce("note", F.lit("")), "status": F.coalesce("status", F.lit("None"))})


def bookmarked_records(records: DataFrame, state: DataFrame) -> DataFrame:
    return records.join(state.where("bookmarked"), KEYS, "left_semi")


def prune_state(state: DataFrame, records: DataFrame) -> DataFrame:
    """The state of records that are still there, after a source was read again."""
    return state.join(records.select(*KEYS), KEYS, "left_semi")


def findings_review(records: DataFrame, state: DataFrame) -> DataFrame:
    """(session_id, record_id, status, record_number, event_ts_text, text) of classified records, in source order."""
    parts = F.array_compact(F.array(F.lit("(No analyst note)"), F.nullif("event_code", F.lit("")), F.nullif("message", F.lit(""))))
    text = F.when(F.trim("note") != "", F.trim("note")).otherwise(F.array_join(parts, " — "))
    found = records.join(state.where(F.col("status") != "None"), KEYS)
    return found.select("session_id", "record_id", "status", "record_number", F.coalesce("event_ts_text", F.lit("")).alias("event_ts_text"), text.alias("text"), "source_path").orderBy("session_id", "source_path", "record_number").drop("source_path")


def finding_counts(state: DataFrame) -> DataFrame:
    """(session_id, open, resolved, dismissed)."""
    return state.groupBy("session_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
