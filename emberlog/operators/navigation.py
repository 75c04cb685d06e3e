"""Neighbours, next issues and positions in a sorted session.

A session may hold most of the records, so it is not one window. Records are range
partitioned by session and sort keys; windows run inside a partition of a session, and
one row for each such piece carries what lies before and behind it. The bounds of ranges
come from a random sample, so the pieces are checkpointed before they are read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import ISSUES
from ..session import settled

SOURCE_ORDER = ("source_path", "record_number", "record_id")


def sort_keys(column: str | None = None, attribute: str | None = None) -> list[Column]:
    """Typed sort keys: time as time, severity by rank, texts in any case, attributes as numbers and then texts; ties in source order."""
    own: list[Column] = []
    if attribute is not None:
        text = F.try_element_at("attributes", F.lit(attribute))
        own = [text.try_cast("double"), F.lower(text)]
    elif column in ("event_ts", "record_number"):
        own = [F.col(column)]
    elif column == "severity":
        own = [F.col("severity_rank")]
    elif column is not None:
        own = [F.lower(column)]
    return own + [F.col(c) for c in SOURCE_ORDER]


def sort_records(records: DataFrame, column: str | None = None, attribute: str | None = None, descending: bool = False) -> DataFrame:
    """Records by session and sort_keys(); only the chosen key is turned around by descending."""
    keys = sort_keys(column, attribute)
    own = keys[: len(keys) - len(SOURCE_ORDER)]
    return records.orderBy("session_id", *[k.desc() if descending else k.asc() for k in own], *SOURCE_ORDER)


def places(sorted_records: DataFrame) -> DataFrame:
    """sorted_records with place, from 1 in each session, in the order that they are in: that of sort_records()."""
    rows = settled(sorted_records.withColumn("_at", F.monotonically_increasing_id()).withColumn("_piece", F.spark_partition_id()))
    counts = rows.groupBy("session_id", "_piece").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("session_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = counts.select(F.col("session_id").alias("_s"), F.col("_piece").alias("_p"), before.alias("_before"))
    inside = Window.partitionBy("session_id", "_piece").orderBy("_at")
    joined = rows.withColumn("_in", F.row_number().over(inside)).join(carried, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p")))
    return joined.withColumn("place", F.col("_before") + F.col("_in")).drop("_at", "_piece", "_in", "_s", "_p", "_before")


def pieces_of(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with _piece, the number of their range of keys, in ascending order of these; checkpointed."""
    return settled(rows.repartitionByRange(*keys).withColumn("_piece", F.spark_partition_id()))


def navigate(records: DataFrame, column: str | None = None, attribute: str | None = None) -> DataFrame:
    """(session_id, record_id, position, of, previous_id, next_id, previous_issue, next_issue) in sort order.

    Neighbours do not wrap around; issues (warnings and worse) do, and a session's only
    issue is its own next one. Null where there is none.
    """
    keys = sort_keys(column, attribute)
    named = records.select("session_id", "record_id", F.col("severity").isin(list(ISSUES)).alias("_issue"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    order = [f"_k{i}" for i in range(len(keys))]
    spread = pieces_of(named, "session_id", *order)
    issue = F.when(F.coalesce("_issue", F.lit(False)), F.col("record_id"))
    key = F.struct(*order)
    pieces = spread.groupBy("session_id", "_piece").agg(
        F.count("*").alias("_n"), F.min_by("record_id", key).alias("_first"), F.max_by("record_id", key).alias("_last"),
        F.min_by(issue, F.when(issue.isNotNull(), key)).alias("_first_issue"), F.max_by(issue, F.when(issue.isNotNull(), key)).alias("_last_issue"),
    )
    by = Window.partitionBy("session_id").orderBy("_piece")
    before, behind, whole = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing), Window.partitionBy("session_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = pieces.select(
        F.col("session_id").alias("_s"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_of"),
        F.lag("_last").over(by).alias("_c_prev"), F.lead("_first").over(by).alias("_c_next"),
        F.coalesce(F.last("_last_issue", True).over(before), F.last("_last_issue", True).over(whole)).alias("_c_prev_issue"),
        F.coalesce(F.first("_first_issue", True).over(behind), F.first("_first_issue", True).over(whole)).alias("_c_next_issue"),
    )
    inside = Window.partitionBy("session_id", "_piece").orderBy(*order)
    # Frames that grow with the row; one that shrinks would be computed anew for each row.
    up = inside.rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("session_id", "_piece").orderBy(*[F.col(k).desc() for k in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.select(
        "session_id", "_piece", "record_id", F.row_number().over(inside).alias("_at"), F.lag("record_id").over(inside).alias("_prev"), F.lead("record_id").over(inside).alias("_next"),
        F.last(issue, True).over(up).alias("_prev_issue"), F.last(issue, True).over(down).alias("_next_issue"),
    )
    joined = local.join(carried, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p")))
    return joined.select(
        "session_id", "record_id", (F.col("_before") + F.col("_at")).alias("position"), F.col("_of").alias("of"), F.coalesce("_prev", "_c_prev").alias("previous_id"), F.coalesce("_next", "_c_next").alias("next_id"),
        F.coalesce("_prev_issue", "_c_prev_issue").alias("previous_issue"), F.coalesce("_next_issue", "_c_next_issue").alias("next_issue"),
    )
