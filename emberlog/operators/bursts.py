"""Bursts of warnings and errors.

A subsystem may have most of the issues, so it is not one window: issues are in pieces by
time, as in navigation, and one row for each piece carries the last time and the number of
bursts before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import ISSUES, epoch_ms
from .navigation import pieces_of


def issue_bursts(records: DataFrame, gap_ms: int = 60_000, least: int = 3) -> DataFrame:
    """(session_id, subsystem, burst, from_ms, to_ms, issues): runs of issues of a subsystem with gaps of at most gap_ms, of at least so many.

    Issues without a subsystem, or without a session, are a group of their own. burst counts from 1 in each group.
    """
    group = ["session_id", "subsystem"]
    issues = records.where(F.col("severity").isin(list(ISSUES)) & F.col("event_ts").isNotNull()).select(*group, "record_id", epoch_ms(F.col("event_ts")).alias("ms"))
    spread = pieces_of(issues, *group, "ms", "record_id")
    inside, over = Window.partitionBy(*group, "_piece").orderBy("ms", "record_id"), Window.partitionBy(*group).orderBy("_piece")
    so_far = over.rowsBetween(Window.unboundedPreceding, -1)
    new = lambda now, last: F.when(last.isNull() | (now - last > gap_ms), 1).otherwise(0)
    marked = spread.withColumn("_new", new(F.col("ms"), F.lag("ms").over(inside)))
    # The first of a piece may go on with the run before it.
    sums = marked.groupBy(*group, "_piece").agg(F.sum("_new").alias("_n"), F.min("ms").alias("_lo"), F.max("ms").alias("_hi"))
    sums = sums.withColumn("_joined", 1 - new(F.col("_lo"), F.lag("_hi").over(over)))
    before = F.coalesce(F.sum(F.col("_n") - F.col("_joined")).over(so_far), F.lit(0)) - F.col("_joined")
    carried = sums.select(*[F.col(c).alias(f"_c_{c}") for c in (*group, "_piece")], before.alias("_before"))
    on = [marked[c].eqNullSafe(carried[f"_c_{c}"]) for c in (*group, "_piece")]
    runs = marked.join(carried, on).withColumn("_run", F.col("_before") + F.sum("_new").over(inside))
    found = runs.groupBy(*group, "_run").agg(F.min("ms").alias("from_ms"), F.max("ms").alias("to_ms"), F.count("*").alias("issues")).where(F.col("issues") >= least)
    return found.withColumn("burst", F.row_number().over(Window.partitionBy(*group).orderBy("from_ms")).cast("long")).drop("_run")
