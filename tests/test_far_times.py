"""A wrong time makes a long timeline; it must neither end the application nor fill one task."""

import pytest
from pyspark.sql import functions as F

from emberlog.operators import analysis


def records(spark):
    rows = [("s", "1970-01-01 00:00:00", "INFO")] + [("s", f"2024-01-30 10:{m:02d}:00", "ERROR") for m in range(60)] + [("t", "2024-01-30 10:00:00", "WARN"), ("u", None, "WARN")]
    return spark.createDataFrame(rows, "session_id string, at string, severity string").withColumn("event_ts", F.to_timestamp("at"))


def test_one_stamp_of_1970_is_a_spread_job(spark):
    out = analysis.timeline_by_minutes(records(spark), 10)
    assert {r["session_id"]: r["buckets"] for r in analysis.bucket_count(records(spark), 600_000).collect()} == {"s": 2_844_354, "t": 1, "u": 0}
    got = out.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("total").alias("total"), F.countDistinct("bucket").alias("d"), F.max("bucket").alias("z")).collect()
    assert {r["session_id"]: (r["n"], r["total"], r["d"]) for r in got} == {"s": (2_844_354, 61, 2_844_354), "t": (1, 1, 1)}
    tasks = analysis._spine(records(spark).where("session_id = 's'").groupBy("session_id").agg(F.lit(True).alias("_dates"), F.lit(0).cast("long").alias("_from"), F.lit(2_844_353 * 600_000).cast("long").alias("_to")), 600_000)
    assert tasks.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_too_many_buckets_fail_with_their_number(spark):
    with pytest.raises(Exception, match="a timeline of 1706612340001 buckets is more than"):
        analysis.timeline(records(spark), 1).count()
    assert analysis.timeline(records(spark), 1, count=20).where("session_id = 's'").count() == 20


def test_counts_roll_up(spark):
    df = records(spark).where("at > '2000' or at is null")
    for step in (analysis.HOUR, 2 * analysis.MINUTE):
        want = sorted(analysis.timeline(df, step).collect())
        assert sorted(analysis.timeline_of_counts(analysis.occupied(df, analysis.MINUTE), step).collect()) == want and want
