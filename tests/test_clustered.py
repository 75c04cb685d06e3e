"""Records written by time: a filter on time reads a part of the row groups and gives what the full scan gives."""

from pyspark.sql import functions as F

from emberlog.operators.filters import Criteria, filter_records
from emberlog.plans.ingest import write_result
from emberlog.profile import Profile
from emberlog.session import prepared
from emberlog.sources.json_sources import ingest_json_lines


def rows_scanned(df):
    """Rows that the scan below df gave, after row groups were skipped."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_filter_on_time_skips_row_groups(spark, tmp_path):
    n = 8_000
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("id") * 7_919, F.lit(n)))
    raw = F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("message")))
    lines = prepared(spark).range(n).select(F.lit("s").alias("session_id"), F.lit("/a.log").alias("source_path"), F.lit("a.log").alias("source_name"), (F.col("id") + 1).alias("record_number"), raw.alias("raw_source"))
    result = ingest_json_lines(lines, Profile())
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "65536")
    try:
        for by_time in (False, True):
            write_result(result, f"file://{tmp_path}/{by_time}", by_time=by_time)
    finally:
        hadoop.unset("parquet.block.size")
    hour = Criteria(start="2023-11-14T22:20:00Z", end="2023-11-14T22:25:00Z")
    found = {b: filter_records(spark.read.parquet(f"file://{tmp_path}/{b}/records"), hour) for b in (False, True)}
    ids = {b: sorted(r[0] for r in df.select("record_id").collect()) for b, df in found.items()}
    assert len(ids[True]) == 301 and ids[True] == ids[False]
    assert rows_scanned(found[False]) == n and rows_scanned(found[True]) < n / 4
