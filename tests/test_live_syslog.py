"""Syslog files that arrive one after the other give the records of one ingest."""

from emberlog.profile import Profile
from emberlog.sources.registry import ingest
from emberlog.streaming.live import follow_lines, follow_records, write_live


def test_live_syslog_equals_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = ["<34>Oct 11 22:14:15 host su[77]: failed\n<165>1 2026-08-08T10:00:00Z host app 99 ID47 [ex@1 a=\"1\"] hello\n", "no syslog\n<13>Jan  1 00:00:00 host cron: x\n\n", "<0>1 - - - - - -\n"]
    profile = Profile(format_id="syslog")
    columns = ["source_name", "event_ts_text", "severity", "subsystem", "message", "raw_source", "attributes"]
    for i, text in enumerate(texts):
        (tmp_path / "in" / f"{i}.log").write_text(text)
        records = follow_records(follow_lines(spark, str(tmp_path / "in")), profile, reference_date="2026-01-05")
        write_live(records, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    tell = lambda df: sorted(str(r.asDict()) for r in df.select(columns).collect())
    got = tell(spark.read.parquet(f"{tmp_path}/out"))
    assert got == tell(ingest(spark, str(tmp_path / "in"), profile, reference_date="2026-01-05").records) and len(got) == 4
