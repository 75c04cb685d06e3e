"""Sources that grow piece by piece give what one ingest of the whole gives."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.profile import IIS_W3C, Profile
from emberlog.sources import w3c
from emberlog.sources.lines import read_lines
from emberlog.sources.registry import LINE_FORMATS, ingest
from emberlog.streaming.live import follow_files, follow_pieces, total_stats

RECORD = ["source_name", "record_number", "record_id", "event_ts_text", "severity", "message", "raw_source", "attributes"]
NOTE = ["source_name", "record_number", "code", "severity"]
STATS = ["source_name", "processed", "imported", "skipped", "has_warnings", "has_errors"]


def rows(df, columns):
    return sorted(str(r.asDict()) for r in df.select(columns).collect())


def w3c_text(seed, n):
    r = random.Random(seed)
    kinds = ["#Fields: date time cs-method sc-status", "#Fields: cs-method x", "#Fields:", "#Software: s", "2026-08-08 10:00:00 GET 200", "PUT 5", "", "a b c d e"]
    return [r.choices(kinds, [2, 2, 1, 1, 8, 8, 1, 1])[0] for _ in range(n)]


@pytest.mark.parametrize("profile, more, text", [(IIS_W3C, {}, w3c_text), (Profile(format_id="syslog"), {"reference_date": "2026-01-05"}, lambda seed, n: ["<34>Oct 11 22:14:15 host su[77]: failed", "no", "", "<165>1 2026-08-08T10:00:00Z h a 9 ID - x"] * (n // 4))])
def test_pieces_equal_the_whole(spark, tmp_path, profile, more, text):
    whole = {"one.log": text(1, 60), "two.log": text(2, 24)}
    cuts = {"one.log": [0, 7, 8, 31, 60], "two.log": [0, 0, 11, 11, 24]}
    for n, lines in whole.items():
        (tmp_path / "in" / n).mkdir(parents=True)
        (tmp_path / "whole").mkdir(exist_ok=True)
        (tmp_path / "whole" / n).write_text("".join(x + "\n" for x in lines))
    for batch in ((0, 1), (2,), (3,)):
        for i in batch:
            for n, lines in whole.items():
                if part := lines[cuts[n][i] : cuts[n][i + 1]]:
                    (tmp_path / "in" / n / f"{i:04d}").write_text("".join(x + "\n" for x in part))
        follow_pieces(spark, str(tmp_path / "in"), profile, f"{tmp_path}/out", f"{tmp_path}/checkpoint", **more).awaitTermination()
    # The same sources as one batch, under the names that the pieces' folders have.
    lines = read_lines(spark, str(tmp_path / "whole"), "live").withColumn("source_path", F.replace("source_path", F.lit("/whole/"), F.lit("/in/")))
    want = LINE_FORMATS[profile.format_id](lines, profile, **more)
    assert rows(spark.read.parquet(f"{tmp_path}/out/records"), RECORD) == rows(want.records, RECORD)
    assert rows(spark.read.parquet(f"{tmp_path}/out/diagnostics"), NOTE) == rows(want.diagnostics, NOTE)
    assert rows(total_stats(spark.read.parquet(f"{tmp_path}/out/stats")), STATS) == rows(want.stats, STATS)


def test_files_of_any_format_that_arrive_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    profile = Profile(format_id="csv")
    for i, text in enumerate(["message,level\na,INFO\n\"b\nc,WARN\n", "level,message\nERROR,x\nshort\n"]):
        (tmp_path / "in" / f"{i}.csv").write_text(text)
        follow_files(spark, str(tmp_path / "in"), profile, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    want = ingest(spark, str(tmp_path / "in"), profile, "live")
    for kind, columns in (("records", RECORD), ("diagnostics", NOTE), ("stats", STATS)):
        assert rows(spark.read.parquet(f"{tmp_path}/out/{kind}"), columns) == rows(getattr(want, kind), columns)
    with pytest.raises(ValueError):
        follow_pieces(spark, str(tmp_path / "in"), profile, f"{tmp_path}/out", f"{tmp_path}/c")


def test_directives_are_carried_through_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(w3c, "BLOCK", 4)
    for i in range(3):
        (tmp_path / f"{i}.log").write_text("\n".join(w3c_text(10 + i, 120)))
    lines = read_lines(spark, str(tmp_path))
    few, many = (w3c.ingest_w3c(lines, IIS_W3C, x) for x in (True, False))
    assert rows(few.records, RECORD) == rows(many.records, RECORD) and rows(few.diagnostics, NOTE) == rows(many.diagnostics, NOTE)
    # Against a plain pass over the lines.
    want = []
    for i in range(3):
        names = None
        for n, line in enumerate(w3c_text(10 + i, 120), 1):
            if line.startswith("#Fields:"):
                names = line[8:].split()
            elif line and not line.startswith("#") and names and len(line.split()) == len(names):
                want.append((f"{i}.log", n))
    assert sorted(tuple(r) for r in many.records.select("source_name", "record_number").collect()) == sorted(want)
