"""Filters, summaries, timelines, navigation, drill-down, state and export on small hand-made records."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberlog.functions.normalize import clean_path, display_timestamp, parse_severity, parse_timestamp, qt_pattern, severity_rank
from emberlog.operators import analysis, bursts, drilldown, export, filters, navigation, state
from emberlog.session import prepared
from emberlog.streaming import live
from emberlog.profile import Profile

UTC = dt.timezone.utc
SCHEMA = "session_id string, record_id string, event_ts timestamp, severity string, subsystem string, event_code string, entity_id string, message string, attributes map<string,string>, structured array<string>, raw_source string, source_path string, source_name string, record_number long"


def at(h, m=0, s=0, us=0, day=8):
    return dt.datetime(2026, 8, day, h, m, s, us, tzinfo=UTC)


def frame(spark, rows):
    prepared(spark)
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"event_ts_text": display_timestamp(F.col("event_ts")), "severity_rank": severity_rank(F.col("severity"))})


def rec(i, ts, severity, subsystem="S", code="C", entity="E", message="m", session="s", structured=(), **attributes):
    return (session, str(i), ts, severity, subsystem, code, entity, message, attributes, list(structured), f"raw {i}", "/a", "a", i)


@pytest.fixture(scope="module")
def records(spark):
    return frame(
        spark,
        [
            rec(1, at(10), "INFO", "Startup", "SESSION_START", "SYS-001", "begin", host="server-01", list="[1]", structured=["list"]),
            rec(2, at(10, 2), "WARN", "Tracking", "TRACK_LOST", "TRK-402", "Lost it", host="server-02"),
            rec(3, at(10, 1), "ERROR", "Comms", "PACKET_DROP", "LINK-A", "dropped", region="west"),
            rec(4, None, None, None, None, None, None),
            rec(5, at(23, 59, 59, 999000), "CRITICAL", "", "X", "LINK-A", "night", n="10"),
        ],
    ).cache()


def ids(df):
    return sorted(int(r["record_id"]) for r in df.collect())


@pytest.mark.parametrize(
    "criteria,want",
    [
        ({}, [1, 2, 3, 4, 5]), ({"severities": (" warn ", "error", "")}, [2, 3]), ({"subsystems": ("Comms", "comms")}, [3]), ({"event_codes": ("TRACK_LOST",)}, [2]), ({"entity_ids": ("LINK-A",)}, [3, 5]),
        ({"start": "2026-08-08T10:01:00Z", "end": "2026-08-08T10:02:00Z"}, [2, 3]), ({"start": "2026-08-08T10:02:00Z"}, [2, 5]), ({"end": "2026-08-08T10:00:00Z"}, [1]),
        ({"fields": {"host": ("server-01", "server-02")}}, [1, 2]), ({"fields": {"host": ("server-01",), "region": ("west",)}}, []), ({"fields": {"list": ("[1]",)}}, []), ({"fields": {"host": ()}}, [1, 2, 3, 4, 5]), ({"fields": {"n": ("10",)}}, [5]),
        ({"search": " LOST "}, [2]), ({"search": "server-0"}, [1, 2]), ({"search": "[1]"}, []), ({"search": "RAW 4"}, [4]), ({"search": "10:02:00"}, [2]), ({"search": "critical"}, [5]), ({"severities": ("ERROR",), "search": "lost"}, []),
    ],
)
def test_filters(records, criteria, want):
    assert ids(filters.filter_records(records, filters.Criteria(**criteria))) == want


def test_flags_presets_and_legacy(records):
    got = {r["record_id"]: r for r in filters.match_flags(records, filters.Criteria(severities=("WARN",), search="lost")).collect()}
    assert got["2"]["all_match"] and not got["3"]["severity_match"] and not got["3"]["search_match"] and got["3"]["time_match"] and got["4"]["bookmark_match"]
    only_state = filters.Criteria(bookmarked_only=True)
    assert filters.analysis_input(records, only_state).count() == 5
    assert ids(filters.analysis_input(records, filters.Criteria(severities=("WARN",)))) == [2]
    caps = analysis.capabilities(records).first()
    assert caps["has_attributes"] and caps["has_timestamp"]
    kept = filters.apply_preset(filters.Criteria(severities=("WARN",), fields={"host": ("a",), "gone": ("b",)}), caps.asDict() | {"has_severity": False}, ["host"])
    assert kept.severities == () and kept.fields == {"host": ("a",)}
    counts = {r["preset"]: (r["visible"], r["total"]) for r in filters.preset_counts(records, {"w": filters.Criteria(severities=("WARN",)), "all": filters.Criteria()}).collect()}
    assert counts == {"w": (1, 5), "all": (5, 5)}
    with pytest.raises(ValueError):
        filters.preset_counts(records, {str(i): filters.Criteria() for i in range(501)})
    old = filters.legacy_events(records)
    assert old.where("record_number = 4").first()["level"] == ""
    assert filters.legacy_filter(old, "ERROR", "Comms", "LINK-a").count() == 1 and filters.legacy_filter(old, "error").count() == 0


def test_issue_and_severity_summaries(records):
    assert [tuple(r)[1:] for r in analysis.issue_summary(records).collect()] == [("(No subsystem)", 0, 1, 1), ("Comms", 0, 1, 1), ("Tracking", 1, 0, 1)]
    r = analysis.severity_summary(records, filters.predicate(filters.Criteria(entity_ids=("LINK-A",)))).first()
    assert (r["visible"], r["total"], r["error"], r["critical"], r["warn"]) == (2, 5, 1, 1, 0)


def test_timelines(spark, records):
    rows = analysis.timeline_by_minutes(records.where("record_id <> 5"), 1).orderBy("bucket").collect()
    assert [(r["label"], r["total"], r["warn"]) for r in rows] == [("10:00", 1, 0), ("10:01", 1, 0), ("10:02", 1, 1)]
    five = analysis.timeline_by_minutes(records, 5).orderBy("bucket").collect()
    assert len(five) == 168 and five[0]["total"] == 3 and five[-1]["critical"] == 1 and sum(r["total"] for r in five) == 4
    window = analysis.timeline(records, 60_000, start_index=1, count=1).collect()
    assert [(r["label"], r["total"], r["error"]) for r in window] == [("10:01", 1, 1)]
    assert analysis.timeline(records, 60_000, start_index=839, count=20).count() == 1 and analysis.timeline(records, 60_000, start_index=840, count=20).count() == 0
    assert analysis.timeline(records, 0).count() == 0 and analysis.bucket_count(records, 0).first()["buckets"] == 0 and analysis.bucket_count(records, 60_000).first()["buckets"] == 840
    midnight = frame(spark, [rec(1, at(23, 59), "INFO"), rec(2, at(0, 1, day=9), "INFO"), rec(3, dt.datetime(1969, 12, 31, 23, 59, 59, 950000, tzinfo=UTC), "WARN", session="old"), rec(4, dt.datetime(1970, 1, 1, 0, 0, 0, 20000, tzinfo=UTC), "WARN", session="old")])
    got = analysis.timeline(midnight.where("session_id = 's'"), 60_000).orderBy("bucket").collect()
    assert [r["label"] for r in got] == ["2026-08-08 23:59", "2026-08-09 00:00", "2026-08-09 00:01"] and [r["total"] for r in got] == [1, 0, 1]
    old = analysis.timeline(midnight.where("session_id = 'old'"), 100).orderBy("bucket").collect()
    assert [(r["bucket"], r["label"]) for r in old] == [(-100, "12-31 23:59:59.900"), (0, "01-01 00:00:00.000")]
    assert analysis.timeline_scale(records, 3_600_000).first()[1:] == (3, 1)
    ranged = analysis.timeline(records, 60_000, start_ms=int(at(10).timestamp() * 1000), end_ms=int(at(10, 3).timestamp() * 1000)).orderBy("bucket").collect()
    assert [r["total"] for r in ranged] == [1, 1, 1, 0]


@pytest.mark.parametrize("span,want", [(0, 1), (19, 1), (20, 10), (20_000, 5_000), (20 * 60_000 - 1, 60_000), (20 * 60_000, 300_000), (140 * 86_400_000 - 1, 7 * 86_400_000), (141 * 86_400_000, 8 * 86_400_000)])
def test_automatic_interval(spark, span, want):
    got = spark.range(1).select(analysis.automatic_interval(F.lit(5).cast("long"), F.lit(5 + span).cast("long"))).first()[0]
    assert got == want


def test_ranges_and_values(spark, records):
    r = analysis.effective_range(records, int(at(10, 1).timestamp() * 1000)).first()
    assert r["first_ms"] == int(at(10, 1).timestamp() * 1000) and r["last_ms"] == int(at(23, 59, 59).timestamp() * 1000) + 999
    values = [(x["kind"], x["value"]) for x in analysis.distinct_values(records).collect()]
    assert ("attribute", "host") in values and values == sorted(values, key=lambda v: (v[0], v[1].lower(), v[1]))
    assert spark.range(1).select(analysis.automatic_interval(F.lit(None).cast("long"), F.lit(1).cast("long"))).first()[0] == 60_000


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_navigation(spark, partitions):
    issues = [None, "WARN", None, None, "ERROR", "INFO", "CRITICAL", None]
    rows = [rec(i, at(1, i), s) for i, s in enumerate(issues)] + [rec(100, at(2), "WARN", session="one"), rec(101, at(3), "INFO", session="one"), rec(200, at(2), None, session="none")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["record_id"]: r for r in navigation.navigate(frame(spark, rows), "event_ts").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i in range(8):
        r = got[str(i)]
        assert (r["position"], r["of"]) == (i + 1, 8)
        assert r["previous_id"] == (str(i - 1) if i else None) and r["next_id"] == (str(i + 1) if i < 7 else None)
        ring = [1, 4, 6]
        assert r["next_issue"] == str(next((x for x in ring if x > i), 1)) and r["previous_issue"] == str(next((x for x in ring[::-1] if x < i), 6))
    assert got["100"]["next_issue"] == got["100"]["previous_issue"] == "100" and got["101"]["next_issue"] == "100"
    assert got["200"]["next_issue"] is None and got["200"]["of"] == 1


def test_sorting(spark, records):
    order = lambda *a, **k: [int(r["record_id"]) for r in navigation.sort_records(records, *a, **k).collect()]
    assert order("event_ts") == [4, 1, 3, 2, 5] and order("severity", descending=True)[:4] == [5, 3, 2, 1] and order("subsystem") == [4, 5, 3, 1, 2]
    assert order(attribute="host") == [3, 4, 5, 1, 2]


def test_drill_down(records):
    got = sorted((r["cell"], int(r["record_id"])) for r in drilldown.issue_cells(records).collect())
    assert got == [("errors", 3), ("total", 2), ("total", 3), ("warnings", 2)]
    assert drilldown.issue_cells(records, ("INFO",)).count() == 0 and ids(drilldown.issue_cells(records, ("ERROR",)).where("cell = 'total'")) == [3]
    ms = lambda *a: int(at(*a).timestamp() * 1000)
    b = {int(r["record_id"]): (r["from_ms"], r["to_ms"]) for r in drilldown.bucket_records(records, 3_600_000, ms(10, 1), ms(10, 2)).collect()}
    assert b == {2: (ms(10, 1), ms(10, 2)), 3: (ms(10, 1), ms(10, 2))}


def test_relaxing_shows_the_record(spark, records):
    c = filters.Criteria(severities=("INFO",), subsystems=("Startup",), start="2026-08-08T10:00:00Z", end="2026-08-08T10:00:30Z", fields={"host": ("server-01",)}, search="begin", bookmarked_only=True)
    joined = state.with_state(records, spark.createDataFrame([("s", "1", True, "", "Open")], "session_id string, record_id string, bookmarked boolean, note string, status string"))
    wide = {r["record_id"]: r for r in drilldown.relax_for(joined, c).collect()}
    assert sorted(wide) == ["2", "3", "4", "5"]
    for i, w in wide.items():
        stamp = lambda t: t.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if t else None
        eased = filters.Criteria(tuple(w["severities"]), tuple(w["subsystems"]), tuple(w["event_codes"]), tuple(w["entity_ids"]), stamp(w["start"]), stamp(w["end"]), {k: tuple(v) for k, v in w["fields"].items()}, w["search"], tuple(w["statuses"]), w["bookmarked_only"])
        assert int(i) in ids(filters.filter_records(joined, eased)), w
    assert wide["2"]["fields"] == {"host": ["server-01", "server-02"]} and wide["3"]["fields"] == {} and wide["2"]["severities"] == ["INFO", "WARN"] and wide["4"]["severities"] == []


def test_state(spark, records):
    log = [("s", "1", "bookmarked", "true", 1), ("s", "1", "bookmarked", "false", 2), ("s", "2", "status", "Open", 1), ("s", "2", "note", "look", 2), ("s", "3", "status", "Dismissed", 1), ("s", "3", "status", "None", 2), ("s", "5", "status", "Resolved", 1), ("s", " ", "bookmarked", "true", 1), ("s", "99", "bookmarked", "true", 5)]
    now = state.current_state(spark.createDataFrame(log, "session_id string, record_id string, field string, value string, seq int"))
    assert sorted(tuple(r)[1:] for r in now.collect()) == [("2", False, "look", "Open"), ("5", False, "", "Resolved"), ("99", True, "", "None")]
    assert sorted(r["record_id"] for r in state.prune_state(now, records).collect()) == ["2", "5"]
    assert ids(filters.filter_records(state.with_state(records, now), filters.Criteria(statuses=("Open", "Resolved", "None")))) == [2, 5]
    assert state.bookmarked_records(records, now).count() == 0
    assert [(r["record_id"], r["text"]) for r in state.findings_review(records, now).collect()] == [("2", "look"), ("5", "(No analyst note) \u2014 X \u2014 night")]
    assert state.finding_counts(now).first()[1:] == (1, 1, 0)


def test_export(spark, records, tmp_path):
    odd = frame(spark, [rec(1, at(10), "INFO", message='a, "b"', Zed=" x ", alpha="1"), rec(2, None, None, None, None, None, None, alpha=None), rec(3, at(11), "WARN", message="two\nlines")]).coalesce(1)
    export.write_csv(odd, f"file://{tmp_path}/csv")
    text = next((tmp_path / "csv").glob("part*.csv")).read_text()
    assert text == 'Timestamp,Severity,Subsystem,Event Code,Entity ID,Message,alpha,Zed\n2026-08-08T10:00:00.000Z,INFO,S,C,E,"a, ""b""",1, x \n,,,,,,,\n2026-08-08T11:00:00.000Z,WARN,S,C,E,"two\nlines",,\n'
    with pytest.raises(ValueError):
        export.wide(odd, [str(i) for i in range(2_001)])
    assert [r[0] for r in export.visible_columns(odd.where("record_id = 2")).collect()] == ["alpha"]
    assert "Zed:  x " in odd.where("record_id = 1").select(export.detail_text()).first()[0]
    assert export.long_form(odd).where("record_id = 3").first()["attribute"] is None


def test_bursts_and_comparison(spark):
    rows = [rec(i, at(1, 0, i * 10), "ERROR") for i in range(4)] + [rec(10, at(2), "WARN"), rec(11, at(3), "INFO")] + [rec(20, at(1), "WARN", code="N", session="t")]
    got = bursts.issue_bursts(frame(spark, rows), 60_000, 3).collect()
    assert [(r["issues"], r["to_ms"] - r["from_ms"], r["burst"]) for r in got] == [(4, 30_000, 1)]
    both = {r["value"]: (r["records_a"], r["records_b"], r["only_in"]) for r in analysis.compare_sessions(frame(spark, rows), "s", "t", "event_code").collect()}
    assert both == {"C": (6, 0, "s"), "N": (0, 1, "t")}


def test_rates_and_findings_export(spark, records, tmp_path):
    r = {x["session_id"]: x for x in analysis.session_rates(frame(spark, [rec(1, at(1), "WARN"), rec(2, at(1, 2), "INFO"), rec(3, at(1), None, session="t")])).collect()}
    assert tuple(r["s"])[1:] == (2, 1, 120_000, 1.0) and r["t"]["per_minute"] is None
    now = spark.createDataFrame([("s", "2", False, "look, here", "Open")], "session_id string, record_id string, bookmarked boolean, note string, status string")
    export.write_findings(state.findings_review(records, now).coalesce(1), f"file://{tmp_path}/f")
    text = next((tmp_path / "f").glob("part*.csv")).read_text()
    assert text == 'Session,Record,Timestamp,Status,Finding\ns,2,2026-08-08T10:02:00.000Z,Open,"look, here"\n'


def test_normalisation(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for text, want in ((" fatal ", "CRITICAL"), ("Information", "INFO"), ("warning", "WARN"), ("notice", None), (None, None)):
        assert one(parse_severity(F.lit(text).cast("string"))) == want
    assert one(parse_severity(F.lit("ERROR"), {"error": "INFO"})) == "INFO"
    for text, want in (("2026-08-08T10:00:00+02:00", "2026-08-08T08:00:00.000Z"), ("2026-08-08 10:00:00,5", "2026-08-08T10:00:00.500Z"), ("2026", None), ("2026-13-01", None), ("2026-08-08T10:00", "2026-08-08T10:00:00.000Z")):
        assert one(display_timestamp(parse_timestamp(F.lit(text)))) == want
    assert qt_pattern("dd/MMM/yyyy:HH:mm:ss tt") == "dd/MMM/yyyy:HH:mm:ss Z" and qt_pattern("yyyy-MM-ddTHH:mm:ss.zzz") == "yyyy-MM-dd'T'HH:mm:ss.SSS"
    for path, want in ((" C:\\logs\\.\\a\\..\\b.log ", "C:/logs/b.log"), ("/a//b/../../../c", "/c"), ("../x", "../x"), ("", "")):
        assert one(clean_path(F.lit(path))) == want


def test_live_timeline(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{n}" for n in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    for n, minutes in enumerate(([0, 0, 1], [3, 30], [1, 45])):
        (tmp_path / "in" / f"{n}.log").write_text("".join(f"timestamp=2026-08-08T10:{m:02d}:05Z level=warn message=x\n" for m in minutes))
        lines = live.follow_lines(spark, src)
        records = live.follow_records(lines, Profile(format_id="key-value"))
        live.write_live(live.live_timeline(records), out, ck).awaitTermination()
    got = sorted((r["bucket_start"].minute, r["total"], r["warn"]) for r in spark.read.parquet(out).collect())
    # The line of minute 1 that comes after minute 30 is late; the last buckets wait for the watermark.
    assert got == [(0, 2, 2), (1, 1, 1), (3, 1, 1), (30, 1, 1)]
    with pytest.raises(ValueError):
        live.follow_records(lines, Profile(format_id="csv"))


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_positions_do_not_depend_on_the_plan(spark, reuse):
    """Pieces stay as they are, whether Spark reuses an exchange or samples its ranges anew."""
    rows = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("session_id"), F.col("id").cast("string").alias("record_id"), F.timestamp_millis(F.xxhash64("id") % 500_000).alias("event_ts"), F.when(F.col("id") % 97 == 0, "ERROR").otherwise("INFO").alias("severity"), F.when(F.col("id") % 97 == 0, 4).otherwise(2).alias("severity_rank"), F.lit("p").alias("source_path"), F.col("id").alias("record_number"))
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.adaptive.enabled", reuse)
    try:
        found = navigation.navigate(rows, "event_ts")
        assert found.select("session_id", "position").distinct().count() == 20_000
        assert found.agg(F.max("position"), F.max("of")).first() == (6667, 6667)
        placed = navigation.places(navigation.sort_records(rows, "severity", descending=True))
        assert placed.select("session_id", "place").distinct().count() == 20_000
        assert placed.where("severity = 'ERROR'").groupBy("session_id").agg((F.max("place") == F.count("*")).alias("first")).where("first").count() == 3
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bursts_go_on_over_pieces(spark):
    issues = spark.range(3_000).select(F.lit("s").alias("session_id"), F.when(F.col("id") % 2 == 0, "a").alias("subsystem"), F.col("id").cast("string").alias("record_id"), F.lit("ERROR").alias("severity"), F.timestamp_millis(F.col("id") * 10 + F.floor(F.col("id") / 1_000) * 100_000).alias("event_ts"))
    got = sorted((str(r["subsystem"]), r["burst"], r["issues"]) for r in bursts.issue_bursts(issues.repartition(7), 1_000, 3).collect())
    assert got == [(k, b, 500) for k in ("None", "a") for b in (1, 2, 3)]
