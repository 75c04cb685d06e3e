"""Hand-written cases for each format: one for each diagnostic code and each rule."""

import json

import pytest
from pyspark.sql import functions as F

from emberlog.plans.ingest import write_result
from emberlog.profile import APACHE_COMMON, IIS_W3C, WINDOWS_EVENTS, Profile, from_json, problems, to_json
from emberlog.session import prepared
from emberlog.sources.json_sources import ingest_json_documents, ingest_json_lines
from emberlog.sources.lines import read_lines
from emberlog.sources.registry import discover_attributes, ingest, preview, suggest_formats
from emberlog.sources.syslog import ingest_syslog
from emberlog.sources.text_sources import ingest_delimited, ingest_key_value, ingest_regex
from emberlog.sources.w3c import ingest_w3c
from emberlog.sources.xml_source import ingest_xml_documents

LINES = "session_id string, source_path string, source_name string, record_number long, raw_source string"


def lines(spark, *texts, path="/a.log"):
    prepared(spark)
    return spark.createDataFrame([("s", path, path[1:], i + 1, t) for i, t in enumerate(texts)], LINES)


def rows(result):
    return {r["record_number"]: r for r in result.records.collect()}


def codes(result):
    return sorted((r["record_number"] or 0, r["code"], r["severity"]) for r in result.diagnostics.collect())


def stats(result):
    r = result.stats.first()
    return (r["processed"], r["imported"], r["skipped"], r["has_warnings"], r["has_errors"])


def test_json_lines(spark):
    r = ingest_json_lines(
        lines(
            spark,
            '{"timestamp":"2026-08-08T10:00:00.123Z","level":" warn ","subsystem":"A","eventCode":7,"entityId":" ","message":"m","a":{"b":{"c":1,"d":[1,2]}},"e":{},"n":null,"t":true,"x":38,"y":1.5}',
            "", "  ", "{bad", "[1]", "3", '{"level":"loud","timestamp":"soon","message":"x","message":"last"}', '{"timestamp":"2026-08-08"}', '{"timestamp":"2026"}',
        ),
        Profile(),
    )
    got = rows(r)
    assert sorted(got) == [1, 7, 8, 9]
    one = got[1]
    assert (one["severity"], one["severity_rank"], one["subsystem"], one["event_code"], one["entity_id"], one["message"]) == ("WARN", 3, "A", None, None, "m")
    assert one["event_ts_text"] == "2026-08-08T10:00:00.123Z"
    assert one["attributes"] == {"a.b.c": "1", "a.b.d": "[1,2]", "n": None, "t": "true", "x": "38", "y": "1.5"} and one["structured"] == ["a.b.d"]
    assert got[7]["message"] == "last" and got[7]["severity"] is None and got[8]["event_ts_text"] == "2026-08-08T00:00:00.000Z" and got[9]["event_ts"] is None
    assert codes(r) == [(4, "MALFORMED_JSON", "Error"), (5, "JSON_VALUE_NOT_OBJECT", "Error"), (6, "JSON_VALUE_NOT_OBJECT", "Error"), (7, "INVALID_TIMESTAMP", "Warning"), (7, "UNMAPPED_SEVERITY", "Warning"), (9, "INVALID_TIMESTAMP", "Warning")]
    assert stats(r) == (7, 4, 3, True, True)


def test_mapped_paths_and_custom_fields(spark):
    p = Profile(canonical={"timestamp": "meta.at", "severity": "meta.lvl", "subsystem": "", "event_code": "code", "entity_id": "who", "message": "text"}, custom={"Host": "meta.host", "all": "more", "zip": "zip"}, severity_aliases={"Loud ": "ERROR"}, timestamp_rules=("iso8601", "dd/MM/yyyy HH:mm:ss.zzz"))
    line = '{"meta":{"at":"08/08/2026 10:00:00.250","lvl":"LOUD","host":" h "},"code":{"#text":" c1 ","k":"v"},"who":"w","text":"t","more":{"a":1},"zip":"007","Host":"other"}'
    one = rows(ingest_json_lines(lines(spark, line), p))[1]
    assert (one["severity"], one["event_code"], one["event_ts_text"]) == ("ERROR", "c1", "2026-08-08T10:00:00.250Z")
    assert one["attributes"] == {"Host": " h ", "all": '{"a":1}', "zip": "007"} and one["structured"] == ["all"]
    import dataclasses

    bare = rows(ingest_json_lines(lines(spark, line), dataclasses.replace(p, custom={}, preserve_unmapped=False)))[1]
    assert bare["attributes"] == {}


def documents(spark, *texts):
    prepared(spark)
    return spark.createDataFrame([("s", f"/{i}.json", f"{i}.json", t) for i, t in enumerate(texts)], "session_id string, source_path string, source_name string, document string")


def test_json_documents(spark):
    r = ingest_json_documents(documents(spark, '[{"message":"a"}, 3, {"message":"b"}]', '{"message":"c"}', "nope", "4"), Profile(format_id="structured-json"))
    assert sorted((x["source_name"], x["record_number"], x["message"], x["raw_source"]) for x in r.records.collect()) == [("0.json", 1, "a", '{"message":"a"}'), ("0.json", 3, "b", '{"message":"b"}'), ("1.json", 1, "c", '{"message":"c"}')]
    assert sorted((x["source_name"], x["code"]) for x in r.diagnostics.collect()) == [("0.json", "STRUCTURED_JSON_RECORD_NOT_OBJECT"), ("2.json", "MALFORMED_JSON_DOCUMENT"), ("3.json", "STRUCTURED_JSON_ROOT_UNSUPPORTED")]
    r = ingest_json_documents(documents(spark, '{"d":{"r":[{"message":"a"}]}}', "[1]", '{"d":{}}', '{"d":{"r":5}}', '{"d":{"r":{"message":"z"}}}'), Profile(format_id="structured-json", record_path="d.r"))
    assert sorted((x["source_name"], x["message"]) for x in r.records.collect()) == [("0.json", "a"), ("4.json", "z")]
    assert sorted((x["source_name"], x["code"]) for x in r.diagnostics.collect()) == [("1.json", "JSON_RECORD_PATH_REQUIRES_OBJECT_ROOT"), ("2.json", "JSON_RECORD_PATH_NOT_FOUND"), ("3.json", "JSON_RECORD_PATH_NOT_CONTAINER")]


def test_delimited(spark):
    r = ingest_delimited(lines(spark, "", "\ufeff timestamp ,level,message,host", '2026-08-08T10:00:00Z,ERROR,"a, ""b""",h1', "x,y", '2026-08-08T10:00:00Z,INFO,"open,h', 'a,b,c"d,e', 'a,b,"c"d,e', "", ",,,"), Profile(format_id="csv"))
    got = rows(r)
    assert sorted(got) == [3, 9] and got[3]["message"] == 'a, "b"' and got[3]["attributes"] == {"host": "h1"} and got[9]["attributes"] == {"host": ""}
    assert codes(r) == [(4, "DELIMITED_COLUMN_COUNT_MISMATCH", "Error"), (5, "MALFORMED_DELIMITED_RECORD", "Error"), (6, "MALFORMED_DELIMITED_RECORD", "Error"), (7, "MALFORMED_DELIMITED_RECORD", "Error")]
    tsv = ingest_delimited(lines(spark, "message\tx", "a,b\t1"), Profile(format_id="tsv"))
    assert rows(tsv)[2]["message"] == "a,b"


@pytest.mark.parametrize("head,code", [("a,,b", "EMPTY_DELIMITED_HEADER"), ("a,A", "DUPLICATE_DELIMITED_HEADER"), ('a,"b', "MALFORMED_DELIMITED_HEADER"), (" ", "DELIMITED_HEADER_REQUIRED")])
def test_bad_headers_reject_the_source(spark, head, code):
    r = ingest_delimited(lines(spark, head, *(["1,2"] if head.strip() else [])), Profile(format_id="csv"))
    assert r.records.count() == 0 and codes(r) == [(0, code, "Error")]
    assert r.stats.first()["has_errors"]


def test_regex(spark):
    p = Profile(format_id="regex-text", pattern=r"(?<timestamp>\S+) (?<level>\w+)(?: (?<host_name>h\d))? - (?<message>.*)")
    r = ingest_regex(lines(spark, "2026-08-08T10:00:00Z INFO h1 - hello", "2026-08-08T10:00:00Z INFO - x", "nothing here"), p)
    got = rows(r)
    assert got[1]["attributes"] == {"host_name": "h1"} and got[2]["attributes"] == {} and codes(r) == [(3, "REGEX_RECORD_NO_MATCH", "Error")]
    with pytest.raises(ValueError, match="INVALID_REGEX_PATTERN"):
        ingest_regex(lines(spark, "x"), Profile(format_id="regex-text", pattern="(?<a>x"))
    web = rows(ingest_regex(lines(spark, '1.2.3.4 - bob [08/Aug/2026:10:00:00 +0200] "GET / HTTP/1.1" 404 -'), APACHE_COMMON))[1]
    assert web["event_ts_text"] == "2026-08-08T08:00:00.000Z" and web["message"] == "GET / HTTP/1.1" and web["attributes"]["HTTP Status"] == "404" and web["attributes"]["Remote User"] == "bob"


def test_key_value(spark):
    r = ingest_key_value(lines(spark, ' timestamp=2026-08-08T10:00:00Z level=warn message="say \\"hi\\"\\n\\q\\\\n" k= z=1 ', "a=1 a=2 a=3 b=1 b=1", "novalue", '=x', 'a="open', 'a="b"c', "", "a=b=c"), Profile(format_id="key-value"))
    got = rows(r)
    assert sorted(got) == [1, 2, 8]
    assert got[1]["message"] == 'say "hi"\n\\q\\n' and got[1]["attributes"] == {"k": "", "z": "1"}
    assert got[2]["attributes"] == {"a": "3", "b": "1"} and got[8]["attributes"] == {"a": "b=c"}
    assert codes(r) == [(2, "KEY_VALUE_DUPLICATE_KEY", "Warning")] * 2 + [(i, "KEY_VALUE_RECORD_MALFORMED", "Error") for i in (3, 4, 5, 6)]


def test_syslog(spark):
    r = ingest_syslog(
        lines(
            spark,
            '<165>1 2026-08-08T10:00:00.003Z host app 99 ID47 [ex@1 a="1" b="x\\"y\\]z\\q" a="2"][o@2] \ufeffhello',
            "<34>Oct 11 22:14:15 host su[77]: failed", "<0>1 - - - - - -", "<192>1 - - - - - -", "<13>Feb 29 00:00:00 h no tag here", "<13>Xyz 1 00:00:00 h x", '<13>1 - h a p m [x y="1"', '<13>1 - h a p m [x y="1"][x] dup',
        ),
        Profile(format_id="syslog"), "2026-01-05",
    )
    got = rows(r)
    assert sorted(got) == [1, 2, 3, 8]
    a = got[1]["attributes"]
    assert got[1]["severity"] == "INFO" and got[1]["message"] == "hello" and got[1]["subsystem"] == "app" and got[1]["event_code"] == "ID47"
    assert a["structuredDataFields.ex@1.a"] == '["1","2"]' and a["structuredDataFields.ex@1.b"] == 'x"y]z\\q' and a["facilityCode"] == "20" and a["syslogSeverity"] == "Notice"
    assert got[2]["severity"] == "CRITICAL" and got[2]["subsystem"] == "su" and got[2]["attributes"]["processId"] == "77" and got[2]["event_ts_text"] == "2025-10-11T22:14:15.000Z" and got[2]["message"] == "failed"
    assert got[3]["event_ts"] is None and got[3]["message"] is None
    assert "structuredData" in got[8]["attributes"] and not [k for k in got[8]["attributes"] if k.startswith("structuredDataFields")]
    assert [c for c in codes(r) if c[1] != "SYSLOG_RECORD_MALFORMED"] == [(0, "SYSLOG_LEGACY_TIMESTAMP_INFERRED", "Information")]
    assert [c[0] for c in codes(r) if c[1] == "SYSLOG_RECORD_MALFORMED"] == [4, 5, 6, 7]


def test_nearest_year_of_leap_day(spark):
    r = rows(ingest_syslog(lines(spark, "<13>Feb 29 00:00:00 h x: y", "<13>Dec 31 00:00:00 h x: y"), Profile(format_id="syslog"), "2025-01-01"))
    assert r[1]["event_ts_text"][:10] == "2024-02-29" and r[2]["event_ts_text"][:10] == "2024-12-31"


@pytest.mark.parametrize("few", [True, False, None])
def test_w3c(spark, few):
    r = ingest_w3c(lines(spark, "early line", "#Version: 1.0", "#Fields: date time cs-method cs-uri-stem cs-uri-query x", "2026-08-08 10:00:00 GET /a q=1 -", "short", "#Fields:", "lost", "#Fields: cs-method x", "PUT 5"), IIS_W3C, few)
    got = rows(r)
    assert sorted(got) == [4, 9]
    assert got[4]["message"] == "GET /a?q=1" and got[4]["event_ts_text"] == "2026-08-08T10:00:00.000Z" and got[4]["attributes"] == {"HTTP Method": "GET", "URI Stem": "/a", "URI Query": "q=1"}
    assert got[9]["message"] == "PUT" and got[9]["attributes"]["x"] == "5"
    assert codes(r) == [(1, "IIS_W3C_FIELDS_REQUIRED", "Error"), (5, "IIS_W3C_FIELD_COUNT_MISMATCH", "Error"), (6, "IIS_W3C_FIELDS_EMPTY", "Error"), (7, "IIS_W3C_FIELDS_REQUIRED", "Error")]
    assert stats(r)[:3] == (5, 2, 3)


EVENT = '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P" Guid="G"/><EventID Qualifiers="0">007</EventID><Level>2</Level><TimeCreated SystemTime="2026-08-08T10:00:00.000Z"/></System><EventData><Data Name="A">1</Data><Data Name="B">x</Data><Data Name="A">2</Data></EventData><RenderingInfo><Message> hi </Message></RenderingInfo></Event>'


def test_xml(spark, tmp_path):
    r = ingest_xml_documents(documents(spark, f"<?xml version='1.0'?><Events>{EVENT}{EVENT}</Events>", "", "plain", "<Other/>"), WINDOWS_EVENTS)
    got = r.records.collect()
    assert [x["record_number"] for x in got] == [1, 2]
    one = got[0]
    assert (one["severity"], one["subsystem"], one["event_code"], one["message"]) == ("ERROR", "P", "007", "hi")
    assert one["attributes"]["EventData.NamedData.A"] == '["1","2"]' and one["attributes"]["EventData.NamedData.B"] == "x" and one["attributes"]["Provider GUID"] == "G" and one["raw_source"] == EVENT
    assert "EventData.NamedData.A" in one["structured"] and not [k for k in one["attributes"] if "xmlns" in k]
    assert sorted(x["code"] for x in r.diagnostics.collect()) == ["XML_DOCUMENT_EMPTY", "XML_PARSE_ERROR", "XML_RECORD_PATH_NOT_FOUND"]
    (tmp_path / "big.xml").write_text("<?xml version='1.0'?>\n<session><events>" + "\n".join(f'<event sequence="{i}"><m><level>INFO</level></m><tag>a</tag><tag>b{i}</tag></event>' for i in range(40)) + "</events></session>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.option("lineSep", "</event>").text(str(tmp_path / "big.xml")).rdd.getNumPartitions() > 1
        r = ingest(spark, str(tmp_path / "big.xml"), Profile(format_id="xml", record_path="session.events.event", canonical={"severity": "m.level"}))
        got = rows(r)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == list(range(1, 41)) and all(got[i + 1]["attributes"] == {"@sequence": str(i), "tag": f'["a","b{i}"]'} and got[i + 1]["severity"] == "INFO" for i in range(40))


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    text = "".join(f"line {i}\r\n" if i % 3 else "\n" for i in range(1, 400))
    for n in "ab":
        (tmp_path / f"{n}.log").write_text(text)
    p = Profile(format_id="regex-text", pattern="(?<message>.*)")
    seen = []
    for size in ("128m", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = ingest(spark, str(tmp_path), p).records.select("source_name", "record_number", "record_id", "message").collect()
        seen.append(sorted(map(tuple, got)))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] and all(m == f"line {n}" for _, n, _, m in seen[0]) and len(seen[0]) == 2 * 266
    assert read_lines(spark, str(tmp_path)).count() == 2 * 399


def test_preview_and_discovery(spark):
    r = ingest_json_lines(lines(spark, *[json.dumps({"message": str(i), "Zed": 1, "alpha": {"b": 2}}) for i in range(7)]), Profile())
    first, more = preview(r, 3)
    assert sorted(x["record_number"] for x in first.collect()) == [1, 2, 3] and more.first()["truncated"]
    assert not preview(r, 7)[1].first()["truncated"]
    with pytest.raises(ValueError):
        preview(r, 0)
    assert [x[0] for x in discover_attributes(r.records, Profile()).collect()] == ["alpha.b", "Zed"]


def test_format_suggestions(spark):
    web = '1.2.3.4 - - [08/Aug/2026:10:00:00 +0200] "GET / HTTP/1.1" 200 5'
    cases = {
        "/a.jsonl": (["x"], "json-lines", None), "/b.CSV": (["x"], "csv", None), "/c.xml": (['<?xml version="1.0"?>', "<Events>", EVENT, "</Events>"], "xml", "windows-event-xml-collection"), "/d.xml": (["<a/>"], "xml", None), "/e.xml": ([EVENT], "xml", "windows-event-xml"),
        "/f.log": (["", '{"a":1}', '{"b":2}'], "json-lines", None), "/g.log": (['{"a":1}', "x"], None, None), "/h.log": ([web], "regex-text", "apache-common"), "/i.log": ([web + ' "-" "agent"'], "regex-text", "web-combined"),
        "/j.log": (["#Software: x", "#Fields: date time cs-method sc-status", "x"], "iis-w3c", "iis-w3c"), "/k.log": (["x", "#Fields: date time cs-method sc-status"], None, None), "/l": (["a=1 b=2", "c=3 d=4"], "key-value", None), "/m": (["a=1"], None, None),
        "/n.txt": (["<34>Oct 11 22:14:15 host su: x", "<165>1 - h a p m - x"], "syslog", None), "/o.txt": (["  "], None, None),
    }
    df = None
    for path, (texts, *_) in cases.items():
        one = lines(spark, *texts, path=path)
        df = one if df is None else df.unionByName(one)
    got = {r["source_path"]: (r["format_id"], r["preset_id"]) for r in suggest_formats(df).collect()}
    assert got == {p: (f, s) for p, (_, f, s) in cases.items()}


def test_profiles():
    for p in (IIS_W3C, WINDOWS_EVENTS, APACHE_COMMON, Profile(custom={"a": "b.c"}, severity_aliases={"x": "WARN"}, timestamp_rules=("iso8601", "yyyy"))):
        assert problems(p) == [] and from_json(to_json(p)) == p
    with pytest.raises(ValueError):
        from_json('{"schemaVersion": 2}')
    assert problems(Profile(format_id="x")) and problems(Profile(severity_aliases={"a": "LOUD"})) and problems(Profile(canonical={"message": "a..b"})) and problems(Profile(timestamp_rules=())) and problems(Profile(custom={"a": "x", "A ": "y"}))


def test_overwriting_replaces_only_the_sessions_that_are_there(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    both = lines(spark, '{"message":"a"}').unionByName(lines(spark, '{"message":"b"}').withColumn("session_id", F.lit("t")))
    write_result(ingest_json_lines(both, Profile()), path)
    write_result(ingest_json_lines(lines(spark, '{"message":"new"}'), Profile()), path)
    assert sorted((r["session_id"], r["message"]) for r in spark.read.parquet(f"{path}/records").collect()) == [("s", "new"), ("t", "b")]


def test_json_of_any_depth(spark):
    deep = {"leaf": 1}
    for i in range(12):
        deep = {f"l{i}": deep, "s": i}
    p = Profile(canonical={"message": ".".join([f"l{i}" for i in reversed(range(12))] + ["leaf"])}, custom={"whole": "l11.l10"})
    row = ingest_json_lines(lines(spark, json.dumps(deep), '{"a": "{{{"}', '{"o": {}, "p": [{"q": 1}]}'), p).records.orderBy("record_number").collect()
    assert row[0]["attributes"]["s"] == "11" and "l9" in row[0]["attributes"]["whole"] and row[0]["message"] is None  # a number is no text
    assert row[1]["attributes"] == {"a": "{{{"}
    assert row[2]["attributes"] == {"p": '[{"q":1}]'}
    path = "l11." + ".".join(f"l{i}" for i in reversed(range(11))) + ".leaf"
    flat = ingest_json_lines(lines(spark, json.dumps(deep)), Profile(canonical={})).records.first()["attributes"]
    assert flat[path] == "1" and flat["l11.l10.s"] == "9" and len(flat) == 13


def test_empty_captures_are_kept_and_absent_ones_are_not(spark):
    p = Profile(format_id="regex-text", canonical={"message": "m"}, pattern=r"(?<m>\w+):(?<x>\d*)(?:;(?<y>\d*))?")
    got = [r["attributes"] for r in ingest_regex(lines(spark, "a:1;2", "a:;", "a:"), p).records.orderBy("record_number").collect()]
    assert got == [{"x": "1", "y": "2"}, {"x": "", "y": ""}, {"x": ""}]


def test_escapes_and_control_characters(spark):
    raw = 'k="a\u0001b" e="\\\\n \\n \\" \\q"'
    got = ingest_key_value(lines(spark, raw), Profile(format_id="key-value")).records.first()["attributes"]
    assert got == {"k": "a\u0001b", "e": '\\n \n " \\q'}


def test_words_of_a_legacy_syslog_line(spark):
    texts = ["<13>Oct  1 22:14:15 host app[1:2]: a: b", "<13>Oct 1 22:14:15 host app:no blank", "<13>Oct 1 22:14:15 host", "<13>Oct 1 22:14:15 host path/app[7]: x", "<13>Oct 1 22:14:15 host app[]: x", "<13>Oct 1 22:14:15 host app[7] x: y", "<13>Oct 1 22:14:15 host app[7:x", "<13>Oct +1 22:14:15 host x: y", "<13>Oct 1 22:14:5 host x: y", "<13>Oct 1 25:14:15 host x: y", "<13>oct 1 22:14:15 host x: y"]
    got = rows(ingest_syslog(lines(spark, *texts), Profile(format_id="syslog"), "2026-10-05"))
    told = {n: (r["subsystem"], r["attributes"].get("processId"), r["message"]) for n, r in got.items()}
    assert told == {1: ("app", "1:2", "a: b"), 2: ("app", None, "no blank"), 3: (None, None, None), 4: (None, None, "path/app[7]: x"), 5: (None, None, "app[]: x"), 6: (None, None, "app[7] x: y"), 7: (None, None, "app[7:x")}
