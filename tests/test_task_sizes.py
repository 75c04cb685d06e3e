"""That work is cut by rows, that dates are not parsed in vain, and that what is asked thrice is parsed once."""

from pyspark.sql import functions as F

from emberlog import queries, session
from emberlog.functions.normalize import nearest_year, parse_severity
from emberlog.plans.ingest import SOURCE
from emberlog.profile import Profile
from emberlog.sources.json_sources import ingest_json_lines
from emberlog.sources.syslog import ingest_syslog
from emberlog.sources.xml_source import fields_of


def lines(spark, *texts):
    rows = [("s", "/a.log", "a.log", i, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in SOURCE) + ", record_number long, raw_source string")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_row_group_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    spark.range(3_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    spread = session.spread_out(spark.read.parquet(str(tmp_path / "t")))
    sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3_000 and max(sizes) <= 110


def test_files_with_more_splits_than_cores_are_dealt_too(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    uneven = spark.range(1_000, numPartitions=64).where("id < 500")
    assert session.spread_out(uneven).rdd.getNumPartitions() == max(50, spark.sparkContext.defaultParallelism)


def test_syslog_does_not_parse_dates_to_find_out_that_there_is_none(spark):
    plan = plan_of(ingest_syslog(lines(spark, "<134>1 - h a - - - x"), Profile(format_id="syslog"), "2024-02-01").records)
    assert "HH:mm:ss, TimestampType" not in plan and "gettimestamp" not in plan.lower()


def test_nearest_years_of_days_that_do_not_exist(spark):
    pairs = [(2, 29), (2, 30), (13, 1), (0, 1), (4, 31), (1, 0), (12, 31), (None, 1)]
    got = spark.createDataFrame(pairs, "m int, d int").select(nearest_year(F.col("m"), F.col("d"), F.lit("2023-03-01").cast("date")).cast("string")).collect()
    assert [r[0] for r in got] == ["2024-02-29", None, None, None, None, None, "2022-12-31", None]


def test_legacy_clocks(spark):
    made = ingest_syslog(lines(spark, *(f"<34>Oct 1 {c} h a: x" for c in ("23:59:59", "24:00:00", "12:60:00", "1:02:03", "12:00:60"))), Profile(format_id="syslog"), "2024-02-01").records
    assert [r[0] for r in made.select("record_number").collect()] == [1]


def test_repeated_and_single_parameters(spark):
    got = ingest_syslog(lines(spark, '<134>1 - h a - - [x a="1" b="2"][y c="3" c="4"] m'), Profile(format_id="syslog"), "2024-02-01").records.first()
    own = {k: v for k, v in got["attributes"].items() if k.startswith("structuredDataFields")}
    assert own == {"structuredDataFields.x.a": "1", "structuredDataFields.x.b": "2", "structuredDataFields.y.c": '["3","4"]'}
    assert got["structured"] == ["structuredDataFields.y.c"]


def test_attributes_below_a_mapped_path_are_not_kept(spark):
    got = ingest_json_lines(lines(spark, '{"message": {"a": 1}, "messages": 2, "x": {"message": 3}}'), Profile()).records.first()
    assert got["attributes"] == {"messages": "2", "x.message": "3"}


def test_what_is_asked_thrice_is_parsed_once(spark):
    found = ingest_json_lines(lines(spark, '{"message": "a", "level": "odd"}', "{"), Profile())
    kept = found.once()
    for kind in ("records", "diagnostics", "stats"):
        assert "parse_json" not in plan_of(getattr(kept, kind)).lower()
        order = getattr(found, kind).columns
        assert sorted(map(str, getattr(kept, kind).select(order).collect())) == sorted(map(str, getattr(found, kind).collect()))


def test_elements_whose_prefix_is_declared_around_them():
    assert fields_of('<p:e p:a="1" xmlns="u"><p:b>2</p:b></p:e>') == ([("@a", "1"), ("b", "2")], [])
    assert fields_of('<e xmlns:p="u" p:a="1">x<!-- c -->y<p:b/>z</e>') == ([("@a", "1"), ("b", ""), ("#text", "xyz")], [])
    assert fields_of("<e><a></e>") is None


def test_document_files_grow_with_records_not_with_parts(spark):
    rows = spark.range(4_000).select(F.lit("s").alias("session_id"), F.concat(F.lit("/logs/part-"), F.col("id") % 4, F.lit(".log")).alias("source_path"), F.col("id").alias("record_number"), F.col("id").cast("string").alias("raw_source"))
    docs = queries.documents_of(rows, 3, "[", ",", "]", queries.FILE_RECORDS)
    assert docs.count() == 4
    assert docs.selectExpr("sum(size(split(document, ',')))").first()[0] == 4_000


def test_lines_are_rendered_behind_the_spread(spark, tmp_path):
    spark.range(100).selectExpr("id as event_id", "timestamp_millis(id) as ts", "id as user_id", "'error' as event_type", "'{\"k\": 1}' as props").write.parquet(str(tmp_path / "events.parquet"))
    for name in ("jsonl_roundtrip", "syslog5424_roundtrip", "exported_csv"):
        lines_of = {"jsonl_roundtrip": queries.json_lines, "exported_csv": queries.json_lines, "syslog5424_roundtrip": lambda *a: queries.rendered(*a, F.concat("t", "message"))}[name]
        plan = plan_of(lines_of(spark, str(tmp_path)).where(F.col("raw_source").rlike(r"\S")))
        assert "date_format" in plan.split("Repartition")[0] and "date_format" not in plan.split("Repartition")[1] and "\\S" not in plan.split("Repartition")[1]


def test_syslog_splits_a_header_once_and_no_cast_fails(spark):
    profile = Profile(format_id="syslog")
    plan = plan_of(ingest_syslog(lines(spark, "<134>1 - h a - - - x"), profile, "2024-02-01").records)
    assert plan.count("\\s+, 5") == 1 and plan.count("regexp_extract_all(") <= 3
    texts = ["<34>1 - h a - - - m", "<034>01 - h a - - - m", "<192>1 - h a - - - m", "<34>0 - h a - - - m", "<34>000 - h a - - - m", "<34>Oct 1 01:02:03 h a[1:2]: x", "<34>Oct 1 01:02:03 h a[]: x", "<34>Oct 1 01:02:03 h a[7]x", "<34>Oct 1 01:02:03 h a:\tx:y"]
    made = ingest_syslog(lines(spark, *texts), profile, "2024-02-01").records
    got = {r["record_number"]: (r["subsystem"], r["message"], r["attributes"].get("processId")) for r in made.collect()}
    assert got == {1: ("a", "m", None), 2: ("a", "m", None), 6: ("a", "x", "1:2"), 7: (None, "a[]: x", None), 8: (None, "a[7]x", None), 9: ("a", "x:y", None)}


def test_severities_in_any_case_with_aliases_first(spark):
    texts = ["error", "ERROR", "Error", "eRRor", " warning", "Fatal", "Odd", "ODD", "oDD", "x", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_severity(F.col("t"), {"odd ": "DEBUG", "Warning": "TRACE"})).collect()
    assert [r[0] for r in got] == ["ERROR"] * 4 + ["TRACE", "CRITICAL", "DEBUG", "DEBUG", "DEBUG", None, None]


def test_custom_paths_that_name_objects_are_looked_for_only_where_there_can_be_one(spark):
    profile = Profile(custom={"k": "props.k"})
    texts = ['{"props": {"k": {"a": 1}}}', '{"props": {"k": {}}}', '{"props": {"k": 1}}', '{"props.k": 1, "props": {"k": {"b": {"c": 2}}}}', '{"props": 1, "x": "{{{"}']
    made = ingest_json_lines(lines(session.prepared(spark), *texts), profile).records
    assert [r["attributes"].get("k") for r in made.orderBy("record_number").collect()] == ['{"a":1}', "{}", "1", '{"b":{"c":2}}', None]
    before = plan_of(made).lower().split("variant_get(")
    assert len(before) > 1 and all("raw_source" in b[-120:] and "{" in b[-120:] for b in before[:-1])
