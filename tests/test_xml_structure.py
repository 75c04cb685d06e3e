"""Elements by their whole path: wrong parents, nested names, comments, CDATA, quoted brackets, in splits of any size."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog import queries
from emberlog.profile import Profile
from emberlog.session import prepared
from emberlog.sources import splits, xml_source
from emberlog.sources.registry import ingest
from emberlog.sources.xml_source import MODES, Scan, after, effects, fields_of, ingest_xml, ingest_xml_documents


def documents(spark, *texts):
    prepared(spark)
    return spark.createDataFrame([("s", f"/{i}.xml", f"{i}.xml", t) for i, t in enumerate(texts)], "session_id string, source_path string, source_name string, document string")


def found(result):
    return [(r["source_name"], r["record_number"], r["raw_source"]) for r in result.records.orderBy("source_name", "record_number").collect()], sorted((r["source_name"], r["code"]) for r in result.diagnostics.collect())


def profile(path):
    return Profile(format_id="xml", record_path=path, canonical={"message": "m"})


def test_only_the_whole_path_counts(spark):
    got = found(ingest_xml_documents(documents(spark, "<a><b><c/></b><x><c/></x><!-- <c/> --></a>", "<a><x><y><c/></y></x></a>"), profile("a.x.c")))
    assert got == ([("0.xml", 1, "<c/>")], [("1.xml", "XML_RECORD_PATH_NOT_FOUND")])


def test_nested_names_comments_cdata_and_quoted_brackets(spark):
    text = '<?xml version="1.0"?><!DOCTYPE r [<!ENTITY x "y>z">]>\n<r><!-- <e/> > --><e><e/>..</e><e a="x>y" b=\'/e>\'><![CDATA[</e> > <e>]]></e><p:e xmlns:p="u">1 > 0</p:e></r>\n<!-- end -->'
    got, codes = found(ingest_xml_documents(documents(spark, text), profile("r.e")))
    assert [r[2] for r in got] == ["<e><e/>..</e>", '<e a="x>y" b=\'/e>\'><![CDATA[</e> > <e>]]></e>', '<p:e xmlns:p="u">1 > 0</p:e>'] and codes == []
    assert found(ingest_xml_documents(documents(spark, "<r a='1'> t </r>"), profile(""))) == ([("0.xml", 1, "<r a='1'> t </r>")], [])


@pytest.mark.parametrize("text, n, code", [("<r><e>1</e><e>2</r>", 1, "XML_PARSE_ERROR"), ("<r><e>1</e>", 1, "XML_PARSE_ERROR"), ("<r><e>1</e></r><r><e/></r>", 1, "XML_PARSE_ERROR"), (" \n", 0, "XML_DOCUMENT_EMPTY"), ("text", 0, "XML_PARSE_ERROR"), ("</r>", 0, "XML_PARSE_ERROR"), ("<r><e>&no;</e><e>2</e></r>", 1, "XML_PARSE_ERROR"), (None, 0, "XML_DOCUMENT_EMPTY"), ("<r><!-- x </r>", 0, "XML_PARSE_ERROR")])
def test_records_before_an_error_stay(spark, text, n, code):
    got, codes = found(ingest_xml_documents(documents(spark, text), profile("r.e")))
    assert len(got) == n and codes == [("0.xml", code)]


def test_fields():
    element = '<e a=" 1 " p:b="2" xmlns="u" xmlns:p="v"><x> 007 </x><x/><y k="1">t<z/></y><Data Name=" N ">1</Data><Data Name="N"/><Data>3</Data><Data Name="M" x="5">&lt;</Data></e>'
    pairs, lists = fields_of(element)
    assert dict(pairs) == {"@a": " 1 ", "@b": "2", "x": '["007",""]', "y.@k": "1", "y.#text": "t", "y.z": "", "NamedData.N": '["1",""]', "NamedData.M": "<", "Data": "3"}
    assert sorted(lists) == ["NamedData.N", "x"]
    assert fields_of("<e> t </e>") == ([("#text", "t")], []) and fields_of("<e><f></e>") is None
    assert fields_of('<Data Name="n">v</Data>') == ([("@Name", "n"), ("#text", "v")], [])


def test_fields_of_the_last_element_only_need_no_schema(spark):
    texts = [("s", "/a", "a", i + 1, f"<e><m>{i}</m></e>") for i in range(1_500)] + [("s", "/a", "a", 1501, "<e late='1'><rare>x</rare></e>")]
    elements = spark.createDataFrame(texts, "session_id string, source_path string, source_name string, record_number long, raw_source string").coalesce(1)
    names = {k for r in ingest_xml(elements, Profile(format_id="xml", canonical={})).records.select("attributes").collect() for k in r[0]}
    assert names == {"m", "@late", "rare"}
    assert ingest_xml(elements.where("false"), Profile(format_id="xml")).records.count() == 0


def invented(r, depth=0):
    out = []
    for _ in range(r.randint(0, 4)):
        kind = r.randrange(8)
        if kind < 4 and depth < 4:
            name = r.choice(["a", "b", "c", "p:c"])
            quote = r.choice(["", ' k="v"', ' k="1>2"', " k='/c>'", ' k="it\'s" l="/"', ' k=">!--"'])
            out.append(f"<{name}{quote}/>" if r.random() < 0.3 else f"<{name}{quote}>{invented(r, depth + 1)}</{name}>")
        else:
            out.append(r.choice(["text", "1 > 0", "<!-- <c> > -->", "<!---->", "<![CDATA[</c>>]]>", "<?pi <c>?>", " ", "é"]))
    return "".join(out)


def brute(text, path):
    """Elements at a path, by one scan of the whole document."""
    import re

    token = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/?)([^\s/>!?]+)(?:\"[^\"]*\"|'[^']*'|[^>\"'])*?(/?)>", re.S)
    stack, start, out = [], None, []
    for m in token.finditer(text):
        if not m[2]:
            continue
        name = m[2].split(":")[-1]
        if m[1]:
            if stack == path and start is not None:
                out.append(text[start : m.end()])
                start = None
            stack.pop()
            continue
        stack.append(name)
        if stack == path and start is None:
            start = m.start()
        if m[3]:
            if stack == path:
                out.append(text[start : m.end()])
                start = None
            stack.pop()
    return out


def test_effects_compose_wherever_a_document_is_split():
    for seed in range(60):
        r = random.Random(seed)
        pieces = ("<r>" + invented(r) + invented(r) + "</r>\n").split(">")
        whole = Scan("", [])
        states = []
        for p in pieces:
            states.append([whole.mode, list(whole.stack), whole.done, ""])
            whole.feed(p)
        cuts = sorted(r.sample(range(1, len(pieces)), min(len(pieces) - 1, r.randint(0, 5))))
        state = ["", [], False, ""]
        for lo, hi in zip([0, *cuts], [*cuts, len(pieces)]):
            assert state == states[lo]
            state = after(state, effects((False, p) for p in pieces[lo:hi]))
        assert state == [whole.mode, whole.stack, whole.done, ""]
    assert set(effects(iter([(True, "x")]))) == set(MODES)


@pytest.mark.parametrize("size", ["300"])
def test_files_are_cut_by_many_tasks(spark, tmp_path, size):
    texts = {}
    for seed in range(3):
        r = random.Random(seed)
        texts[f"{seed}.xml"] = "<r>" + "".join(f"<a>{invented(r)}</a>" for _ in range(12)) + "</r>"
        (tmp_path / f"{seed}.xml").write_text(texts[f"{seed}.xml"])
    (tmp_path / "bad.xml").write_text("<r>" + "<a><c>1</c></a>" * 20 + "</a>" + "<a><c>2</c></a>" * 20 + "</r>")
    (tmp_path / "open.xml").write_text("<r>" + "<a><c>1</c></a>" * 20 + "<a><c>")
    want = [(n, i + 1, e) for n, t in sorted(texts.items()) for i, e in enumerate(brute(t, ["r", "a", "c"]))]
    want += [("bad.xml", i + 1, "<c>1</c>") for i in range(20)] + [("open.xml", i + 1, "<c>1</c>") for i in range(20)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got, codes = found(ingest(spark, str(tmp_path), profile("r.a.c")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want
    none = {(n, "XML_RECORD_PATH_NOT_FOUND") for n, t in texts.items() if not brute(t, ["r", "a", "c"])}
    assert set(codes) == none | {("bad.xml", "XML_PARSE_ERROR"), ("open.xml", "XML_PARSE_ERROR")}


def test_elements_parsed_together_are_as_parsed_alone():
    good = ['<e a="1">x</e>', "<e/>", "<p:e xmlns:p='u'><p:b>2</p:b></p:e>", '<e xmlns="v"><a><b>1</b></a><a/></e>']
    for bad in ("<e>", "</e>", "<e><!--</e>", "--><e/>", "<e/><e/>", "x<e/>", "<e/>y", "<e>&n;</e>", "<q:e/>", "", "<e a=1/>"):
        for raw in ([*good, bad], [bad, None, *good], [good[0], bad, bad, good[1]], ["<e><!--", "--></e>"], ["<e>", "</e>"], ["<e/><e/>", ""]):
            assert xml_source._fields_of_all(raw) == [None if r is None else xml_source.fields_of(r) for r in raw]


def test_runs_of_keys_over_batches():
    rows = [("a", 0, None, "1"), ("a", 0, None, None), ("a", 1, "s", "3"), (None, 1, "s", "4"), (None, 1, "s", "5"), ("b", 1, "s", "6"), ("a", 0, None, "7")]
    for size in (1, 2, 3, 7):
        batches = [pa.RecordBatch.from_pylist([dict(zip("kbsv", r)) for r in rows[i : i + size]], pa.schema([("k", pa.string()), ("b", pa.int64()), ("s", pa.string()), ("v", pa.string())])) for i in range(0, len(rows), size)]
        got = [(k, list(r)) for k, r in splits.runs(iter([batches[0].slice(0, 0), *batches]), ("k", "b"))]
        assert got == [(("a", 0), [(None, "1"), (None, None)]), (("a", 1), [("s", "3")]), ((None, 1), [("s", "4"), ("s", "5")]), (("b", 1), [("s", "6")]), (("a", 0), [(None, "7")])]
        assert [k for k, _ in splits.runs(iter(batches), ("k", "b"))] == [k for k, _ in got]


def test_documents_are_dealt_once_over_all_tasks(spark):
    rows = spark.range(4_000).select(F.lit("s").alias("session_id"), F.concat(F.lit("/logs/part-"), F.col("id") % 4, F.lit(".log")).alias("source_path"), F.col("id").alias("record_number"), F.lit("<e/>").alias("raw_source"))
    docs = queries.documents_of(rows, 7, "<l>", "", "</l>")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and docs.count() == 40
