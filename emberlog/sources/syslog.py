"""Syslog lines by RFC 5424, else by RFC 3164."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import display_timestamp, lookup, nearest_year
from ..plans.ingest import SOURCE, IngestResult, error_when, finish, no_notes
from ..profile import Profile
from .lines import not_blank

# Names of the severities by number, and the canonical labels they stand for.
NAMES = ("Emergency", "Alert", "Critical", "Error", "Warning", "Notice", "Informational", "Debug")
LABELS = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

_QUOTED = r'"(?:[^"\\]|\\.)*+"'
_ELEMENT = rf"\[(?:[^\]\"]|{_QUOTED})*+\]"
MODERN = rf"(?s)^<\d{{1,3}}>((?!0+ )\d{{1,3}}) ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) (-|(?:{_ELEMENT})++)(?: (.*))?$"
CLOCK = r"^(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z"
# Fixed value: what a tag may be made of.
TAG_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"
_PARAM = r' ([^ =\]]+)="((?:[^"\\]|\\.)*+)"'


def priority(line: Column) -> Column:
    """The number in <> that a line starts with, from 0 to 191, else null."""
    return F.nullif(F.regexp_extract(line, r"^<(\d{1,2}|0\d\d|1[0-8]\d|19[01])>", 1), F.lit("")).try_cast("int")


def decode_priority(p: Column) -> dict[str, Column]:
    """facility and severity numbers, the severity's name and its canonical label."""
    s = F.pmod(p, F.lit(8))
    return {"facility": F.floor(p / 8).cast("int"), "code": s, "name": lookup({str(i): n for i, n in enumerate(NAMES)}, s.cast("string")), "label": lookup({str(i): n for i, n in enumerate(LABELS)}, s.cast("string"))}


def _only(text: Column, characters: str) -> Column:
    return (text != "") & (F.translate(text, characters, "") == "")


def header_words(line: Column) -> Column:
    return F.split(F.substr(line, F.instr(line, ">") + 1), r"\s+", 5)


def legacy_header(words: Column) -> Column:
    """month number, day, time, host and rest of a line with a priority, by the words of RFC 3164's header (see header_words); null if they are not there.

    The header is three words of time, of which month, day and clock are each of a known shape, and a host.
    """
    word = lambda i: F.get(words, F.lit(i))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), word(0)).cast("int")
    day = F.when(_only(word(1), "0123456789") & (F.length(word(1)) <= 2), word(1).try_cast("int"))
    clock = F.when(word(2).rlike(CLOCK), word(2))
    known = (month > 0) & day.isNotNull() & clock.isNotNull() & (word(3) != "")
    return F.when(known, F.struct(month.alias("month"), day.alias("day"), clock.alias("clock"), F.concat_ws(" ", word(0), word(1), word(2)).alias("stamp"), word(3).alias("host"), word(4).alias("rest")))


#: What stands before the text of a message: a tag, a process in brackets if there is one, and a colon.
TAGGED = rf"^[{TAG_CHARACTERS}]++(?:\[[^\]]++\])?+:"


def tagged_message(rest: Column, head: Column) -> Column:
    """tag, process (null without one) and text of a message like tag[process]: text, of which head is what TAGGED finds; null for another."""
    name = F.substring_index(F.substring_index(head, "[", 1), ":", 1)
    process = F.substr(head, F.length(name) + 2, F.length(head) - F.length(name) - 3)
    text = F.substr(rest, F.length(head) + 1)
    text = F.when(text.rlike(r"^\s"), F.substr(text, F.lit(2))).otherwise(text)
    return F.when(head != "", F.struct(name.alias("tag"), F.when(F.contains(head, F.lit("[")), process).alias("process"), text.alias("text")))


def structured_elements(text: Column) -> Column:
    """array<struct<id, n, v, formed>> of the elements of structured data: names and values of parameters, and whether the element is well formed."""
    elements = F.regexp_extract_all(text, F.lit(rf"\[((?:[^\]\"]|{_QUOTED})*+)\]"), F.lit(1))
    return F.transform(
        elements,
        lambda e: F.struct(
            F.substring_index(e, " ", 1).alias("id"),
            F.regexp_extract_all(e, F.lit(_PARAM), F.lit(1)).alias("n"),
            F.regexp_extract_all(e, F.lit(_PARAM), F.lit(2)).alias("v"),
            e.rlike(rf"^[^ \]]+(?:{_PARAM})*+$").alias("formed"),
        ),
    )


def structured_data(elements: Column) -> Column:
    """array<struct<k, v, many>> of structured data: k is element.parameter, v its text, or a JSON list if it is repeated.

    Null if an element is not well formed or its id is repeated.
    """
    plain = lambda v: F.when(F.contains(v, F.lit("\\")), F.regexp_replace(v, r'\\(["\\\]])', "$1")).otherwise(v)

    def parameters(e: Column) -> Column:
        pairs = F.arrays_zip(e["n"].alias("n"), e["v"].alias("v"))

        def one(n: Column) -> Column:
            own = F.transform(F.filter(pairs, lambda p: p["n"] == n), lambda p: plain(p["v"]))
            return F.struct(F.concat(e["id"], F.lit("."), n).alias("k"), F.when(F.size(own) > 1, F.to_json(own)).otherwise(F.element_at(own, 1)).alias("v"), (F.size(own) > 1).alias("many"))

        # Parameters are seldom repeated; only then the values of each name are looked for.
        single = F.transform(pairs, lambda p: F.struct(F.concat(e["id"], F.lit("."), p["n"]).alias("k"), plain(p["v"]).alias("v"), F.lit(False).alias("many")))
        return F.when(F.size(F.array_distinct(e["n"])) == F.size(e["n"]), single).otherwise(F.transform(F.array_distinct(e["n"]), one))

    return F.when(F.forall(elements, lambda e: e["formed"]) & (F.size(F.array_distinct(elements["id"])) == F.size(elements)), F.flatten(F.transform(elements, parameters)))


def ingest_syslog(lines: DataFrame, profile: Profile, reference_date: str) -> IngestResult:
    """Syslog records. A line that is no RFC 5424 record is tried as RFC 3164, whose year is that nearest to reference_date (yyyy-MM-dd)."""
    raw = F.col("raw_source")
    some = not_blank(lines).withColumn("_pri", priority(raw))
    # What is used more than once is a column of its own, so that no row makes it twice; and no cast fails, which costs an exception.
    some = some.withColumn("_modern", F.coalesce(F.col("_pri").isNotNull() & raw.rlike(MODERN), F.lit(False)))
    some = some.withColumn("_header", F.when(~F.col("_modern") & F.col("_pri").isNotNull(), header_words(raw)))
    some = some.withColumn("_old", legacy_header(F.col("_header")))
    # Of a modern line: the six words of its header by one split, then structured data, and what is left.
    words = F.split(raw, " ", 7)
    word = lambda i: F.get(F.col("_words"), F.lit(i))
    some = some.withColumn("_words", F.when(F.col("_modern"), words))
    data = F.when(word(6).startswith("-"), F.lit("-")).otherwise(F.regexp_extract(word(6), rf"^(?:{_ELEMENT})++", 0))
    some = some.withColumn("_sd", data)
    rest = F.substr(word(6), F.length("_sd") + 2)
    some = some.withColumn("_date", nearest_year(F.col("_old.month"), F.col("_old.day"), F.lit(reference_date).cast("date")))
    some = some.withColumn("_time", F.try_to_timestamp(F.concat(F.col("_date").cast("string"), F.lit(" "), "_old.clock")))
    some = some.withColumn("_legacy", F.col("_old").isNotNull() & F.col("_time").isNotNull() & F.col("_date").isNotNull())
    error = error_when(
        (F.col("_pri").isNull(), "SYSLOG_RECORD_MALFORMED", "the line does not begin with a valid priority"),
        (~F.col("_modern") & ~F.col("_legacy"), "SYSLOG_RECORD_MALFORMED", "the line is neither an RFC 5424 nor an RFC 3164 record"),
    )
    some = some.withColumns({"error": error, "_rest": F.when(F.col("_legacy"), F.coalesce("_old.rest", F.lit("")))})
    some = some.withColumn("_elements", F.when(F.col("_sd") != "-", structured_elements(F.col("_sd"))))
    some = some.withColumn("_params", structured_data(F.col("_elements")))
    some = some.withColumn("_head", F.regexp_extract("_rest", TAGGED, 0))
    some = some.withColumn("_tagged", tagged_message(F.col("_rest"), F.col("_head")))
    dec = decode_priority(F.col("_pri"))
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    common = [pair("priority", F.col("_pri").cast("string")), pair("facilityCode", dec["facility"].cast("string")), pair("severityCode", dec["code"].cast("string")), pair("syslogSeverity", dec["name"]), pair("level", dec["label"])]
    modern = F.array(
        *common,
        pair("syslogFormat", F.lit("RFC 5424")),
        pair("syslogVersion", F.regexp_extract(word(0), "[0-9]+$", 0).try_cast("int").cast("string")),
        *[pair(k, word(i)) for k, i in (("timestamp", 1), ("hostname", 2), ("subsystem", 3), ("processId", 4), ("eventCode", 5))],
        pair("structuredData", F.col("_sd")),
        pair("message", F.regexp_replace(rest, "^\ufeff", "")),
    )
    legacy = F.array(
        *common,
        pair("syslogFormat", F.lit("RFC 3164")),
        pair("timestamp", display_timestamp(F.col("_time"))),
        pair("timestampOriginal", F.col("_old.stamp")),
        pair("timestampYearInferred", F.lit("true")),
        pair("hostname", F.col("_old.host")),
        pair("subsystem", F.col("_tagged.tag")),
        pair("processId", F.col("_tagged.process")),
        pair("message", F.when(F.col("_tagged").isNotNull(), F.col("_tagged.text")).otherwise(F.col("_rest"))),
    )
    params = F.coalesce(F.transform("_params", lambda p: F.struct(F.concat(F.lit("structuredDataFields."), p["k"]).alias("k"), p["v"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>"))
    present = lambda a: F.filter(a, lambda x: x["v"].isNotNull() & (x["v"] != "") & (x["v"] != "-"))
    fields = F.when(F.col("_modern"), F.map_from_entries(F.concat(present(modern), params))).when(F.col("_legacy"), F.map_from_entries(present(legacy)))
    many = F.transform(F.filter("_params", lambda p: p["many"]), lambda p: F.concat(F.lit("structuredDataFields."), p["k"]))
    none = F.array().cast("array<string>")
    rows = some.withColumns({"fields": fields, "lists": F.coalesce(many, none), "others": F.array(F.lit("priority"), F.lit("facilityCode"), F.lit("severityCode"), F.lit("syslogVersion"), F.lit("timestampYearInferred")), "notes": no_notes()})
    inferred = rows.groupBy(*SOURCE).agg(F.bool_or("_legacy").alias("_any")).where("_any")
    sources = inferred.select(*SOURCE, F.lit("SYSLOG_LEGACY_TIMESTAMP_INFERRED").alias("code"), F.lit(f"years were inferred as those nearest to {reference_date}").alias("message"), F.lit("Information").alias("severity"))
    return finish(rows, profile, sources)
