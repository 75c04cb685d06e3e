"""Delimited text, lines that a pattern describes, and key-value lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import lookup
from ..plans.ingest import SOURCE, IngestResult, error_when, finish, no_notes, note
from ..profile import Profile, java_to_python, problems
from ..session import stored
from .lines import MOST_SPLITS, not_blank


def _with_text_columns(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.withColumns({"lists": none, "others": none})


def split_delimited(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line is well formed, and its fields. A quote may only open a field, "" stands for one inside, nothing may follow its end."""
    d = re.escape(delimiter)
    field = rf'(?:"(?:[^"]|"")*+"|[^"{d}]++|)'
    # Each match is a delimiter and a field, so the line gets one in front. What no match covers is not well formed.
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf"{d}({field})"), F.lit(1))
    plain = F.transform(found, lambda f: F.when(f.startswith('"'), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    # A line without a quote is well formed, and cut at its delimiters; the pattern is for the others.
    quoted = F.contains(line, F.lit('"'))
    return ~quoted | (F.array_join(found, delimiter) == line), F.when(quoted, plain).otherwise(F.split(line, d, -1))


def ingest_delimited(lines: DataFrame, profile: Profile, delimiter: str | None = None) -> IngestResult:
    """Rows under a header: each source's first line that is not blank. A bad header rejects the source.

    Sources without any such line have DELIMITED_HEADER_REQUIRED; sources without any
    line at all are not in lines and so not known here. The headers are found by a job
    that runs at this call: one row for each source, stored in the shared folder.
    """
    delimiter = delimiter or ("\t" if profile.format_id == "tsv" else ",")
    some = not_blank(lines)
    number = F.when(F.col("raw_source").rlike(r"\S"), F.col("record_number"))
    head = lines.groupBy(*SOURCE).agg(F.min_by("raw_source", number).alias("_head"), F.min(number).alias("_head_no"))
    head_ok, head_fields = split_delimited(F.regexp_replace("_head", "^\ufeff", ""), delimiter)
    head = head.withColumns({"_head_ok": head_ok, "_names": F.transform(head_fields, lambda n: F.trim(n))})
    head = head.withColumn(
        "_head_error",
        error_when(
            (F.col("_head").isNull(), "DELIMITED_HEADER_REQUIRED", "the source has no header"),
            (~F.col("_head_ok"), "MALFORMED_DELIMITED_HEADER", "the header is not well formed"),
            (F.exists("_names", lambda n: n == ""), "EMPTY_DELIMITED_HEADER", "a header name is empty"),
            (F.size(F.array_distinct(F.transform("_names", F.lower))) < F.size("_names"), "DUPLICATE_DELIMITED_HEADER", "a header name is repeated"),
        ),
    )
    head = stored(head.select(*SOURCE, "_head_no", "_names", "_head_error"), "headers")
    few = head.count() <= MOST_SPLITS
    sources = head.where("_head_error is not null").select(*SOURCE, F.col("_head_error.code").alias("code"), F.col("_head_error.message").alias("message"), F.lit("Error").alias("severity"))
    good = head.where("_head_error is null").select(*[F.col(c).alias(f"_h_{c}") for c in SOURCE], "_head_no", "_names")
    rows = some.join(F.broadcast(good) if few else good, [some[c] == good[f"_h_{c}"] for c in SOURCE]).where("record_number > _head_no")
    valid, fields = split_delimited(F.col("raw_source"), delimiter)
    rows = rows.withColumns({"_ok": valid, "_fields": fields})
    counts = F.concat(F.size("_fields").cast("string"), F.lit(" columns under a header of "), F.size("_names").cast("string"))
    error = error_when((~F.col("_ok"), "MALFORMED_DELIMITED_RECORD", "the row is not well formed"), (F.size("_fields") != F.size("_names"), "DELIMITED_COLUMN_COUNT_MISMATCH", counts))
    rows = rows.withColumns({"error": error, "notes": no_notes()}).withColumn("fields", F.when(F.col("error").isNull(), F.map_from_arrays("_names", "_fields")))
    return finish(_with_text_columns(rows), profile, sources)


def capture_names(pattern: str) -> list[tuple[str, int]]:
    """Named captures of a pattern and their numbers."""
    return sorted(re.compile(java_to_python(pattern)).groupindex.items(), key=lambda x: x[1])


def ingest_regex(lines: DataFrame, profile: Profile) -> IngestResult:
    """Lines that profile.pattern describes as a whole; each named capture is a field.

    A capture that took no part gives no field, one that is empty gives an empty text. A
    bad pattern raises ValueError before anything runs.
    """
    if found := problems(profile):
        raise ValueError("; ".join(found))
    names = capture_names(profile.pattern)
    # Names may have letters that Java's patterns do not take; numbers serve here.
    bare = re.sub(r"\(\?P?<(?![=!])[^>]+>", "(", profile.pattern)
    whole = rf"^(?:{bare})$"
    some = not_blank(lines)
    error = error_when((~F.col("raw_source").rlike(whole), "REGEX_RECORD_NO_MATCH", "the line does not match the pattern"))

    def capture(i: int) -> Column:
        """Behind the match a reference to an empty capture matches, one to a capture that took no part does not."""
        found = F.regexp_extract("raw_source", whole, i)
        return F.when((found != "") | F.col("raw_source").rlike(rf"(?>{whole})\{i}"), found)

    pairs = F.array(*[F.struct(F.lit(n).alias("k"), capture(i).alias("v")) for n, i in names])
    fields = F.when(F.col("error").isNull(), F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull())))
    return finish(_with_text_columns(some.withColumns({"error": error, "notes": no_notes()}).withColumn("fields", fields)), profile)


PAIR = r'([^=\s]++)=("(?:[^"\\]|\\.)*+"(?=\s|$)|(?!")\S*+)'
KEY_VALUE_LINE = rf"^\s*+(?:{PAIR}(?:\s++|$))++$"


def unescape(text: Column) -> Column:
    """\\" \\\\ \\n \\r \\t as what they stand for; other escapes stay as they are."""
    stands_for = {'\\"': '"', "\\\\": "\\", "\\n": "\n", "\\r": "\r", "\\t": "\t"}
    parts = F.regexp_extract_all(text, F.lit(r"(?s)[^\\]++|\\.|\\"), F.lit(0))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, lambda p: F.coalesce(lookup(stands_for, p), p)), "")).otherwise(text)


def ingest_key_value(lines: DataFrame, profile: Profile) -> IngestResult:
    """key=value and key="value" fields. The last of repeated keys wins, with a warning; any other token rejects the line."""
    some = not_blank(lines)
    valid = F.col("raw_source").rlike(KEY_VALUE_LINE)
    keys = F.regexp_extract_all("raw_source", F.lit(PAIR), F.lit(1))
    values = F.regexp_extract_all("raw_source", F.lit(PAIR), F.lit(2))
    some = some.withColumns({"_ok": valid, "_keys": keys, "_values": values})
    error = error_when((~F.col("_ok"), "KEY_VALUE_RECORD_MALFORMED", "the line is not a list of key=value fields"))
    plain = F.transform("_values", lambda v: F.when(v.startswith('"'), unescape(F.substr(v, F.lit(2), F.length(v) - 2))).otherwise(v))
    twice = F.filter(F.array_distinct("_keys"), lambda k: F.size(F.filter("_keys", lambda x: x == k)) > 1)
    notes = F.when(F.size("_keys") > F.size(F.array_distinct("_keys")), F.transform(twice, lambda k: note("KEY_VALUE_DUPLICATE_KEY", F.concat(F.lit("the last value of a repeated key counts: "), k)))).otherwise(no_notes())
    rows = some.withColumn("error", error).withColumns({"notes": F.when(F.col("error").isNull(), notes).otherwise(no_notes()), "fields": F.when(F.col("error").isNull(), F.map_from_arrays("_keys", plain))})
    return finish(_with_text_columns(rows), profile)
