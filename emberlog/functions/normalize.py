"""Severity, timestamps, identities and display texts, as native column expressions.

Times without a zone are read in the session's zone; the jobs set it to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: In ascending order; the position is the rank.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "CRITICAL")
#: Spellings read besides the labels themselves.
SPELLINGS = {"INFORMATION": "INFO", "WARNING": "WARN", "FATAL": "CRITICAL"}
ISSUES = ("WARN", "ERROR", "CRITICAL")
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|z|[+-]\d{2}:?\d{2})?)?$"
ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
#: Format letters of profiles and what they are here; longer ones first.
QT_LETTERS = (("zzz", "SSS"), ("tt", "Z"), ("AP", "a"), ("ap", "a"), ("dddd", "EEEE"), ("ddd", "EEE"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def lookup(pairs: dict[str, str], key: Column) -> Column:
    """The value of key in a small fixed dictionary, else null."""
    out = F.lit(None).cast("string")
    if not pairs:
        return out
    items = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*items), key)


def parse_severity(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """The canonical label of a severity text, else null; a profile's aliases come first, in any case."""
    own = {k.strip().lower(): v for k, v in (aliases or {}).items()}
    usual = {s: s for s in SEVERITIES} | SPELLINGS
    # Usual spellings are found as they stand, without the cost of upper and lower case of any language.
    known = {spelt: own.get(s.lower(), usual.get(s)) for s in {*usual, *(k.upper() for k in own if k.isascii())} for spelt in (s, s.lower(), s.capitalize())}
    return F.coalesce(lookup(known, F.trim(text)), lookup(own, F.lower(F.trim(text))), lookup(usual, F.upper(F.trim(text))))


def severity_rank(label: Column) -> Column:
    """0 for TRACE to 5 for CRITICAL; null for anything else."""
    return lookup({s: str(i) for i, s in enumerate(SEVERITIES)}, label).cast("int")


def parse_iso(text: Column) -> Column:
    """An ISO 8601 date and time, with or without fraction and zone; null for any other shape."""
    t = F.trim(text)
    shaped = F.when(F.contains(t, F.lit(" ")) | F.contains(t, F.lit(",")), F.regexp_replace(F.regexp_replace(t, r"^(.{10})[ ]", "$1T"), ",", ".")).otherwise(t)
    return F.when(t.rlike(ISO_SHAPE), F.try_to_timestamp(shaped))


def qt_pattern(fmt: str) -> str:
    """A profile's time format in the letters of Spark's patterns."""
    out, i, quoted = "", 0, False
    while i < len(fmt):
        if fmt[i] == "'":
            quoted = not quoted
        hit = None if quoted else next((x for x in QT_LETTERS if fmt.startswith(x[0], i)), None)
        if hit:
            out, i = out + hit[1], i + len(hit[0])
        else:
            literal = not quoted and fmt[i].isalpha() and fmt[i] not in "yMdHhmsz"
            out, i = out + (f"'{fmt[i]}'" if literal else "S" if fmt[i] == "z" and not quoted else fmt[i]), i + 1
    return out


def parse_timestamp(text: Column, rules: tuple[str, ...] = ("iso8601",)) -> Column:
    """The first rule that reads the text wins; a rule is iso8601 or a time format."""
    made = [parse_iso(text) if r == "iso8601" else F.try_to_timestamp(F.trim(text), F.lit(qt_pattern(r))) for r in rules]
    return F.coalesce(*made) if made else F.lit(None).cast("timestamp")


def display_timestamp(ts: Column) -> Column:
    return F.date_format(ts, ISO_MS)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def floor_ms(ms: Column, interval: int | Column) -> Column:
    """The start of the bucket that ms falls in, also before 1970."""
    iv = F.lit(interval).cast("long") if isinstance(interval, int) else interval
    return ms - F.pmod(ms, iv)


def clean_path(path: Column) -> Column:
    """A trimmed path with forward slashes, without . and .. segments and repeated slashes."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda s, x: F.when((x == "..") & (F.size(s) > 0) & (F.try_element_at(s, F.lit(-1)) != ".."), F.slice(s, 1, F.size(s) - 1))
        .when((x == "..") & p.startswith("/"), s)
        .otherwise(F.array_append(s, x)),
    )
    return F.concat(F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(stack, "/"))


def _sized(text: Column) -> Column:
    raw = F.encode(text, "UTF-16BE")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 8, "0")), raw)


def record_id(path: Column, name: Column, number: Column, raw: Column) -> Column:
    """SHA-256 over path (name if blank), record number and raw text.

    Texts are UTF-16BE after their length in bytes as 32 bits, the number is 64 bits, all
    big-endian.
    """
    of = F.coalesce(F.nullif(clean_path(F.coalesce(path, F.lit(""))), F.lit("")), name, F.lit(""))
    return F.sha2(F.concat(_sized(of), F.unhex(F.lpad(F.hex(number.cast("long")), 16, "0")), _sized(F.coalesce(raw, F.lit("")))), 256)


def nearest_year(month: Column, day: Column, reference: Column) -> Column:
    """The date with that month and day nearest to the reference date; of two, the earlier; null if no year has it."""
    def choice(shift: int) -> Column:
        year = F.year(reference) + shift
        # Looked up, not parsed: a date that does not exist costs an exception there.
        last = F.when(month.between(1, 12) & year.between(1, 9999), F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1)))))
        date = F.when(day.between(1, last), F.make_date(year, month, day))
        return F.when(date.isNotNull(), F.struct(F.abs(F.datediff(date, reference)).alias("far"), date.alias("date")))

    return F.array_min(F.array(*map(choice, (-1, 0, 1))))["date"]
