"""Personal data by patterns, validators and context, in DataFrame functions only.

A pattern of each kind proposes spans, a validator (part ranges, digit counts, Luhn,
mod-97) confirms them, and words shortly before a span raise its score. Spans are in
code points, end exclusive.

The patterns may not start inside a run that an earlier start would have covered: the
look-behinds change no match and keep long runs without a match linear. Possessive
quantifiers stand where giving back could not help. Running positions are kept in blocks,
and masking takes text from pieces of bounded size, so that the time of a text with very
many spans is in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

#: Characters before a span in which context words count.
CONTEXT = 40
#: Elements of an array that grow together, characters of a piece of text that is masked, and earlier matches that may fill the context.
BLOCK, PIECE, EARLIER = 256, 1_024, 20


@dataclass(frozen=True)
class Kind:
    """pattern (Java), words that raise the score, the score without them and the score from which a span counts."""

    name: str
    pattern: str
    context: str
    score: float
    least: float = 0.0
    #: A string or pattern that each text with a match must have; spares the others the pattern.
    needs: str = ""


EMAIL, IP, CARD, PHONE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "mail|contact|write", 0.9, needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip|address|host|server", 0.6, needs="."),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", "card|visa|credit|pay", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "phone|tel|call|mobile|fax", 0.7, needs="+"),
)
BASE = (EMAIL, IP, CARD, PHONE)
IBAN = Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "iban|account|bank", 0.8)
SSN = Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social|security", 0.3, 0.5, needs="-")
#: In the order of listing.
KINDS = (*BASE, IBAN, SSN)


def _part(octet: str) -> str:
    return octet + r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def mod97(text: Column) -> Column:
    """Whether an account number without spaces leaves 1 in ISO 7064 mod 97-10."""
    moved = F.concat(F.substr(text, F.lit(5)), F.substring(text, 1, 4))
    value = lambda c: (F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)).cast("long")
    step = lambda r, c: F.pmod(r * F.when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(100)) + value(c), F.lit(97)).cast("long")
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0).cast("long"), step) == 1


def confirmed(kind: Kind, found: Column) -> Column:
    """Whether the validator of the kind accepts a matched string."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind is IP:
        return found.rlike("^" + _part("") + _part(r"\.") * 3 + "$")
    if kind is CARD:
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind is PHONE:
        return F.length(digits).between(10, 15)
    if kind is IBAN:
        return mod97(F.replace(found, F.lit(" "), F.lit("")))
    return F.lit(True)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op, a sum or a maximum, makes of the values before each one, from 0.

    An aggregation copies its state at each step, so an array in it must stay short:
    each block has its own, which starts from what the blocks before it make.
    """
    zero = F.lit(0).cast("bigint")

    def inner(values: Column, start: Column) -> Column:
        state = F.struct(start.alias("c"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(values, state, lambda s, x: F.struct(op(s["c"], x).alias("c"), F.array_append(s["o"], s["c"]).alias("o")), lambda s: s["o"])

    def whole(blocks: Column) -> Column:
        starts = inner(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda c, x: op(c, x))), zero)
        return F.flatten(F.zip_with(blocks, starts, inner))

    numbers = lambda v: F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / BLOCK).cast("int"))
    return bound(values, lambda v: bound(F.transform(numbers(v), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))), whole))


SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string,found:string,score:double>"


def _spans(text: Column, kind: Kind, no: int) -> Column:
    """Confirmed spans of one kind, by start, as an array of SPAN.

    split() gives what lies between the matches that regexp_extract_all() gives, so
    that running sums of both lengths are the positions.
    """
    pattern = F.lit(kind.pattern)
    pairs = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda gap, found: F.struct(F.length(gap).cast("bigint").alias("gap"), F.right(gap, F.lit(CONTEXT)).alias("before"), found.alias("found")),
    )

    def spans(pairs: Column, starts: Column) -> Column:
        def before(x: Column, i: Column) -> Column:
            """The CONTEXT characters before a match; earlier matches, of 2 characters at least, are among them where its gap is short."""
            some = F.slice(pairs, F.greatest(i + 1 - EARLIER, F.lit(1)), F.least(i, F.lit(EARLIER)))
            return F.when(x["gap"] >= CONTEXT, x["before"]).otherwise(F.right(F.concat(F.array_join(F.transform(some, lambda y: F.concat(y["before"], y["found"])), ""), x["before"]), F.lit(CONTEXT)))

        def span(x: Column, i: Column) -> Column:
            begin = F.get(starts, i) + x["gap"]
            score = F.when(F.lower(before(x, i)).rlike(kind.context), F.least(F.lit(1.0), F.lit(kind.score + 0.25))).otherwise(F.lit(kind.score))
            made = F.struct(begin.alias("start"), F.lit(no).alias("kind_no"), (begin + F.length(x["found"])).alias("end"), F.lit(kind.name).alias("kind"), x["found"].alias("found"), score.alias("score"))
            return F.when(x["found"].isNotNull() & confirmed(kind, x["found"]), made)

        return F.transform(pairs, span)

    ends = lambda p: F.transform(p, lambda x: x["gap"] + F.coalesce(F.length(x["found"]), F.lit(0)))
    made = bound(pairs, lambda p: bound(running(ends(p), lambda a, b: a + b), lambda starts: spans(p, starts)))
    found = F.filter(made, lambda x: x.isNotNull() & (x["score"] >= kind.least))
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(F.array().cast(f"array<{SPAN}>")) if kind.needs else found


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds out_col: array of SPAN, by start, then by kind as listed.

    Base kinds keep every confirmed match, whatever its score; the others count from
    their least score on. Kinds may overlap each other. A null text has no spans. All
    columns and rows are kept; an existing out_col is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(out_col, F.array_sort(F.flatten(F.array(*[_spans(text, k, i) for i, k in enumerate(kinds)]))))


def mask_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every span of text_col replaced by its kind in square brackets.

    Spans that overlap are replaced as one, named by the first. A null text stays null;
    a text without spans stays as it is.
    """
    name = free_name(docs, "_pii_spans")
    text = F.col(text_col)

    def masked(spans: Column) -> Column:
        # Beside each span, how far those before it reach.
        reach = running(F.transform(spans, lambda x: x["end"]), F.greatest)
        marked = F.zip_with(spans, reach, lambda x, r: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), r.alias("reach")))
        last = F.aggregate(spans, F.lit(0).cast("bigint"), lambda r, x: F.greatest(r, x["end"]))
        # What reaches up to the next group's first span is the end of a group.
        return bound(last, lambda end: bound(F.filter(marked, lambda x: x["start"] >= x["reach"]), lambda firsts: bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: joined(firsts, end, pieces))))

    def joined(firsts: Column, end: Column, pieces: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(some, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

        parts = F.transform(firsts, lambda x: F.concat(between(x["reach"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), between(end, F.length(text).cast("bigint")))

    return find_pii(docs, text_col, name, kinds).withColumn(text_col, F.when(F.size(name) > 0, bound(F.col(name), masked)).otherwise(text)).drop(name)


def _is(kind: Kind):
    return lambda x: x["kind"] == kind.name


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of every document, counted by kind and in all, and digested."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k.name}") for k in KINDS]
    base = F.filter("pii", lambda x: x["kind_no"] < len(BASE))
    own, more = counts[: len(BASE)], counts[len(BASE) :]
    return found.select("doc_id", *own, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("pii")).alias("spans"), *more, F.size("pii").cast("long").alias("n_spans"))
