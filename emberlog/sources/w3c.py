"""W3C extended logs, whose #Fields directives name the fields of the lines that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ingest import SOURCE, IngestResult, error_when, finish, no_notes
from ..profile import Profile
from .lines import not_blank

#: Directives, one short row each, up to which they are broadcast: in all, and of one source, since a line meets all of its source.
MOST_DIRECTIVES, MOST_OF_SOURCE = 100_000, 64
#: Lines that are ordered together where directives are many.
BLOCK = 65_536


def _is_fields() -> Column:
    return F.trim("raw_source").startswith("#Fields:")


def _names() -> Column:
    given = F.trim(F.substr(F.trim("raw_source"), F.lit(9)))
    return F.when(given == "", F.array().cast("array<string>")).otherwise(F.split(given, r"\s+"))


def last_directives(lines: DataFrame) -> DataFrame:
    """(SOURCE, names): the fields of the last directive of each source that has one; none if it names no fields."""
    return lines.where(_is_fields()).groupBy(*SOURCE).agg(F.max_by(_names(), "record_number").alias("names"))


def carried_directives(some: DataFrame, before: DataFrame) -> DataFrame:
    """some with _names, the directive that is active at each line, for any number of directives.

    Lines are ordered in blocks of BLOCK line numbers, so no task orders a source. What is
    active where a block begins comes from the last directives of the blocks before it,
    one row for each block.
    """
    block = F.floor(F.col("record_number") / BLOCK).alias("_block")
    ends = some.groupBy(*SOURCE, block).agg(F.max_by(_names(), F.when(_is_fields(), F.col("record_number"))).alias("_last"))
    ends = ends.unionByName(before.select(*SOURCE, F.lit(-1).cast("long").alias("_block"), F.col("names").alias("_last")))
    earlier = Window.partitionBy(*SOURCE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.withColumn("_begin", F.last("_last", ignorenulls=True).over(earlier)).where("_begin is not null").select(*SOURCE, "_block", "_begin")
    order = Window.partitionBy(*SOURCE, "_block").orderBy("record_number").rowsBetween(Window.unboundedPreceding, 0)
    own = some.withColumn("_block", block).withColumn("_own", F.last(F.when(_is_fields(), _names()), ignorenulls=True).over(order))
    return own.join(begins, [*SOURCE, "_block"], "left").withColumn("_names", F.coalesce("_own", "_begin")).drop("_own", "_begin", "_block")


def ingest_w3c(lines: DataFrame, profile: Profile, few_directives: bool | None = None, before: DataFrame | None = None) -> IngestResult:
    """Records under the directive that is active at their line; it may change within a source.

    Directives become intervals of lines. If there are few, in all and of each source (they
    are counted at this call if few_directives is None), lines join them by range, in
    place. Otherwise the active one is carried forward through blocks of lines.
    before(SOURCE, names) tells what is active where a source's lines begin, if they
    go on from others.
    """
    if before is None:
        before = lines.select(*SOURCE, F.array().cast("array<string>").alias("names")).limit(0)
    some = not_blank(lines).withColumn("_line", F.trim("raw_source"))
    directives = some.where(_is_fields()).select(*SOURCE, "record_number", _names().alias("_names"))
    # A directive without fields is a note on its line, and ends the one before it.
    empty = directives.where("size(_names) = 0").select(*SOURCE, "record_number", F.lit("IIS_W3C_FIELDS_EMPTY").alias("code"), F.lit("a directive names no fields").alias("message"), F.lit("Error").alias("severity"))
    data = some.where(~F.col("_line").startswith("#"))
    known = directives.unionByName(before.select(*SOURCE, F.lit(0).cast("long").alias("record_number"), F.col("names").alias("_names")))
    if few_directives is None:
        counted = known.groupBy(*SOURCE).count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
        few_directives = (counted["all"] or 0) <= MOST_DIRECTIVES and (counted["most"] or 0) <= MOST_OF_SOURCE
    if few_directives:
        until = F.lead("record_number").over(Window.partitionBy(*SOURCE).orderBy("record_number"))
        spans = known.select(*[F.col(c).alias(f"_d_{c}") for c in SOURCE], F.col("record_number").alias("_from"), F.coalesce(until, F.lit(2**62)).alias("_to"), "_names")
        on = [data[c] == spans[f"_d_{c}"] for c in SOURCE] + [data["record_number"] > spans["_from"], data["record_number"] < spans["_to"]]
        rows = data.join(F.broadcast(spans), on, "left")
    else:
        rows = carried_directives(some, before).where(~F.col("_line").startswith("#"))
    rows = rows.withColumn("_values", F.split("_line", r"\s+"))
    counts = F.concat(F.size("_values").cast("string"), F.lit(" values under a directive of "), F.size("_names").cast("string"), F.lit(" fields"))
    error = error_when(
        (F.col("_names").isNull() | (F.size("_names") == 0), "IIS_W3C_FIELDS_REQUIRED", "no directive is active at the line"),
        (F.size("_values") != F.size("_names"), "IIS_W3C_FIELD_COUNT_MISMATCH", counts),
    )
    rows = rows.withColumn("error", error).withColumn("_f", F.when(F.col("error").isNull(), F.map_filter(F.map_from_arrays("_names", "_values"), lambda _, v: v != "-")))
    get = lambda k: F.try_element_at("_f", F.lit(k))
    target = F.concat_ws("?", get("cs-uri-stem"), get("cs-uri-query"))
    made = F.array(
        F.struct(F.lit("timestamp").alias("k"), F.concat(get("date"), F.lit("T"), get("time"), F.lit("Z")).alias("v")),
        F.struct(F.lit("message").alias("k"), F.nullif(F.concat_ws(" ", get("cs-method"), F.nullif(target, F.lit(""))), F.lit("")).alias("v")),
    )
    own = F.map_from_entries(F.filter(made, lambda x: x["v"].isNotNull()))
    fields = F.map_concat(F.map_filter("_f", lambda k, _: ~k.isin("date", "time")), own)
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"fields": fields, "lists": none, "others": none, "notes": no_notes()})
    out = finish(rows, profile)

    def stats() -> DataFrame:
        bad = empty.select(*SOURCE).distinct().withColumn("_e", F.lit(True))
        return out.stats.join(bad, list(SOURCE), "left").withColumn("has_errors", F.col("has_errors") | F.coalesce("_e", F.lit(False))).drop("_e")

    return IngestResult(out.records, lambda: out.diagnostics.unionByName(empty), stats)
