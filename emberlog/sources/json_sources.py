"""JSON Lines and whole JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ingest import SOURCE, IngestResult, error_when, finish, no_notes
from ..profile import Profile
from .lines import not_blank


def as_object(v: Column) -> Column:
    """The members of a variant that is an object, else null."""
    return v.try_cast("map<string,variant>")


def _members(m: Column, prefix: Column | None = None) -> Column:
    return F.transform(F.map_entries(m), lambda e: F.struct((F.concat(prefix, F.lit("."), e["key"]) if prefix is not None else e["key"]).alias("k"), e["value"].alias("v")))


def braces(text: Column) -> Column:
    """How many { there are in a text: no value in it lies in more objects."""
    return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))


def flat_members(v: Column, text: Column) -> Column:
    """Members of an object as (dotted name, value); objects in it give their own members, at any depth, lists stay.

    No object is deeper than its text has opening braces; an object without others takes no step.
    """

    def deeper(members: Column) -> Column:
        return F.flatten(F.transform(members, lambda e: F.coalesce(_members(as_object(e["v"]), e["k"]), F.array(e))))

    def step(members: Column, _: Column) -> Column:
        return F.when(F.exists(members, lambda e: as_object(e["v"]).isNotNull()), deeper(members)).otherwise(members)

    first = _members(as_object(v))
    return F.when(braces(text) < 2, first).otherwise(F.aggregate(F.sequence(F.lit(2), braces(text)), deeper(first), step))


def with_fields(df: DataFrame, value: str, profile: Profile) -> DataFrame:
    """Adds fields, lists and others for a variant column that holds objects."""
    text_paths = [x for p in profile.canonical.values() if p.strip() for x in (p.strip(), p.strip() + ".#text")]
    members = df.withColumn("_members", flat_members(F.col(value), F.col("raw_source")))
    is_list = lambda v: v.try_cast("array<variant>").isNotNull() | as_object(v).isNotNull()
    out = members.withColumns(
        {
            "fields": F.map_from_entries(F.transform("_members", lambda e: F.struct(e["k"].alias("key"), e["v"].cast("string").alias("value")))),
            "lists": F.transform(F.filter("_members", lambda e: is_list(e["v"])), lambda e: e["k"]),
            "others": F.transform(F.filter("_members", lambda e: e["k"].isin(text_paths) & (F.schema_of_variant(e["v"]) != "STRING")), lambda e: e["k"]),
        }
    ).drop("_members")
    # A custom path that names an object gets it whole.
    for p in {p.strip() for p in profile.custom.values()}:
        # An object there lies in as many others as the path has steps; few texts have that many braces.
        whole = F.when(braces(F.col("raw_source")) > len(p.split(".")), F.try_variant_get(F.col(value), "".join(f"[\"{s}\"]" for s in p.split(".")).join(["$", ""]), "variant"))
        odd = as_object(whole).isNotNull()
        out = out.withColumns(
            {
                "fields": F.when(odd, F.map_concat("fields", F.create_map(F.lit(p), whole.cast("string")))).otherwise(F.col("fields")),
                "lists": F.when(odd, F.array_append("lists", F.lit(p))).otherwise(F.col("lists")),
            }
        )
    return out


def ingest_json_lines(lines: DataFrame, profile: Profile) -> IngestResult:
    """One object a line. Bad JSON and values that are no objects are errors; both count as processed."""
    parsed = not_blank(lines).withColumn("_v", F.try_parse_json("raw_source"))
    error = error_when(
        (F.col("_v").isNull(), "MALFORMED_JSON", "the line is not valid JSON"),
        (as_object(F.col("_v")).isNull(), "JSON_VALUE_NOT_OBJECT", "the line is not a JSON object"),
    )
    return finish(with_fields(parsed.withColumns({"error": error, "notes": no_notes()}), "_v", profile), profile)


def ingest_json_documents(documents: DataFrame, profile: Profile) -> IngestResult:
    """Records of whole documents: the elements of a list, or an object, at the root or at profile.record_path.

    Elements that are no objects are errors but count. raw_source is the element as
    compact JSON; numbers count elements from 1.
    """
    path = profile.record_path.strip()
    docs = documents.withColumn("_root", F.try_parse_json("document"))
    at = F.try_variant_get(F.col("_root"), "$" + "".join(f'["{s}"]' for s in path.split(".")), "variant") if path else F.col("_root")
    docs = docs.withColumn("_at", at)
    root_object, list_at, object_at = as_object(F.col("_root")).isNotNull(), F.col("_at").try_cast("array<variant>"), as_object(F.col("_at")).isNotNull()
    cases = [(F.col("_root").isNull(), "MALFORMED_JSON_DOCUMENT", "the document is not valid JSON")]
    if path:
        cases += [
            (~root_object, "JSON_RECORD_PATH_REQUIRES_OBJECT_ROOT", "a record path needs an object at the root"),
            (F.col("_at").isNull(), "JSON_RECORD_PATH_NOT_FOUND", f"nothing at the record path {path}"),
            (list_at.isNull() & ~object_at, "JSON_RECORD_PATH_NOT_CONTAINER", f"neither object nor list at the record path {path}"),
        ]
    else:
        cases.append((list_at.isNull() & ~object_at, "STRUCTURED_JSON_ROOT_UNSUPPORTED", "the root is neither object nor list"))
    docs = docs.withColumn("_source_error", error_when(*cases))
    sources = docs.where("_source_error is not null").select(*SOURCE, F.col("_source_error.code").alias("code"), F.col("_source_error.message").alias("message"), F.lit("Error").alias("severity"))
    elements = docs.where("_source_error is null").select(*SOURCE, F.posexplode(F.coalesce(list_at, F.array("_at"))).alias("_pos", "_v"))
    parsed = elements.withColumns(
        {
            "record_number": (F.col("_pos") + 1).cast("long"),
            "raw_source": F.col("_v").cast("string"),
            "error": error_when((as_object(F.col("_v")).isNull(), "STRUCTURED_JSON_RECORD_NOT_OBJECT", "the element is not an object")),
            "notes": no_notes(),
        }
    )
    return finish(with_fields(parsed, "_v", profile), profile, sources)


