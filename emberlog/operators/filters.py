"""Filter criteria as one predicate, as flags, and as presets over many sessions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Presets that one pass counts; each adds a counter, not a copy of the records.
MOST_PRESETS = 500


def tidy(values: Iterable[str], upper: bool = False) -> tuple[str, ...]:
    """Trimmed values without blanks and repeats, in order."""
    cleaned = (v.strip().upper() if upper else v.strip() for v in values)
    return tuple(dict.fromkeys(v for v in cleaned if v))


@dataclass(frozen=True)
class Criteria:
    """Unset criteria accept everything; set ones all have to hold. Times are texts such as 2024-01-31T10:00:00Z."""

    severities: tuple[str, ...] = ()
    subsystems: tuple[str, ...] = ()
    event_codes: tuple[str, ...] = ()
    entity_ids: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)
    search: str = ""
    statuses: tuple[str, ...] = ()
    bookmarked_only: bool = False

    def clean(self) -> Criteria:
        fields = {k.strip(): tidy(v) for k, v in self.fields.items()}
        return replace(self, severities=tidy(self.severities, True), subsystems=tidy(self.subsystems), event_codes=tidy(self.event_codes), entity_ids=tidy(self.entity_ids), fields={k: v for k, v in fields.items() if k and v}, search=self.search.strip(), statuses=tuple(s for s in tidy(self.statuses) if s != "None"))


def attribute_text(name: str) -> Column:
    """An attribute as text for comparison: lists and objects are empty, a missing one is null."""
    return F.when(F.array_contains("structured", name), F.when(F.map_contains_key(F.col("attributes"), F.lit(name)), F.lit(""))).otherwise(F.try_element_at("attributes", F.lit(name)))


def search_matches(query: str) -> Column:
    """Whether the lower-cased query is part of any text of the record; the raw source is looked at first."""
    q = F.lit(query.strip().lower())
    has = lambda c: F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    texts = [F.col(c) for c in ("raw_source", "message", "subsystem", "event_code", "entity_id", "severity", "event_ts_text")]
    own = F.exists(F.map_entries("attributes"), lambda e: ~F.array_contains(F.col("structured"), e["key"]) & has(e["value"]))
    return reduce(lambda a, b: a | b, [has(c) for c in texts]) | F.coalesce(own, F.lit(False))


FLAGS = ("severity_match", "subsystem_match", "event_code_match", "entity_match", "time_match", "field_match", "search_match", "status_match", "bookmark_match")


def conditions(criteria: Criteria) -> dict[str, Column | None]:
    """For each of FLAGS a condition that may be null where a value is, None where the criterion is not set.

    status_match and bookmark_match need the columns status and bookmarked.
    """
    c = criteria.clean()
    among = lambda col, values: F.col(col).isin(list(values)) if values else None
    bounds = [F.col("event_ts") >= F.to_timestamp(F.lit(c.start))] if c.start else []
    bounds += [F.col("event_ts") <= F.to_timestamp(F.lit(c.end))] if c.end else []
    fields = [attribute_text(k).isin(list(v)) for k, v in c.fields.items()]
    both = lambda ps: reduce(lambda a, b: a & b, ps) if ps else None
    return {
        "severity_match": among("severity", c.severities),
        "subsystem_match": among("subsystem", c.subsystems),
        "event_code_match": among("event_code", c.event_codes),
        "entity_match": among("entity_id", c.entity_ids),
        "time_match": both(bounds),
        "field_match": both(fields),
        "search_match": search_matches(c.search) if c.search else None,
        "status_match": among("status", c.statuses),
        "bookmark_match": F.col("bookmarked") if c.bookmarked_only else None,
    }


def flags(criteria: Criteria) -> dict[str, Column | None]:
    """conditions, true or false."""
    return {k: None if p is None else F.coalesce(p, F.lit(False)) for k, p in conditions(criteria).items()}


def predicate(criteria: Criteria) -> Column:
    """All criteria that are set, as one condition to filter by (it may be null); plain comparisons reach the scan."""
    own = [p for p in conditions(criteria).values() if p is not None]
    return reduce(lambda a, b: a & b, own) if own else F.lit(True)


def filter_records(records: DataFrame, criteria: Criteria) -> DataFrame:
    return records.where(predicate(criteria))


def match_flags(records: DataFrame, criteria: Criteria) -> DataFrame:
    """records with the nine FLAGS and all_match: why a record is hidden."""
    own = {k: F.lit(True) if p is None else p for k, p in flags(criteria).items()}
    return records.withColumns(own).withColumn("all_match", reduce(lambda a, b: a & b, [F.col(k) for k in FLAGS]))


def analysis_input(records: DataFrame, criteria: Criteria, include_state: bool = False) -> DataFrame:
    """The records that summaries look at: all if no criterion is active, else the visible ones.

    Status and bookmark alone do not count as active unless include_state is set.
    """
    own = flags(criteria)
    state = {"status_match", "bookmark_match"}
    active = any(p is not None and (include_state or k not in state) for k, p in own.items())
    return filter_records(records, criteria) if active else records


def known_fields(records: DataFrame, criteria: Criteria) -> list[str]:
    """The attributes among the criteria's fields that any record has; at most as many names as there are criteria come to the driver."""
    asked = list(criteria.clean().fields)
    if not asked:
        return []
    row = records.agg(*[F.coalesce(F.bool_or(F.map_contains_key(F.col("attributes"), F.lit(k))), F.lit(False)).alias(f"_{i}") for i, k in enumerate(asked)]).first()
    return [k for k, has in zip(asked, row) if has]


def apply_preset(criteria: Criteria, capabilities: Row | dict, attribute_names: Iterable[str]) -> Criteria:
    """A preset without the criteria whose column has no data, and without unknown attributes."""
    has = capabilities.asDict() if isinstance(capabilities, Row) else capabilities
    known = set(attribute_names)
    c = criteria.clean()
    return replace(
        c,
        severities=c.severities if has["has_severity"] else (),
        subsystems=c.subsystems if has["has_subsystem"] else (),
        event_codes=c.event_codes if has["has_event_code"] else (),
        entity_ids=c.entity_ids if has["has_entity"] else (),
        start=c.start if has["has_timestamp"] else None,
        end=c.end if has["has_timestamp"] else None,
        fields={k: v for k, v in c.fields.items() if k in known},
    )


def preset_counts(records: DataFrame, presets: dict[str, Criteria]) -> DataFrame:
    """(session_id, preset, visible, total): what each preset shows of each session, in one pass."""
    if len(presets) > MOST_PRESETS:
        raise ValueError(f"more than {MOST_PRESETS} presets")
    counts = [F.count_if(predicate(c)).alias(f"_p{i}") for i, c in enumerate(presets.values())]
    summed = records.groupBy("session_id").agg(F.count("*").alias("total"), *counts)
    pairs = F.array(*[F.struct(F.lit(n).alias("preset"), F.col(f"_p{i}").alias("visible")) for i, n in enumerate(presets)])
    return summed.select("session_id", "total", F.explode(pairs).alias("x")).select("session_id", "x.preset", "x.visible", "total")


def legacy_events(records: DataFrame) -> DataFrame:
    """The six texts of older tools; what is missing is empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return records.select("session_id", "record_number", text("event_ts_text").alias("timestamp"), text("severity").alias("level"), text("subsystem").alias("subsystem"), text("event_code").alias("event_code"), text("entity_id").alias("entity_id"), text("message").alias("message"))


def legacy_filter(events: DataFrame, level: str = "", subsystem: str = "", search: str = "") -> DataFrame:
    """Exact level and subsystem, and a search in all six texts in any case; blanks accept everything."""
    out = events
    if level:
        out = out.where(F.col("level") == level)
    if subsystem:
        out = out.where(F.col("subsystem") == subsystem)
    if q := search.strip().lower():
        texts = ("timestamp", "level", "subsystem", "event_code", "entity_id", "message")
        out = out.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(q)) for c in texts]))
    return out
