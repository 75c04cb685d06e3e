"""JSON documents of any size: the elements at a record path, cut by structure.

Files are read as pieces that begin behind "{". A split may begin inside a string or outside of one, so its effect is
told for both; each is the containers that it closes, those that it opens and the names they have. No task
holds a document, only elements.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ingest import SOURCE, IngestResult, error_when, finish, no_notes
from ..profile import Profile
from ..session import importable, stored
from .json_sources import as_object, with_fields
from .splits import PLACE, may_be_split, numbered, read_pieces, runs, split_states, with_states

_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?|["{}\[\],]', re.S)
_STRING_END = re.compile(r'((?:[^"\\]|\\.)*)"(\s*:)?', re.S)
#: What lies before the next bracket, or before a string that does not end.
_BETWEEN = re.compile(r'(?:[^"{}\[\]]++|"(?:[^"\\]|\\.)*+")*+', re.S)
_OPENS = {"}": "{", "]": "["}
#: The key of a container that was open before the split is not known; a key may have begun before it.
UNKNOWN, REST = "\x00", "\x01"
BEGIN = [False, "", [["^", None, None]], ""]


def _plain(key: str) -> str:
    if "\\" not in key:
        return key
    try:
        return json.loads(f'"{key}"')
    except ValueError:
        return key


class Scan:
    """Containers that are open, each as [kind, its name in the one around it, the key that is being read in it]."""

    def __init__(self, inside: bool = False, partial: str = "", frames: list[list] | None = None):
        self.inside, self.partial = inside, partial
        self.frames = frames or [["?", None, UNKNOWN]]
        self.closed: list[str] = []
        self.touched = False  # a container began and ended in what was open before the split
        self.error = ""

    def feed(self, text: str, below: int = 0) -> Iterator[tuple[str, int]]:
        """Brackets, commas and keys with their places, after each was taken in. Of more than below containers only the brackets, if that is given."""
        at = 0
        if self.inside:
            end = _STRING_END.match(text)
            if not end:
                self.partial += text
                return
            self.inside, at = False, end.end()
            if end[2]:
                self.frames[-1][2] = _plain(self.partial + end[1])
                yield ":", at
            self.partial = ""
        while not self.error:
            if below and len(self.frames) > below:
                at = _BETWEEN.match(text, at).end()
            m = _TOKEN.search(text, at)
            if not m:
                return
            at = m.end()
            c = m[0][0]
            if c == '"':
                if m[1] is None:
                    self.inside, self.partial = True, text[m.end() :]
                    return
                if m[2]:
                    self.frames[-1][2] = _plain(m[1])
                    yield ":", m.end()
                continue
            if c in "{[":
                top = self.frames[-1]
                if top[0] == "^" and top[2] == "done":
                    self.error = "something follows the root"
                    return
                self.frames.append([c, None if top[0] in "[^" else top[2], None])
            elif c == ",":
                if self.frames[-1][0] == "^":
                    self.error = "a comma outside of the root"
                    return
                self.frames[-1][2] = None
            else:
                top = self.frames.pop()
                if top[0] == "?":
                    self.closed.append(c)
                    self.frames.append(["?", None, UNKNOWN])
                    self.touched = False
                elif top[0] != _OPENS[c]:
                    self.error = f"{c} closes {top[0]}"
                    return
                elif self.frames[-1][0] == "^":
                    self.frames[-1][2] = "done"
                self.touched = self.touched or self.frames[-1][0] == "?" and top[0] != "?"
            yield c, m.start()


def effects(pieces: Iterator[tuple[bool, str]]) -> list:
    """For a beginning outside and inside of a string: whether and with what it ends inside, brackets closed, containers left open, what is wrong, and whether a container began and ended in the one around."""
    scans = [Scan(), Scan(True, REST)]
    for first, piece in pieces:
        for s in scans:
            if not s.error:
                for _ in s.feed(piece if first else "{" + piece):
                    pass
    return [[s.inside, s.partial, s.closed, s.frames, s.error, s.touched] for s in scans]


def after(state: list, effect: list) -> list:
    """The state behind a split: inside a string, its beginning, the containers that are open, and what is wrong."""
    inside, partial, frames, error = state
    ends_inside, rest, closed, opened, wrong, touched = effect[inside]
    known = lambda text: partial + text[1:] if isinstance(text, str) and text.startswith(REST) else text
    for c in closed:
        if len(frames) < 2 or frames[-1][0] != _OPENS[c]:
            return [False, "", frames, error or wrong or f"{c} closes nothing"]
        frames.pop()
        if frames[-1][0] == "^":
            frames[-1][2] = "done"
    base = frames[-1]
    inherited = None if base[0] in "[^" else base[2]
    if base[0] == "^":
        if (base[2] == "done") + touched + (len(opened) > 1) > 1:
            wrong = wrong or "something follows the root"
        base[2] = "done" if touched else base[2]
    more = [[kind, inherited if name == UNKNOWN else None if base[0] in "[^" and i == 0 else known(name), known(key)] for i, (kind, name, key) in enumerate(opened[1:])]
    if opened[0][2] != UNKNOWN and base[0] != "^":
        base[2] = known(opened[0][2])
    return [ends_inside, known(rest), frames + more, error or wrong]


def cut(pieces: DataFrame, path: list[str], states: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """(SOURCE, block, k, whole, raw_source, told): elements of the list, or the object, at a path; see numbered().

    The row of a split with k below 0 tells as JSON [kind of the root, containers at the path, other values there], what is wrong as raw_source, and as whole whether the split is blank.
    With a limit, pieces of one file are read no further than element limit + 1.
    """
    importable(pieces.sparkSession)
    depth = len(path) + 2
    names = [*SOURCE, "block", "k", "whole", "raw_source", "told"]
    kinds = [pa.string()] * 3 + [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]

    def here(frames: list[list]) -> bool:
        return len(frames) >= depth and all(f[1] == p for f, p in zip(frames[2:depth], path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held) if held else [()] * 8, kinds)], names=names)
            held.clear()
            return batch

        for (*source, block, single), rows in runs(batches, PLACE):
            scan, k, size, count, scalars, root, blank = None, 0, 0, 0, 0, "", True
            kind, parts, opened = "", [], 0

            def emit(text: str, whole: bool) -> None:
                held.append((*source, block, k, whole and k > 0, "".join([*parts, text]), None))
                parts.clear()

            for number, (state, piece) in enumerate(rows):
                first = block == 0 and number == 0
                text = (piece or "").removeprefix("﻿") if first else "{" + (piece or "")
                if scan is None:
                    inside, partial, frames, wrong = json.loads(state) if state else json.loads(json.dumps(BEGIN))
                    scan = Scan(inside, partial, frames)
                    scan.error = wrong
                    kind = frames[depth - 1][0] if here(frames) else ""
                if scan.error:
                    break
                blank = blank and not text.strip()
                root = root or (text.strip()[:1] if block == 0 else "")
                start = 0
                for c, at in scan.feed(text, depth):
                    frames = scan.frames
                    if kind == "[":
                        if c == "," and len(frames) == depth:
                            emit(text[start:at], True)
                            k, start = k + 1, at + 1
                        elif c == "]" and len(frames) == depth - 1:
                            if "".join([*parts, text[start:at]]).strip() or k == 0:
                                emit(text[start:at], True)
                            elif k > opened:
                                scan.error = "an element is missing"
                            else:
                                parts.clear()
                                k -= 1
                            kind = ""
                    elif kind == "{":
                        if c == "}" and len(frames) == depth - 1:
                            emit(text[start : at + 1], True)
                            kind = ""
                    elif c in "{[" and len(frames) == depth and here(frames):
                        kind, count, k = c, count + 1, k + 1
                        opened = k
                        start = at if c == "{" else at + 1
                    elif c == ":" and path and len(frames) == depth - 1 and frames[-1][2] == path[-1] and all(f[1] == p for f, p in zip(frames[2:], path)):
                        scalars += text[at:].lstrip()[:1] not in ("{", "[", "")
                if kind and not scan.error:
                    parts.append(text[start:])
                size += len(text)
                if limit and k > limit:
                    held.append((*source, block, -1 - k, False, "", json.dumps([root, count, scalars])))
                    yield out()
                    return
                if len(held) >= 512 or size > 4 << 20:
                    yield out()
                    size = 0
            for _ in rows:
                pass
            if kind and scan and not scan.error and not single:
                emit("", False)
            error = scan.error if scan else ""
            if single and scan and not error and (scan.inside or len(scan.frames) > 1):
                error = "the document ends early"
            held.append((*source, block, -1 - k, blank, error, json.dumps([root, count, scalars])))
            yield out()

    schema = ", ".join(f"{c} string" for c in SOURCE) + ", block long, k long, whole boolean, raw_source string, told string"
    return with_states(pieces, states).mapInArrow(run, schema)


def ingest_json_files(spark: SparkSession, paths: str | list[str], profile: Profile, session_id: str = "default") -> IngestResult:
    """Records of JSON files: the elements of a list, or an object, at the root or at profile.record_path.

    A file may be larger than a split and than a row: several tasks cut it, and no task holds it. A file with unbalanced
    brackets, or with an element at the path that is not valid JSON, is rejected whole; values elsewhere are not looked into.
    Otherwise as ingest_json_documents().
    """
    path = [p for p in profile.record_path.strip().split(".") if p]
    pieces = read_pieces(spark, paths, "{", session_id)
    states = stored(split_states(pieces, BEGIN, effects, after), "json-states") if may_be_split(spark, paths) else None
    cuts = stored(cut(pieces, path, states), "json-cuts")
    whole, parts = numbered(cuts)
    columns = [*SOURCE, "record_number", "raw_source"]
    elements = whole.select(columns).union(parts.select(columns)).withColumn("_v", F.try_parse_json("raw_source"))
    told = F.from_json("told", "array<string>")
    found = cuts.where("k < 0").groupBy(*SOURCE).agg(F.min(F.when(F.col("raw_source") != "", F.col("raw_source"))).alias("_wrong"), F.max(told[0]).alias("_root"), F.sum(told[1].cast("long")).alias("_n"), F.sum(told[2].cast("long")).alias("_others"))
    if states is not None:
        last = F.from_json("state", "array<string>")
        ends = states.where("block = -1").select("source_path", F.when(last[3] != "", last[3]).when((last[0] == "true") | (F.size(F.from_json(last[2], "array<string>")) > 1), F.lit("the document ends early")).alias("_end"))
        found = found.join(ends, "source_path", "left").withColumn("_wrong", F.coalesce("_wrong", "_end")).drop("_end")
    bad = elements.where("_v is null").select(*SOURCE).distinct().withColumn("_bad", F.lit(True))
    found = found.join(bad, list(SOURCE), "left")
    cases = [(F.col("_wrong").isNotNull() | F.col("_bad") | (F.col("_root") == ""), "MALFORMED_JSON_DOCUMENT", "the document is not valid JSON")]
    if path:
        cases += [
            (F.col("_root") != "{", "JSON_RECORD_PATH_REQUIRES_OBJECT_ROOT", "a record path needs an object at the root"),
            ((F.col("_n") == 0) & (F.col("_others") > 0), "JSON_RECORD_PATH_NOT_CONTAINER", f"neither object nor list at the record path {profile.record_path}"),
            (F.col("_n") == 0, "JSON_RECORD_PATH_NOT_FOUND", f"nothing at the record path {profile.record_path}"),
        ]
    else:
        cases.append((~F.col("_root").isin("{", "["), "STRUCTURED_JSON_ROOT_UNSUPPORTED", "the root is neither object nor list"))
    found = stored(found.withColumn("_e", error_when(*cases)).where("_e is not null").select(*SOURCE, F.col("_e.code").alias("code"), F.col("_e.message").alias("message"), F.lit("Error").alias("severity")), "json-sources")
    good = elements.join(found.select("source_path"), "source_path", "left_anti").select(*columns, "_v")
    parsed = good.withColumns({"raw_source": F.col("_v").cast("string"), "error": error_when((as_object(F.col("_v")).isNull(), "STRUCTURED_JSON_RECORD_NOT_OBJECT", "the element is not an object")), "notes": no_notes()})
    return finish(with_fields(parsed, "_v", profile), profile, found)
