"""XML elements as records, cut by their whole path from files of any size.

Files are read as pieces that end at ">". What a split does to the stack of open elements
is the names that it closes and the names that it opens, which compose: one pass tells this for
each lexical state that the split may begin in (text, comment, CDATA, quoted value, ...),
a prefix over the splits of a file gives the true state and stack at each beginning, and
a second pass cuts the elements. Those that lie across splits are put together by
their number. A file of one split, and a document in a row, need the second pass only.

Elements become a map of dotted paths, so that no schema is needed and 007 stays 007.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ingest import SOURCE, IngestResult, error_when, finish, no_notes
from ..profile import Profile
from ..session import importable, stored
from .splits import PLACE, may_be_split, numbered, read_pieces, runs, split_states, with_states

#: Where a piece may begin: in text, or in what ends with these before ">", or in a quoted value.
MODES = ("", "--", "]]", "?", "]", '"', "'")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_NAME = re.compile(r"[^\s/<>!?=\"']+")


def local(name: str) -> str:
    return name.rpartition(":")[2]


def open_quote(text: str) -> str:
    """The quotation mark that is open at the end of a tag's text, if any."""
    if '"' not in text and "'" not in text:
        return ""
    rest = _QUOTED.sub("", text)
    return next((c for c in rest if c in "\"'"), "")


@lru_cache(4096)
def _tag(text: str) -> tuple[str, str | None, str]:
    """What a tag does to the stack, its local name (null if there is none), and the quotation mark that is open behind it; of a tag's text without < and >."""
    if text.startswith("/"):
        return "close", local(text[1:].strip()), ""
    name = _NAME.match(text)
    if not name:
        return "", None, ""
    mode = open_quote(text[name.end() :])
    return "empty" if not mode and text.endswith("/") else "open", local(name[0]), mode


class Scan:
    """The stack of open elements over pieces of a document that end at ">"."""

    def __init__(self, mode: str = "", stack: list[str] | None = None, done: bool = False):
        self.mode, self.stack, self.done = mode, list(stack or ()), done
        self.known = stack is not None
        self.closed: list[str | None] = []
        self.touched = False  # an element began and ended where nothing else is known to be open
        self.error = ""
        self.at = 0

    def _push(self, name: str) -> None:
        if self.known and not self.stack and self.done:
            self.error = "content behind the root element"
        self.stack.append(name)

    def _pop(self, name: str | None) -> None:
        if not self.stack:
            if self.known:
                self.error = f"nothing is open that </{name}> closes"
            self.closed.append(name)
            self.touched = False
            return
        top = self.stack.pop()
        self.touched = self.touched or not self.stack
        if name is not None and top != name:
            self.error = f"</{name}> closes <{top}>"
        self.done = self.done or self.known and not self.stack

    def feed(self, piece: str) -> str:
        """open, close, empty or nothing; the tag begins at self.at, or in an earlier piece if that is -1."""
        mode = self.mode
        if mode:
            self.at = -1
            if mode in ("--", "]]", "?"):
                self.mode = "" if piece.endswith(mode) else mode
            elif mode == "]":
                self.mode = "" if piece.rstrip().endswith("]") else mode
            elif (end := piece.find(mode)) >= 0:
                self.mode = open_quote(piece[end + 1 :])
                if not self.mode and piece.endswith("/") and len(piece) > end + 1:
                    self._pop(None)
                    return "close"
            return ""
        i = self.at = piece.find("<")
        if i < 0:
            return ""
        c = piece[i + 1 : i + 2]
        if c == "?":
            self.mode = "" if piece.endswith("?") and len(piece) > i + 2 else "?"
            return ""
        if c == "!":
            if piece.startswith("<!--", i):
                self.mode = "" if piece.endswith("--") and len(piece) >= i + 6 else "--"
            elif piece.startswith("<![CDATA[", i):
                self.mode = "" if piece.endswith("]]") and len(piece) >= i + 11 else "]]"
            else:
                self.mode = "]" if "[" in piece[i:] and not piece.rstrip().endswith("]") else ""
            return ""
        event, name, mode = _tag(piece[i + 1 :])
        if event == "close":
            if len(self.stack) > 1 and self.stack[-1] == name:
                self.stack.pop()
            else:
                self._pop(name)
        elif name is None:
            self.error = "< without a name behind it"
        else:
            if self.stack:
                self.stack.append(name)
            else:
                self._push(name)
            self.mode = mode
            if event == "empty":
                self._pop(None)
        return event


def effects(pieces: Iterator[tuple[bool, str]]) -> dict[str, list]:
    """For each state that the pieces may begin in: the state at their end, names closed, names opened, what is wrong, and whether an element began and ended with nothing else known to be open.

    A scan that has come to the state of the first one is the same from there on.
    """
    parts = [Scan()]
    others = {m: (Scan(m), None) for m in MODES[1:]}
    apart = list(others)
    for _, piece in pieces:
        parts[-1].feed(piece)
        for m in apart:
            others[m][0].feed(piece)
        met = [m for m in apart if others[m][0].mode == parts[-1].mode]
        if met:
            parts.append(Scan(parts[-1].mode))
            for m in met:
                others[m] = (others[m][0], len(parts) - 1)
            apart = [m for m in apart if m not in met]

    def joined(scans: list[Scan]) -> list:
        closed: list[str | None] = []
        opened: list[str] = []
        error, touched = "", False
        for s in scans:
            error = error or s.error
            for name in s.closed:
                if not opened:
                    closed.append(name)
                    touched = False
                    continue
                if (top := opened.pop()) != name and name is not None:
                    error = error or f"</{name}> closes <{top}>"
                touched = touched or not opened
            touched = touched or s.touched and not opened
            opened += s.stack
        return [scans[-1].mode, closed, opened, error, touched]

    return {"": joined(parts)} | {m: joined([s] if k is None else [s, *parts[k:]]) for m, (s, k) in others.items()}


BEGIN = ["", [], False, ""]


def after(state: list, effect: dict[str, list]) -> list:
    """[mode, stack, done, error] behind a split whose effect this is."""
    mode, stack, done, error = state
    end, closed, opened, wrong, touched = effect[mode]
    stack = list(stack)
    for name in closed:
        if not stack:
            wrong = wrong or f"nothing is open that </{name}> closes"
            break
        if (top := stack.pop()) != name and name is not None:
            wrong = wrong or f"</{name}> closes <{top}>"
    done = done or bool(closed) and not stack
    if done and (opened or touched) and not stack:
        wrong = wrong or "content behind the root element"
    done = done or touched and not stack
    if done and opened and not stack:
        wrong = wrong or "content behind the root element"
    return [end, stack + opened, done, error or wrong]


def _pieces_of(text: str) -> Iterator[tuple[None, str]]:
    at = 0
    while (end := text.find(">", at)) >= 0:
        yield None, text[at:end]
        at = end + 1
    yield None, text[at:]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator]]:
    """As runs(), of whole documents."""
    for b in batches:
        for *source, document in zip(*(b.column(c).to_pylist() for c in (*SOURCE, "document"))):
            yield (*source, 0, True), _pieces_of(document or "")


# Elements as maps.


def _put(up: dict, name: str, value: object) -> None:
    """Adds a child's value to those of the element around it."""
    if name == "Data" and isinstance(value, dict) and value.get("@Name", "").strip():
        if not isinstance(up.get("NamedData"), dict):
            up["NamedData"] = {}
        up = up["NamedData"]
        name, value = value["@Name"].strip(), value.get("#text", "")
    if name not in up:
        up[name] = value
    elif isinstance(up[name], list):
        up[name].append(value)
    else:
        up[name] = [up[name], value]


@lru_cache(4096)
def _bare(name: str) -> str:
    """The local name of {namespace}name."""
    return local(name.rpartition("}")[2]) if "}" in name or ":" in name else name


def _value_of(node: ElementTree.Element) -> object:
    own = node.text or ""
    values: dict[str, object] = {"@" + _bare(k): v for k, v in node.items()} if node.attrib else {}
    for child in node:
        name = _bare(child.tag)
        value = _value_of(child) if len(child) or child.attrib else (child.text or "").strip()
        if name in values or name == "Data":
            _put(values, name, value)
        else:
            values[name] = value
        if child.tail:
            own += child.tail
    own = own.strip()
    if not values:
        return own
    if own:
        values["#text"] = own
    return values


_compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode


def _flatten(record: dict, below: str, pairs: dict[str, str], lists: list[str]) -> None:
    for k, value in record.items():
        if type(value) is str:
            pairs[below + k] = value
        elif type(value) is dict:
            _flatten(value, f"{below}{k}.", pairs, lists)
        else:
            pairs[below + k] = _compact(value)
            lists.append(below + k)


def _flat_of(record: object) -> tuple[list[tuple[str, str]], list[str]]:
    pairs: dict[str, str] = {}
    lists: list[str] = []
    _flatten(record if isinstance(record, dict) else {"#text": record}, "", pairs, lists)
    return list(pairs.items()), lists


def fields_of(element: str) -> tuple[list[tuple[str, str]], list[str]] | None:
    """Dotted paths and texts of an element, and the paths that are lists; null if it is not well formed.

    Attributes are @name, text beside attributes or children #text, names are local, repeated children a
    list. Children <Data Name="K">v</Data> are NamedData.K. Texts are trimmed.
    """
    try:
        return _flat_of(_value_of(ElementTree.XML(element)))
    except ElementTree.ParseError:
        pass  # also a prefix that is declared around the element
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    stack: list[list] = [[{}, [], False]]

    def start(name: str, attributes: dict) -> None:
        own = {"@" + local(k): v for k, v in attributes.items() if k != "xmlns" and not k.startswith("xmlns:")}
        stack.append([own, [], False, local(name)])

    def end(_: str) -> None:
        values, text, has_children, name = stack.pop()
        own = "".join(text).strip()
        value: object = own
        if has_children or values:
            if own:
                values["#text"] = own
            value = values
        up = stack[-1][0]
        stack[-1][2] = True
        if len(stack) == 1:
            up[""] = value
            return
        _put(up, name, value)

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: stack[-1][1].append(data)
    try:
        parser.Parse(element.encode(), True)
    except expat.ExpatError:
        return None
    return _flat_of(stack[0][0][""])


_PARSED = "error struct<code:string,message:string>, fields map<string,string>, lists array<string>"
_ERROR = pa.struct([("code", pa.string()), ("message", pa.string())])
_BAD = {"code": "XML_PARSE_ERROR", "message": "the element is not well formed"}


def _together(elements: list[str]) -> Iterator[tuple[list[tuple[str, str]], list[str]] | None]:
    """fields_of() of each element, from one document of them all; a parser for each costs more than most elements.

    What stands between elements is a word that no data can know, so if it is found between all of them each is well formed by itself.
    """
    word = uuid.uuid4().hex
    try:
        root = ElementTree.XML(f"<r>{word}{word.join(elements)}{word}</r>")
        alone = len(root) != len(elements) or root.text != word or any(e.tail != word for e in root)
    except (ElementTree.ParseError, ValueError):
        alone = True
    if alone:
        yield from map(fields_of, elements)
        return
    for e in root:
        yield _flat_of(_value_of(e))


#: Elements, and characters of them, that one parser takes.
TOGETHER, MOST_CHARACTERS = 64, 1 << 20


def _fields_of_all(raw: list[str | None]) -> list[tuple[list[tuple[str, str]], list[str]] | None]:
    some = [r for r in raw if r is not None]
    found: list = []
    for i in range(0, len(some), TOGETHER):
        few = some[i : i + TOGETHER]
        found.extend(_together(few) if sum(map(len, few)) <= MOST_CHARACTERS else map(fields_of, few))
    rest = iter(found)
    return [None if r is None else next(rest) for r in raw]


def _parsed(raw: list[str | None]) -> list[pa.Array]:
    got = _fields_of_all(raw)
    return [
        pa.array([_BAD if g is None and r is not None else None for g, r in zip(got, raw)], _ERROR),
        pa.array([g and g[0] for g in got], pa.map_(pa.string(), pa.string())),
        pa.array([g[1] if g else [] for g in got], pa.list_(pa.string())),
    ]


def with_element_fields(elements: DataFrame) -> DataFrame:
    """elements(SOURCE, record_number, raw_source) with error, fields and lists."""
    importable(elements.sparkSession)
    names = [*SOURCE, "record_number", "raw_source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *_parsed(b.column("raw_source").to_pylist())], names=[*names, "error", "fields", "lists"])

    return elements.select(names).mapInArrow(run, ", ".join(f"{c} string" for c in SOURCE) + ", record_number long, raw_source string, " + _PARSED)


# Pieces and cuts.

def cut(pieces: DataFrame, path: list[str], states: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """What each split of pieces, or each row of documents(SOURCE, document), holds of the elements at a path; of the root element if that is empty.

    (SOURCE, block, k, whole, raw_source, error, fields, lists): k counts the elements that begin in the split
    from 1, 0 is the rest of one that began before; whole tells that it ends there too. A split in which n
    elements begin has one more row, with k = -1 - n, what is wrong with it as raw_source, and as whole whether it is blank.
    With a limit, pieces of one file are read no further than element limit + 1.
    """
    importable(pieces.sparkSession)
    depth = len(path) or 1
    whole_documents = "document" in pieces.columns
    if whole_documents:
        rows_in = pieces.select(*SOURCE, "document")
    else:
        rows_in = with_states(pieces, states)
    names = [*SOURCE, "block", "k", "whole", "raw_source"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            raw = [h[6] if h[4] > 0 and h[5] else None for h in held]
            kinds = [pa.string()] * 3 + [pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*held) if held else [()] * 7, kinds)]
            batch = pa.RecordBatch.from_arrays([*columns, *_parsed(raw)], names=[*names, "error", "fields", "lists"])
            held.clear()
            return batch

        for (*source, block, single), rows in _documents(batches) if whole_documents else runs(batches, PLACE):
            scan, inside, text, k, size, blank = None, False, [], 0, 0, True
            for state, piece in rows:
                piece = piece or ""
                if scan is None:
                    mode, stack, done, wrong = json.loads(state) if state else ("", [], False, "")
                    scan = Scan(mode, stack, done)
                    scan.error = wrong
                    inside = len(stack) >= depth and (not path or stack[:depth] == path)
                    if not stack and not done:
                        piece = piece.removeprefix("﻿")
                if scan.error:
                    break
                blank = blank and not piece.strip()
                event = scan.feed(piece)
                if scan.error:
                    break
                if inside:
                    text.append(piece)
                    if event == "close" and len(scan.stack) < depth:
                        text.append("")
                        held.append((*source, block, k, k > 0, ">".join(text)))
                        size += len(held[-1][6])
                        inside, text = False, []
                elif event == "empty":
                    if len(scan.stack) == depth - 1 and (not path or [*scan.stack, local(_NAME.match(piece, scan.at + 1)[0])] == path):
                        k += 1
                        held.append((*source, block, k, True, piece[scan.at :] + ">"))
                elif event == "open" and len(scan.stack) == depth and (not path or scan.stack == path):
                    k += 1
                    inside, text = True, [piece[scan.at :]]
                if limit and k > limit:
                    held.append((*source, block, -1 - k, False, ""))
                    yield out()
                    return
                if len(held) >= 256 or size > 4 << 20:
                    yield out()
                    size = 0
            for _ in rows:
                pass
            if inside and not single and not scan.error:
                held.append((*source, block, k, False, ">".join([*text, ""])))
            error = scan.error
            if single and not error:
                error = "the document has no root element" if not scan.done and not scan.stack and not blank else "elements are left open" if scan.stack or scan.mode else ""
            held.append((*source, block, -1 - k, blank, error))
            yield out()

    schema = ", ".join(f"{c} string" for c in SOURCE) + ", block long, k long, whole boolean, raw_source string, " + _PARSED
    return rows_in.mapInArrow(run, schema)


def _cut_sources(cuts: DataFrame, path: str, states: DataFrame | None) -> DataFrame:
    """Errors of whole sources: the first thing that is wrong in one, no content, or no element at the path."""
    ends = cuts.where("k < 0")
    if states is not None:
        last = F.from_json("state", "array<string>")
        at_end = states.where("block = -1").select("source_path", F.when(last[3] != "", last[3]).when((last[0] != "") | (last[1] != "[]"), F.lit("elements are left open")).alias("_end"))
    found = ends.groupBy(*SOURCE).agg(F.min(F.when(F.col("raw_source") != "", F.struct("block", "raw_source"))).alias("_wrong"), F.bool_and("whole").alias("_blank"), F.sum(-1 - F.col("k")).alias("_n"))
    found = found.join(at_end, "source_path", "left") if states is not None else found.withColumn("_end", F.lit(None).cast("string"))
    wrong = F.coalesce(F.col("_wrong.raw_source"), F.col("_end"))
    error = error_when(
        (F.col("_blank"), "XML_DOCUMENT_EMPTY", "the document is empty"),
        (wrong.isNotNull(), "XML_PARSE_ERROR", wrong),
        (F.col("_n") == 0, "XML_RECORD_PATH_NOT_FOUND", f"no element at {path}"),
    )
    return found.withColumn("_e", error).where("_e is not null").select(*SOURCE, F.col("_e.code").alias("code"), F.col("_e.message").alias("message"), F.lit("Error").alias("severity"))


def ingest_xml_pieces(pieces: DataFrame, profile: Profile, several: bool = False) -> IngestResult:
    """Records of pieces; several tells that a source may have more than one split."""
    path = [p for p in profile.record_path.strip().split(".") if p]
    columns = [*SOURCE, "record_number", "raw_source", "error", "fields", "lists"]
    if not several:
        states = None
        cuts = cut(pieces, path)
        rows = cuts.where("k > 0").withColumn("record_number", F.col("k")).select(columns)
    else:
        states = stored(split_states(pieces, BEGIN, effects, after), "xml-states")
        cuts = stored(cut(pieces, path, states), "xml-cuts")
        whole, parts = numbered(cuts)
        rows = whole.select(columns).union(with_element_fields(parts).select(columns))
    made = rows.withColumns({"others": F.col("lists"), "notes": no_notes()})
    return finish(made, profile, _cut_sources(cuts, profile.record_path, states))


def ingest_xml(elements: DataFrame, profile: Profile) -> IngestResult:
    """Records of elements(SOURCE, record_number, raw_source) that are cut out already."""
    rows = with_element_fields(elements)
    return finish(rows.withColumns({"others": F.col("lists"), "notes": no_notes()}), profile)


def ingest_xml_files(spark: SparkSession, paths: str | list[str], profile: Profile, session_id: str = "default") -> IngestResult:
    """Records of files, of any size: a file larger than a split is cut by many tasks.

    The elements whose path from the root is the record path are records, whatever has their names elsewhere,
    comments and CDATA included; elements of that name inside a record belong to it. Records that are complete
    before something is wrong with a document stay, and the document is an error of its source.
    """
    return ingest_xml_pieces(read_pieces(spark, paths, ">", session_id), profile, several=may_be_split(spark, paths))


def ingest_xml_documents(documents: DataFrame, profile: Profile) -> IngestResult:
    """Records of whole documents(SOURCE, document), as ingest_xml_files(); a null document is empty."""
    return ingest_xml_pieces(documents, profile)
