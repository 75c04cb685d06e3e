"""Hashed terms of texts, and bounded samples of labelled documents to fit models on."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: ASCII bytes that are neither letters nor digits separate words; others belong to letters of other alphabets.
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: What a byte looks like: a letter, a capital, a digit, or itself.
_SHAPE = bytes(97 if c >= 128 or chr(c).islower() else 65 if chr(c).isupper() else 48 if chr(c).isdigit() else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
Terms = tuple[np.ndarray, np.ndarray]


class Hashed(dict):
    """Hash of a term, remembered for up to a million terms."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1

    def __missing__(self, term: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        found = self[term] = zlib.crc32(term) & self.mask
        return found


def quality_terms(text: str | None, memo: Hashed) -> Terms:
    """Words, shapes of white-space tokens, and how much repeats; values are roots of shares."""
    raw = (text or "").encode()
    words = raw.lower().translate(_SPACES).split()
    tokens = raw.translate(_SHAPE).split()
    out: Counter[int] = Counter()
    if not tokens:
        out[memo[b"\x00empty"]] += 1
        return np.array(list(out), np.int32), np.ones(len(out), np.float32)
    for term, n in Counter(words).items():
        out[memo[term]] += n / len(words)
    shapes: Counter[bytes] = Counter()
    for token, n in Counter(tokens).items():
        shapes[_RUN.sub(rb"\1", token)[:8]] += n
    for term, n in shapes.items():
        out[memo[b"\x01" + term]] += n / len(tokens)
    same = sum(map(bytes.__eq__, tokens, tokens[1:])) / len(tokens)
    out[memo[b"\x02%d" % round(8 * same**0.5)]] += 1
    lines = raw.split(b"\n")
    out[memo[b"\x03%d" % round(8 * len(set(lines)) / len(lines))]] += 1
    return np.fromiter(out, np.int32, len(out)), np.sqrt(np.fromiter(out.values(), np.float32, len(out)))


def toxicity_terms(text: str | None, memo: Hashed) -> Terms:
    """Distinct words, and beginnings of words of 4 and 5 bytes, which stand for their stems."""
    words = set((text or "").encode().lower().translate(_SPACES).split())
    terms = words | {b"\x01" + w[:4] for w in words if len(w) > 4} | {b"\x02" + w[:5] for w in words if len(w) > 5}
    found = np.fromiter({memo[w] for w in terms}, np.int32)
    return found, np.ones(len(found), np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, grade_col: str, rows: int, terms: Callable, bits: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grades, and row starts, terms and values, of at most rows labelled documents.

    Rows are taken by a hash of their id, so the sample is even and always the same. At
    most 2^bits terms a row, about 300 for usual texts, come to the driver. Rows without
    id or grade are left out.
    """
    small_batches(docs.sparkSession)
    rated = labels.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(grade_col).cast("int").alias("_grade"))
    chosen = rated.orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id", "_grade").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashed(bits)
        for b in batches:
            found = [terms(t, memo) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), b.column("_grade"), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                names=["_id", "_grade", "terms", "vals"],
            )

    schema = texts.select("_id", "_grade", F.lit(b"").alias("terms"), F.lit(b"").alias("vals")).schema
    got = texts.select("_id", "_grade", "_text").mapInArrow(run, schema).toArrow().sort_by([("_id", "ascending"), ("_grade", "ascending")])
    terms_of = [np.frombuffer(x, np.int32) for x in got.column("terms").to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in terms_of])]).astype(np.int64)
    empty = [np.empty(0, np.int32)]
    values = np.frombuffer(b"".join(got.column("vals").to_pylist()), np.float32)
    return got.column("_grade").to_numpy().astype(np.int64), starts, np.concatenate(empty + terms_of), values


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values from starts[i] to starts[i + 1]; 0 for empty rows. values may have a second axis."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def score_rows(docs: DataFrame, terms: Callable, bits: int, score: Callable, names: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id_col, names...) with doubles that score(starts, terms, values) gives for each text of a batch."""
    small_batches(docs.sparkSession)
    schema = docs.select(F.col(id_col), *[F.lit(0.0).alias(n) for n in names]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Hashed(bits)
        for b in batches:
            found = [terms(t, memo) for t in b.column(1).to_pylist()]
            starts = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]).astype(np.int64)
            got = score(starts, np.concatenate([x for x, _ in found]), np.concatenate([v for _, v in found])) if found else [np.empty(0)] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.asarray(x, np.float64)) for x in got)], names=[id_col, *names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
