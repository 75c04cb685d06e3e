"""Removal of repeated strings of bytes by suffix arrays of content-defined groups.

Each string of 100 bytes is assigned to the smallest hash among the strings of 32 bytes
in it, its anchor. Equal strings have equal anchors, so a shuffle by anchor brings them
together. The strings that share one occurrence of an anchor are one window of text.

1. Windows are dealt by anchor as hashes. Windows that are alike as a whole keep only
   their earliest, partly before the shuffle; the others are covered by it. Alike means
   equal in two hashes of 64 bits: among n windows the chance of one error is n^2 / 2^129.
2. Anchors with windows that differ get the windows' text. Tasks take whole groups and
   sort the suffixes of their windows in two stages: those smaller than their successors
   directly, the others by scans of the buckets of first bytes. Adjacent common prefixes
   of 100 bytes and more show the repeats, of which the earliest stays.
3. Anchors with more windows than a group may have are dealt once more, their windows cut
   by the smallest hash of longer strings. The last level has strings of 100 bytes, whose
   equals are alike as a whole, so every group becomes small enough to sort.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, written

LENGTH, ANCHOR = 100, 32
#: Bytes of the strings that deal windows at each level; the last deals whole strings.
ANCHORS = (ANCHOR, 64, 88, LENGTH)
#: Windows that a task sorts at once, and those from which an anchor's windows go to the next level.
BATCH_WINDOWS, GROUP_WINDOWS = 16_384, 2_048
#: Rows of anchors that a partition compares before the shuffle.
FLUSH_ROWS = 400_000
SEGMENT = 1 << 20
_B1, _B2, _B3 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=8)
def _powers(base: int) -> np.ndarray:
    p = np.full(SEGMENT + 2 * LENGTH, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums that give the polynomial hash of any stretch, see _stretch()."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(pow(base, -1, 1 << 64))[: len(values)], out=out[1:])
    return out


def _stretch(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    return (sums[hi] - sums[lo]) * _powers(base)[lo]


_VALUE = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, window hash, start and size of each window of a text; every start of a string is in one window."""
    out = []
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - length + 1), SEGMENT - length):
        part = data[at : at + SEGMENT - 1]
        n, width = len(part), length - anchor + 1
        if n < length:
            break
        value = _VALUE[part]
        sums = _sums(value, _B1)
        ends = np.arange(n - anchor + 1)
        h = _mix(_stretch(sums, ends, ends + anchor, _B1))
        # The leftmost of equals: the place is in the low bits.
        key = (h & ~np.uint64(SEGMENT - 1)) | ends.astype(np.uint64)
        pad = np.concatenate([key, np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
        before = np.minimum.accumulate(pad, axis=1).ravel()
        after = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(after[: n - length + 1], before[width - 1 : len(key)]) & np.uint64(SEGMENT - 1)).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        place = place[lo]
        hi = np.concatenate([lo[1:] - 1, [n - length]]) + length
        w = _stretch(_sums(value, _B2), lo, hi, _B2)
        w = _mix(w ^ _mix((hi - lo).astype(np.uint64) * np.uint64(1 << 20) + (place - lo).astype(np.uint64)))
        out.append((h[place], w, lo + at, hi - lo))
    if not out:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out))


def merged(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of each uid, sorted, those that touch or overlap joined."""
    if not len(uid):
        return uid, lo, hi
    order = np.lexsort((lo, uid))
    uid, lo, hi = uid[order], lo[order], hi[order]
    first = np.concatenate([[True], uid[1:] != uid[:-1]])
    # Ends grow along a uid; a large step for each uid keeps the maxima apart.
    step = (np.cumsum(first) - 1) * (int(hi.max()) + 1)
    far = np.maximum.accumulate(hi + step) - step
    new = first | np.concatenate([[True], lo[1:] > far[:-1]])
    at = np.flatnonzero(new)
    return uid[at], lo[at], far[np.concatenate([at[1:] - 1, [len(uid) - 1]])]


def two_stage(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of windows of text in order of their first depth bytes.

    starts and ends are the first place and the end of each window; text has depth + 8
    zero bytes after each. A window of m bytes gives its m - depth + 1 suffixes that have
    depth bytes. Sorted besides are the few that follow, up to the first that is smaller
    than its successor, from which the others are induced.
    """
    here, after = text[:-1].astype(np.int16), text[1:].astype(np.int16)
    # Of equal bytes, what their run ends with counts.
    sign = np.sign(after - here).astype(np.int8)
    at = np.where(sign != 0, np.arange(len(sign)), len(sign))
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.concatenate([sign, [1]]).astype(np.int8)[at] > 0
    # The first place from the last whole suffix on that is smaller than its successor; a window ends with a zero, which is.
    places = np.arange(len(small))
    direct_at = np.minimum.accumulate(np.where(small, places, len(small) - 1)[::-1])[::-1]
    last = np.minimum(direct_at[ends - depth], ends)
    size = last - starts + 1
    own = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    limit = np.repeat(ends, size)
    direct = small[own] | (own == limit)

    # Stage 1: direct sort, 8 bytes at a time, of those that are still tied.
    sub, stop = own[direct], limit[direct]

    def word(p: np.ndarray, k: int) -> np.ndarray:
        return np.ascontiguousarray(text[(p + 8 * k)[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)

    order = np.argsort(word(sub, 0), kind="stable")
    sub, stop = sub[order], stop[order]
    first = np.diff(word(sub, 0), prepend=np.uint64(0)) != 0
    first[:1] = True
    for k in range(1, -(-depth // 8)):
        alone = first & np.concatenate([first[1:], [True]])
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        w = word(sub[tied], k)
        w[sub[tied] + 8 * k >= stop[tied]] = 0
        group = np.cumsum(first)[tied]
        order = np.lexsort((w, group))
        sub[tied], stop[tied] = sub[tied][order], stop[tied][order]
        w, group = w[order], group[order]
        first[tied] = np.concatenate([[True], (w[1:] != w[:-1]) | (group[1:] != group[:-1])])

    # Stage 2: scan the buckets of first bytes; in each the others come before the directly sorted.
    rest = own[~direct]
    rank = np.full(len(text), -1, np.int64)
    out, n = [], 0
    direct_by = np.searchsorted(text[sub], np.arange(257))
    rest = rest[np.argsort(text[rest], kind="stable")]
    rest_by = np.searchsorted(text[rest], np.arange(257))
    for c in range(256):
        bucket = rest[rest_by[c] : rest_by[c + 1]]
        if len(bucket):
            run = text[bucket + 1] == c
            level = bucket[~run]
            todo = bucket[run]
            while len(level):
                level = level[np.argsort(rank[level + 1], kind="stable")]
                rank[level] = np.arange(n, n + len(level))
                out.append(level)
                n += len(level)
                ready = rank[todo + 1] >= 0
                level, todo = todo[ready], todo[~ready]
        done = sub[direct_by[c] : direct_by[c + 1]]
        rank[done] = np.arange(n, n + len(done))
        out.append(done)
        n += len(done)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def repeats(wins: list[bytes], uid: np.ndarray, lo: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(window number, start in it) of every string of length bytes that also starts earlier, by (uid, place)."""
    size = np.array([len(w) for w in wins])
    gap = bytes(length + 8)
    text = np.frombuffer(gap.join(wins) + gap, np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + len(gap))[:-1]])
    order = two_stage(text, starts, starts + size, length)
    of = np.searchsorted(starts, order, side="right") - 1
    whole = order - starts[of] <= size[of] - length
    order, of = order[whole], of[whole]
    if not len(order):
        return of, order
    # Adjacent common prefixes, as far as the length asked for.
    same = np.arange(1, len(order))
    for k in range(0, length, 8):
        w = min(8, length - k)
        a, b = order[same] + k, order[same - 1] + k
        same = same[(text[a[:, None] + np.arange(w)] == text[b[:, None] + np.arange(w)]).all(1)]
        if not len(same):
            return of[:0], order[:0]
    run = np.ones(len(order), bool)
    run[same] = False
    run = np.cumsum(run)
    place = lo[of] + order - starts[of]
    by = np.lexsort((place, uid[of], run))
    first = np.concatenate([[True], run[by][1:] != run[by][:-1]])
    again = by[~first]
    return of[again], order[again] - starts[of[again]]


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_uid long, _id, _text): _uid is in the order of ids; it is the id where that is a number, never null and never repeated."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n, ids, distinct = rows.agg(F.count("*"), F.count("_id"), F.count_distinct("_id")).first()
    if dict(rows.dtypes)["_id"] in ("bigint", "int", "smallint", "tinyint") and n == ids == distinct:
        return rows.select(F.col("_id").cast("long").alias("_uid"), "_id", "_text")
    rows = written(rows, "suffix-rows").withColumn("_row", F.monotonically_increasing_id())
    order = written(rows.select("_id", "_row").repartitionByRange("_id", "_row").sortWithinPartitions("_id", "_row").select("_row", F.monotonically_increasing_id().alias("_uid")), "suffix-order")
    return written(rows.join(order, "_row").select("_uid", "_id", "_text"), "suffix-docs")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes long, spans array<struct<start,end>>, kept binary): whole texts without repeated strings.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a row
    with a smaller id, or earlier in the same row. spans are the stretches removed, in
    bytes. A null text counts as empty. One row out for each row in: of rows with equal
    ids the order is arbitrary but fixed, and null ids come first. Other columns are
    ignored. An empty table gives an empty table. docs is read several times and must
    give the same rows each time, as a table of files does.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _ordered(docs, id_col, text_col)

    def anchors(batches: Iterator[pa.RecordBatch], anchor: int) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            h, w, uid, of, lo, size = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((lo, uid, w, h))
            h, w, uid, of, lo, size = h[order], w[order], uid[order], of[order], lo[order], size[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
            c_uid, c_lo, c_hi = merged(uid[~first], lo[~first], (lo + size)[~first])
            none = np.zeros(len(c_uid), np.uint64)
            at = np.concatenate([(lo << 32 | size)[first], c_lo << 32 | (c_hi - c_lo)])
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (np.concatenate([h[first], _mix(c_uid.view("<u8"))]).view("<i8"), np.concatenate([w[first], none]).view("<i8"), np.concatenate([uid[first], c_uid]), np.concatenate([of[first], np.zeros(len(c_uid), np.int64)]), at, np.arange(len(at)) >= first.sum())],
                names=["h", "w", "uid", "of", "at", "covered"],
            )

        for b in batches:
            for uid, above, start, raw in zip(*(b.column(c).to_pylist() for c in ("uid", "h", "lo", "raw"))):
                h, w, lo, size = windows(raw, anchor=anchor)
                if len(h):
                    h = _mix(h ^ np.uint64(above & (2**64 - 1))) if above else h
                    held.append((h, w, np.full(len(h), uid, np.int64), np.full(len(h), start, np.int64), lo + start, size))
                    n += len(h)
                if n >= FLUSH_ROWS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks windows that an equal one covers, and the earliest ones of anchors that have several; large: more than a group may have."""

        def rows_out(covered: np.ndarray, need: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
            both = np.concatenate([covered, need])
            is_large = np.concatenate([np.zeros(len(covered), bool), large])
            return pa.RecordBatch.from_arrays([*(pa.array(both[:, i]) for i in range(4)), pa.array(np.arange(len(both)) < len(covered)), pa.array(is_large)], names=["h", "uid", "of", "at", "covered", "large"])

        last = None  # (h, w) of the row before
        pending = np.empty((0, 4), np.int64)  # earliest windows of the last anchor, as long as they may be a group
        going_large = False
        for b in batches:
            covered = b.column("covered").to_numpy(zero_copy_only=False)
            w, rows_in = b.column("w").to_numpy(), np.stack([b.column(c).to_numpy() for c in ("h", "uid", "of", "at")], 1)
            done = [rows_in[covered]]
            w, rows_in = w[~covered], rows_in[~covered]
            h = rows_in[:, 0]
            need, large = pending[:0], np.empty(0, bool)
            if len(h):
                ph = np.concatenate([[h[0] - 1 if last is None else last[0]], h[:-1]])
                pw = np.concatenate([[0 if last is None else last[1]], w[:-1]])
                new = (h != ph) | (w != pw)
                done.append(rows_in[~new])
                was = last[0] if last is not None and going_large else None
                rep = np.concatenate([pending, rows_in[new]])
                _, place, count = np.unique(rep[:, 0], return_inverse=True, return_counts=True)
                count = count[place]
                if was is not None:
                    count[rep[:, 0] == was] += GROUP_WINDOWS
                large = count > GROUP_WINDOWS
                tail = rep[:, 0] == h[-1]
                going_large = bool(large[tail].any()) or was == h[-1]
                keep = tail & ~large
                pending = rep[keep]
                out = (count > 1) & ~keep
                need, large = rep[out], large[out]
                last = (h[-1], w[-1])
            yield rows_out(np.concatenate(done), need, large)
        if len(pending) > 1:
            yield rows_out(pending[:0], pending, np.zeros(len(pending), bool))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The text of the windows that need it."""
        for b in batches:
            for uid, start, raw, need in zip(*(b.column(c).to_pylist() for c in ("uid", "lo", "raw")), b.column("need")):
                part = need.values
                at = part.field("at").to_numpy()
                lo, size = at >> 32, at & 0xFFFFFFFF
                wins = [raw[a : a + n] for a, n in zip((lo - start).tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([part.field("h"), pa.array(np.full(len(at), uid, np.int64)), pa.array(lo), part.field("large"), pa.array(wins, pa.binary())], names=["h", "uid", "lo", "large", "raw"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches that repeat, by whole groups."""

        def sort(h, uid, lo, wins) -> pa.RecordBatch:
            no, start = repeats(wins, uid, lo)
            place = lo[no] + start
            m_uid, m_lo, m_hi = merged(uid[no], place, place + LENGTH)
            return pa.RecordBatch.from_arrays([pa.array(m_uid), pa.array(m_lo << 32 | (m_hi - m_lo))], names=["uid", "at"])

        def joined(held):
            return *(np.concatenate([x[i] for x in held]) for i in range(3)), [w for x in held for w in x[3]]

        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column("h").to_numpy(), b.column("uid").to_numpy(), b.column("lo").to_numpy(), b.column("raw").to_pylist()))
            n += b.num_rows
            if n < BATCH_WINDOWS:
                continue
            h, uid, lo, wins = joined(held)
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on
            if cut:
                yield sort(h[:cut], uid[:cut], lo[:cut], wins[:cut])
            held, n = [(h[cut:], uid[cut:], lo[cut:], wins[cut:])], len(h) - cut
        if n:
            yield sort(*joined(held))

    # Whole texts first, then the windows of anchors that are too large; lo: where a row's bytes start in its text.
    source = rows.select(F.col("_uid").alias("uid"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("lo"), F.col("_text").cast("binary").alias("raw"))
    covered = None
    for anchor in ANCHORS:
        dealt = source.mapInArrow(partial(anchors, anchor=anchor), "h long, w long, uid long, of long, at long, covered boolean")
        marks = written(dealt.repartition("h").sortWithinPartitions("h", "w", "uid", "at").mapInArrow(group, "h long, uid long, of long, at long, covered boolean, large boolean"), "suffix-marks")
        # As many for a row as its bytes have windows, about one in 35 bytes.
        need = marks.where("not covered").groupBy("uid", F.col("of").alias("lo")).agg(F.collect_list(F.struct("at", "h", "large")).alias("need"))
        sent = written(source.drop("h").join(need.hint("shuffle_hash"), ["uid", "lo"]).mapInArrow(send, "h long, uid long, lo long, large boolean, raw binary"), "suffix-windows")
        small = sent.where("not large").select("h", "uid", "lo", "raw")
        solved = written(small.repartition("h").sortWithinPartitions("h", "uid", "lo").mapInArrow(solve, "uid long, at long"), "suffix-solved")
        found = marks.where("covered").select("uid", "at").union(solved)
        covered = found if covered is None else covered.union(found)
        source = sent.where("large").select("uid", "h", "lo", "raw")
        if source.isEmpty():
            break
    per_doc = covered.groupBy("uid").agg(F.collect_list("at").alias("ats")).select(F.col("uid").alias("_uid"), "ats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            size, spans, kept = [], [], []
            for t, ats in zip(b.column("_text").to_pylist(), b.column("ats").to_pylist()):
                raw = t.encode()
                at = np.array(ats or [], np.int64)
                _, lo, hi = merged(np.zeros(len(at), np.int64), at >> 32, (at >> 32) + (at & 0xFFFFFFFF))
                edges = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(raw)]
                size.append(len(raw))
                spans.append([{"start": s, "end": e} for s, e in zip(lo.tolist(), hi.tolist())])
                kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    schema = docs.select(F.col(id_col), F.lit(0).cast("long").alias("n_bytes"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).alias("spans"), F.lit(b"").alias("kept")).schema
    for f in schema.fields[1:]:
        f.nullable = True
    return rows.join(per_doc.hint("shuffle_hash"), "_uid", "left").select("_id", "_text", "ats").mapInArrow(cut, schema)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings, counted and digested."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
