"""Groups of spelling variants: words that differ by one code point.

Two words within one edit have equal beginnings or equal ends of half their length. So each
word goes, for either half and for its length as that of the shorter or the longer word,
to the words that share the half; large groups are dealt again by half of what is left.
In a group the rest of the words is a sorted list. Edit-matrix rows, three cells wide, are
kept for each prefix that neighbours in the list share, so words with a common prefix
(their LCP with the word before) reuse its rows, and the range of words behind a prefix is
skipped once every cell of the row exceeds one edit. All words of a group are searched
in step, a row for each word and prefix, in NumPy.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, written

#: Groups of more words are dealt again, unless one code point is left to differ.
GROUP_WORDS = 8_192
#: Words and code points that are searched together, and words that search at once.
BATCH_WORDS, BATCH_CELLS, BLOCK = 65_536, 4 << 20, 8_192
#: Distinct words that a task counts before it sends them on; code points of a text read at a time.
COUNTED, PIECE = 500_000, 1 << 20
#: Rows up to which one side of a join is broadcast: a word and two numbers each.
BROADCAST_ROWS = 300_000
RUN = re.compile("[A-Za-zÀ-ÿ]+")
NO_RUN = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
FAR = 2


def runs_of(text: str) -> Counter:
    """Runs of letters of a whole text, with A-Z lower-cased, and how often each occurs."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        stop = NO_RUN.search(text, min(at + PIECE, len(text)))
        end = stop.start() if stop else len(text)
        found.update(RUN.findall(text, at, end))
        at = end + 1
    out: Counter = Counter()
    for run, n in found.items():
        out[run.translate(_LOWER)] += n
    return out


def word_of(doc_id: object, run: str, modulus: int = 97) -> str:
    """run, without one code point if modulus divides the hash of document and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % modulus:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n long): distinct words of whole texts with at least so many code points and occurrences.

    Null and empty texts have no words; a null id is written as nothing. Repeated rows count again.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for run, n in runs_of(text or "").items():
                    held[word_of(doc, run)] += n
                if len(held) >= COUNTED:
                    yield out()
        yield out()

    words = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(count, "word string, n long").where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# Groups. A window [lo, hi) of a word of length short, or of one more, is what may differ; the code points before and behind it are shared.


def _row(short: Column, lo: Column, hi: Column) -> Column:
    more = F.length("word") - short
    front, back = F.substring("word", F.lit(1), lo), F.substring("word", hi + more + 1, short - hi)
    shared = F.concat_ws("|", short.cast("string"), lo.cast("string"), hi.cast("string"), front, back)
    group = F.when(F.length(shared) <= 80, shared).otherwise(F.sha2(shared.cast("binary"), 256))
    return F.struct(group.alias("group"), short.alias("short"), lo.alias("lo"), hi.alias("hi"), more.alias("more"), F.substring("word", lo + 1, hi - lo + more).alias("rest"))


def _halves(short: Column, lo: Column, hi: Column) -> Column:
    """Rows for the two halves of a window: the later one with the earlier shared, and the other way round."""
    mid = lo + F.floor((hi - lo) / 2).cast("int")
    return F.array(_row(short, mid, hi), _row(short, lo, mid))


def dealt(words: DataFrame) -> DataFrame:
    """(word, n, group, short, lo, hi, more, rest): every word in each group that it shares a half with."""
    length = F.length("word")
    zero = F.lit(0)
    first = F.array(*[F.struct((length - m).alias("short")) for m in (0, 1)])
    rows = words.select("word", "n", F.explode(first).alias("s")).where("s.short > 0").select("word", "n", F.explode(_halves(F.col("s.short"), zero, F.col("s.short"))).alias("x")).select("word", "n", "x.*").where("hi > lo")
    out = None
    while True:
        large = written(rows.where("hi - lo > 1").groupBy("group").count().where(F.col("count") > GROUP_WORDS).select("group"), "spelling-large")
        n = large.count()
        if not n:
            return rows if out is None else out.union(rows)
        large = F.broadcast(large) if n <= BROADCAST_ROWS else large
        rest = rows.join(large, "group", "left_anti").select(rows.columns)
        out = rest if out is None else out.union(rest)
        again = rows.join(large, "group", "left_semi").select("word", "n", F.explode(_halves(F.col("short"), F.col("lo"), F.col("hi"))).alias("x")).select("word", "n", "x.*").where("hi > lo")
        rows = written(again, "spelling-again")


# The search in groups.


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each string and zeros behind it, and lengths."""
    lengths = np.array([len(s) for s in strings], np.int64)
    width = int(lengths.max(initial=0)) + 3
    out = np.zeros((len(strings), width), np.uint32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4")
    out[np.repeat(np.arange(len(strings)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out, lengths


def neighbours(group: np.ndarray, rest: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), in both directions, of one group whose rests are one edit apart.

    The list is sorted by group and rest, and no rest occurs twice in a group.
    """
    codes, length = _codes(rest)
    n = len(rest)
    # The longest common prefix of each word with the one before; -1 where a group begins.
    lcp = np.full(n, -1)
    if n > 1:
        differ = codes[1:] != codes[:-1]
        lcp[1:] = np.where(group[1:] == group[:-1], np.where(differ.any(1), differ.argmax(1), codes.shape[1]), -1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, n, BLOCK):
        found += _search(codes, length, lcp, np.arange(lo, min(lo + BLOCK, n)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _search(codes: np.ndarray, length: np.ndarray, lcp: np.ndarray, query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the given words with all of their groups."""
    out = []
    starts = np.flatnonzero(lcp < 0)  # where the words of each prefix of this depth begin
    node = np.searchsorted(starts, query, "right") - 1
    # A row's cells: edits to turn a prefix of depth code points into one less, as many and one more of the word.
    cells = np.tile(np.array([FAR, 0, 1], np.uint8), (len(query), 1))
    depth = 0
    while len(query):
        below = np.flatnonzero((lcp <= depth) & (length > depth))
        parent = np.searchsorted(starts, below, "right") - 1
        letter = codes[below, depth].astype(np.int64)
        key = parent << 21 | letter
        exact = cells.min(1) == 0
        # With an edit to spare, every longer prefix is tried; without one, those that go on with the word's own code points.
        q, at = query[exact], node[exact]
        first, last = np.searchsorted(parent, at, "left"), np.searchsorted(parent, at, "right")
        width = last - first
        child = np.repeat(first - np.cumsum(width) + width, width) + np.arange(width.sum())
        pairs = [(np.repeat(q, width), child, np.repeat(cells[exact], width, axis=0))]
        q, at, left = query[~exact], node[~exact], cells[~exact]
        tried: list[np.ndarray] = []
        for shift in (-1, 0, 1):
            i = depth + shift
            want = codes[q, i].astype(np.int64) if 0 <= i < codes.shape[1] else np.zeros(len(q), np.int64)
            usable = (left[:, shift + 1] <= 1) & (want > 0)
            for other in tried:
                usable &= other != want
            tried.append(np.where(usable, want, -1))
            wanted = at << 21 | want
            place = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            hit = usable & (key[place] == wanted) if len(key) else np.zeros(len(q), bool)
            pairs.append((q[hit], place[hit], left[hit]))
        query = np.concatenate([p[0] for p in pairs])
        child = np.concatenate([p[1] for p in pairs])
        old = np.concatenate([p[2] for p in pairs])
        if not len(query):
            break
        c = letter[child]
        other = [codes[query, depth + s] != c if 0 <= depth + s < codes.shape[1] else np.ones(len(query), bool) for s in (-1, 0, 1)]
        new = np.empty_like(old)
        new[:, 0] = np.minimum(old[:, 0] + other[0], old[:, 1] + 1)
        new[:, 1] = np.minimum(np.minimum(old[:, 1] + other[1], old[:, 2] + 1), new[:, 0] + 1)
        new[:, 2] = np.minimum(old[:, 2] + other[2], new[:, 1] + 1)
        alive = new.min(1) <= 1
        query, child, cells = query[alive], child[alive], new[alive]
        depth += 1
        starts, node = below, child
        # The first word of a prefix's range is the prefix itself if it is no longer.
        word = below[child]
        gap = length[query] - depth
        at_end = (length[word] == depth) & (np.abs(gap) <= 1)
        at_end[at_end] = cells[at_end, gap[at_end] + 1] == 1
        out.append((query[at_end], word[at_end]))
    return out


def near_in(rows: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the words of whole groups, sorted by group and rest."""
    names = rows.column("group").to_pylist()
    group = np.cumsum([a != b for a, b in zip(names, [None, *names])])
    i, j = neighbours(group, rows.column("rest").to_pylist())
    more, n = rows.column("more").to_numpy(), rows.column("n").to_numpy()
    # Two longer words meet where they are the shorter ones.
    keep = (more[i] == 0) | (more[j] == 0)
    i, j = i[keep], j[keep]
    # Where the code points behind the window are shared, pairs that also share those up to its end have met in another group.
    words = rows.column("word").to_pylist()
    short, hi = rows.column("short").to_numpy(), rows.column("hi").to_numpy()
    first = np.array([hi[a] == short[a] or words[a][: hi[a]] != words[b][: hi[a]] for a, b in zip(i, j)], bool)
    i, j = i[first], j[first]
    rank = pc.rank(rows.column("word"), sort_keys="ascending", tiebreaker="dense").to_numpy()
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    begin = np.flatnonzero(np.diff(i, prepend=-1))
    counts = np.diff(np.append(begin, len(i)))
    own, best = i[begin], j[begin]
    return pa.RecordBatch.from_arrays([pa.array([words[x] for x in own], pa.string()), pa.array(counts, pa.int64()), pa.array(n[best], pa.int64()), pa.array([words[x] for x in best], pa.string())], names=["word", "n_near", "best_n", "best"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """near_in() over batches, cut where a group ends."""
    held: list[pa.RecordBatch] = []
    size = cells = 0

    def split(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, cells
        if not held:
            return
        rows = pa.Table.from_batches(held)
        names = rows.column("group")
        cut = rows.num_rows
        if not last:  # the last group may go on
            end = names[cut - 1].as_py()
            same = pc.index(names, pa.scalar(end, names.type)).as_py()
            cut = same
        if cut:
            yield near_in(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
        size, cells = rows.num_rows - cut, 0

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        cells += b.column("rest").nbytes
        if size >= BATCH_WORDS or cells >= BATCH_CELLS:
            yield from split(False)
    yield from split(True)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the last one that is reached by following forms(word, form)."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        wanted = now.select(F.col("root").alias("_at")).distinct()
        jumps = written(now.join(wanted, now["word"] == wanted["_at"]).select("_at", F.col("root").alias("_next")), "spelling-jumps")
        n = jumps.count()
        if not n:
            return now
        jumps = F.broadcast(jumps) if n <= BROADCAST_ROWS else jumps
        now = written(now.join(jumps, now["root"] == jumps["_at"], "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of words(word, n), which are distinct.

    Near words differ by one inserted, deleted or replaced code point. form is the near word
    of largest n (ties: the smallest in code-point order) if its n is ratio times the
    word's or more; root is where forms lead at last, the word itself without one. An empty table gives an empty
    table. A null word is left out; words of any length are compared whole.
    """
    spark = words.sparkSession
    small_batches(spark)
    words = written(words.where("word is not null").select("word", "n"), "spelling-words")
    found = dealt(words).select("group", "word", "n", "short", "hi", "more", "rest").repartition("group").sortWithinPartitions("group", "rest").mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("best")))
    near = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")), "spelling-near")
    has = -F.col("x.least") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("x.best")).alias("form"), F.when(has, -F.col("x.least")).alias("form_n"))
    joined = written(joined, "spelling-forms")
    to = roots(joined.where("form is not null")).withColumnRenamed("word", "_word")
    return joined.join(to, joined["word"] == to["_word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents."""
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents")))


_CRC = "CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END"
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM d GROUP BY ALL),
tab AS MATERIALIZED (SELECT list(x ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: {_CRC}) AS x FROM (SELECT unnest(range(256)) AS b))),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc || ':' || run, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))),
      lambda crc, b: xor(crc >> 8, tab[1 + (xor(crc, b) & 255)])), 4294967295) AS h FROM r, tab),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, 2 + (h % length(run))::BIGINT) ELSE run END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM w GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (SELECT DISTINCT a, an, b, bn FROM (
  SELECT p.word AS a, p.n AS an, q.word AS b, q.n AS bn FROM x p JOIN x q ON p.less = q.less AND p.i = q.i AND p.word <> q.word
  UNION ALL SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON v.word = x.less
  UNION ALL SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON v.word = x.less)),
best AS (SELECT a, count(*) AS n_near, any_value(an) AS an, arg_min(b, (-bn, b)) AS b, max(bn) AS bn FROM near GROUP BY a),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 2 * v.n THEN b END AS form, CASE WHEN bn >= 2 * v.n THEN bn END AS form_n FROM v LEFT JOIN best ON best.a = v.word),
walk AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""
