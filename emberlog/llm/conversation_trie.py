"""Prefix trie of conversations by truncation peeling.

A turn becomes a digest of role and text, a conversation the chain of digests of its
prefixes: 16 bytes a turn, and 8 for the length of its text, so texts are not shuffled.
Conversations that are alike meet first. Their paths are sorted over all tasks, so that
each prefix is one range of them. A chunk of a range is peeled: from its greatest depth
upwards, conversations that end at a depth are merged with the nodes that survive there,
the last turn is stripped, and what remains is grouped again, counting as nodes appear.
Nodes on a chunk's first or last path may go on in other chunks; with what they have so
far they are the entries of the next round, a few for each chunk. So a hot first turn
is split like any other range, and no group is gathered.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, written

KEY = 16
ROOT_KEY = bytes(KEY)
#: Entries, and bytes of their paths, that a task holds at once.
CHUNK_ROWS, CHUNK_BYTES = 4_096, 32 << 20
#: Entries that one task takes in the last round.
LAST_ROWS = 1_024
#: Ids of so many successive numbers are joined before they meet; a number of bits.
ID_BITS = 10
#: Open nodes up to this number are broadcast: two numbers each.
BROADCAST_ROWS = 300_000
ENTRY = "path binary, sizes binary, n long, conv_id long, kids long, leaves long, saved long, ends string"
PEELED = f"done boolean, key binary, parent binary, depth long, parent_conv_id long, {ENTRY}"


def turn_lists(conversations: DataFrame, by: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(_by, conv_id long, turns array of (digest, size)): each conversation's turns in order, rows of one _by in one partition.

    Null turns come first, ties in the order of their digests; a null role or text is
    empty; rows without an id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * KEY))
    turn = F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = conversations.where(F.col(id_col).isNotNull()).select((F.col(id_col) if by is None else by).alias("_by"), F.col(id_col).cast("long").alias("conv_id"), turn.alias("turn"))
    lists = rows.repartition("_by").groupBy("_by", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return lists.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))))


def rebuilt(conversations: DataFrame, group: int = 5, modulus: int = 9) -> DataFrame:
    """(conv_id, turns): each conversation c with its first h turns taken from conversation c - c % group.

    h is the unsigned CRC-32 of c's decimals modulo modulus. All turns are taken if
    there are fewer, none if that conversation is absent.
    """
    c = F.col("conv_id").cast("long")
    lists = turn_lists(conversations, by=c - c % group)
    heads = lists.where(F.col("conv_id") == F.col("_by")).select("_by", F.slice("turns", 1, modulus - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    own = F.slice(F.col("turns"), h + 1, F.size("turns"))
    head = F.when(F.col("head").isNull(), F.slice(F.col("turns"), F.lit(1), F.lit(0))).otherwise(F.slice(F.col("head"), F.lit(1), h))
    return lists.join(heads, "_by", "left").select("conv_id", F.concat(head, own).alias("turns"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of turns become digests of prefixes."""
    for b in batches:
        paths, leaves = [], []
        for turns in b.column("digests").to_pylist():
            key, keys = ROOT_KEY, []
            for t in turns:
                key = hashlib.blake2b(key + t, digest_size=KEY).digest()
                keys.append(key)
            paths.append(b"".join(keys))
            leaves.append(key)
        sizes = [np.array(s, "<i8").tobytes() for s in b.column("sizes").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(leaves, pa.binary()), pa.array(paths, pa.binary()), pa.array(sizes, pa.binary())], names=["conv_id", "leaf", "path", "sizes"])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids, sorted by leaf and block, become one entry a leaf; the hash takes one block after the other."""
    now, digest, entry = None, None, None
    done: list[tuple] = []

    def close() -> None:
        done.append((*entry[:4], 0, 0, 0, digest.hexdigest()))

    for b in batches:
        for r in b.to_pylist():
            if r["leaf"] != now:
                if now is not None:
                    close()
                now, digest, entry = r["leaf"], hashlib.sha256(r["ids"].encode()), [r["path"], r["sizes"], r["n"], r["conv_id"]]
            else:
                digest.update(b"," + r["ids"].encode())
                entry[2] += r["n"]
                entry[3] = min(entry[3], r["conv_id"])
        if len(done) >= 256:
            yield _batch(done, ENTRY)
            done = []
    if now is not None:
        close()
    yield _batch(done, ENTRY)


_TYPES = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def peel(entries: list[tuple], closed: bool) -> list[tuple]:
    """The nodes of a chunk of entries in the order of their paths.

    A row that is done is a node with all its figures, but for the smallest member of a
    parent that is not. The others are the entries of the next round: nodes on the first
    or last path, unless closed says that there are no other chunks.
    """
    levels: dict[int, dict[bytes, list]] = defaultdict(dict)

    def add(depth: int, path: bytes, sizes: np.ndarray, n: int, conv: int, kids: int, leaves: int, saved: int, ends: str | None, child: tuple | None) -> None:
        key = path[KEY * (depth - 1) : KEY * depth] if depth else ROOT_KEY
        node = levels[depth].get(key)
        if node is None:
            levels[depth][key] = [path, sizes, n, conv, kids, leaves, saved, ends, [child] if child else []]
            return
        node[2] += n
        node[3] = min(node[3], conv)
        node[4] += kids
        node[5] += leaves
        node[6] += saved
        node[7] = node[7] or ends
        if child:
            node[8].append(child)

    for path, sizes, *rest in entries:
        add(len(path) // KEY, path, np.frombuffer(sizes, "<i8"), *rest, None)
    edges = () if closed else (entries[0][0], entries[-1][0])
    still_open = {p[i : i + KEY] for p in edges for i in range(0, len(p), KEY)} | (set() if closed else {ROOT_KEY})
    out: list[tuple] = []
    for depth in range(max(levels), -1, -1):
        for key, (path, sizes, n, conv, kids, leaves, saved, ends, children) in levels.pop(depth, {}).items():
            goes_on = key in still_open
            for child_key, child_depth, child in children:
                out.append((True, child_key, key if goes_on else None, child_depth, None if goes_on else conv, None, None, *child))
            if goes_on:
                out.append((False, key, None, depth, None, path[: KEY * depth], sizes[:depth].tobytes(), n, conv, kids, leaves, saved, ends))
                continue
            leaves = leaves if kids else 1
            saved += (n - 1) * int(sizes[depth - 1]) if depth else 0
            node = (key, depth, (n, conv, kids, leaves, saved, ends))
            if depth:
                add(depth - 1, path, sizes, n, conv, 1, leaves, saved, None, node)
            else:
                out.append((True, key, None, 0, None, None, None, *node[2]))
    return out


def prefix_trie(lists: DataFrame) -> DataFrame:
    """One row for each distinct prefix of lists(conv_id, turns), the empty one included.

    conv_id is the smallest member, depth the number of turns, parent_conv_id the
    smallest member of the prefix one turn shorter (null for the root); n_convs,
    n_children, n_leaves, saved_tokens (bytes of text that a shared prefix saves) and
    ends_sha256 (members that end here) are those of the node or its subtree.

    Prefixes are equal if 128 bits of their digests are. Conversations without turns end
    at the root; a table without conversations gives no rows. One conversation's digests
    are one row of 24 bytes a turn; its texts may have any length. Repeated conversations
    are counted, not kept: their ids are joined in blocks and hashed as a stream.
    """
    spark = lists.sparkSession
    small_batches(spark)
    parts = lists.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))
    paths = parts.mapInArrow(_chained, "conv_id long, leaf binary, path binary, sizes binary")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = paths.groupBy("leaf", F.shiftright("conv_id", ID_BITS).alias("block")).agg(ids.alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    entries = written(blocks.repartition("leaf").sortWithinPartitions("leaf", "block").mapInArrow(_ended, ENTRY), "trie-entries")
    rounds: list[DataFrame] = []
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0] for f in ENTRY.split(", ")]
    while True:
        rows = entries.count()
        tasks = min(tasks, rows // LAST_ROWS + 1)
        closed = rows <= LAST_ROWS or tasks <= 1

        def run(batches: Iterator[pa.RecordBatch], closed: bool = closed) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size = 0
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in names)):
                    if held and not closed and (len(held) >= CHUNK_ROWS or size + len(row[0]) > CHUNK_BYTES):
                        yield from _split(peel(held, closed))
                        held, size = [], 0
                    held.append(row)
                    size += len(row[0])
            if held:
                yield from _split(peel(held, closed))

        sorted_entries = entries.coalesce(1) if closed else entries.repartitionByRange(tasks, "path")
        found = written(sorted_entries.sortWithinPartitions("path").mapInArrow(run, PEELED), "trie-nodes")
        rounds.append(found.where("done"))
        if closed:
            break
        entries = found.where("not done").groupBy("key").agg(
            F.first("path").alias("path"), F.first("sizes").alias("sizes"), *[F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")], F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends")
        ).select(*names)
        entries = written(entries, "trie-entries")
        tasks //= 2
    nodes = rounds[0]
    for r in rounds[1:]:
        nodes = nodes.union(r)
    if len(rounds) > 1:
        later = rounds[1]
        for r in rounds[2:]:
            later = later.union(r)
        parents = later.select(F.col("key").alias("_parent"), F.col("conv_id").alias("_parent_conv"))
        parents = F.broadcast(parents) if parents.count() <= BROADCAST_ROWS else parents
        nodes = nodes.join(parents, F.col("parent") == F.col("_parent"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent_conv"))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _split(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 4_096):
        yield _batch(rows[i : i + 4_096], PEELED)


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt with turns of another."""
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


_CRC_STEP = "CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END"
OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: {_CRC_STEP})), 4294967295) % 9 AS h
      FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT ids.c, 0 AS part, t.p, role, text FROM ids JOIN t ON t.c = ids.c - ids.c % 5 AND t.p <= h
      UNION ALL SELECT ids.c, 1, t.p, role, text FROM ids JOIN t ON t.c = ids.c AND t.p > h),
q AS (SELECT c, row_number() OVER w AS d, octet_length(encode(text)) AS bytes,
      string_agg(md5(octet_length(encode(role)) || ':' || role || text), '') OVER w AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY part, p)),
m AS (SELECT c, d, bytes, k, substr(k, 1, 32 * (d::BIGINT - 1)) AS parent FROM q UNION ALL SELECT c, 0, 0, '', NULL FROM ids),
e AS (SELECT c, max(d) AS d, max_by(k, d) AS k FROM m GROUP BY c),
ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM e GROUP BY k),
n AS (SELECT k, d, min(c) AS conv_id, any_value(parent) AS parent, count(*) AS n, (count(*) - 1) * any_value(bytes) AS saves FROM m GROUP BY k, d),
kids AS (SELECT parent AS k, count(*) AS n FROM n WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT a.k, sum(b.saves) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
      FROM n a JOIN n b ON starts_with(b.k, a.k) LEFT JOIN kids ON kids.k = b.k GROUP BY a.k)
SELECT n.conv_id::BIGINT AS conv_id, n.d::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, n.n::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
      below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, coalesce(ends.ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n up ON up.k = n.parent AND up.d = n.d - 1 LEFT JOIN kids ON kids.k = n.k LEFT JOIN below ON below.k = n.k LEFT JOIN ends ON ends.k = n.k
"""
