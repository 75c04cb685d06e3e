"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position of a fingerprint gets a nonzero vector of radius + 1 bits. Each
nonzero vector v of radius + 1 bits gives a table, whose mask keeps the positions whose
vector has an odd product with v. Up to radius differing positions leave some v that is
orthogonal to all their vectors; in its table both fingerprints have the same masked
value. So every pair within the radius meets in some table.

Only distinct fingerprints go to the tables, so copies meet before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import connected_components, free_name, joined, small_batches, table, written

#: Members of one bucket that a task holds at once; larger buckets are dealt out again.
BUCKET_ROWS = 65_536
#: A fingerprint that more than one of so many rows have is hot; so there are fewer hot ones than this.
MOST_HOT = 10_000


def covering_masks(bits: int, radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over bits positions."""
    n = 1 << (radius + 1)
    of = [1 + i % (n - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(of) if (m & v).bit_count() & 1) for v in range(1, n)]


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and \\t to \\r, with A-Z lower-cased, as UTF-8."""
    return (text or "").encode().lower().split()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle of size words, repeats included; fewer words are one shingle."""
    import xxhash

    w = words(text)
    if not w:
        return np.empty(0, "<u8")
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)))) if len(w) >= size else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), "<u8")


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(np.ascontiguousarray(hashes[i : i + 65_536]).view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long): the 64-bit SimHash of every whole text, as a signed number; 0 for a null text or one without words."""
    small_batches(docs.sparkSession)
    schema = docs.select(F.col(id_col), F.lit(0).cast("long").alias("fp")).schema
    schema["fp"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([majority(shingle_hashes(t, size)) for t in b.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, dict[str, np.ndarray], bool, bool]]:
    """Runs of equal (t, key) of sorted batches: key, columns, whether it is a part of a larger run, whether it is the first part."""
    held: list[dict] = []
    key, begun = None, False
    for b in batches:
        cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        if not b.num_rows:
            continue
        cuts = np.flatnonzero((np.diff(cols["t"]) != 0) | (np.diff(cols["key"]) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            new = (cols["t"][lo], cols["key"][lo])
            if held and new != key:
                yield key, {n: np.concatenate([h[n] for h in held]) for n in held[0]}, begun, not begun
                held, begun = [], False
            elif held and sum(len(h["t"]) for h in held) >= most:
                yield key, {n: np.concatenate([h[n] for h in held]) for n in held[0]}, True, not begun
                held, begun = [], True
            key = new
            held.append({n: c[lo:hi] for n, c in cols.items()})
    if held:
        yield key, {n: np.concatenate([h[n] for h in held]) for n in held[0]}, begun, not begun


def _midpoints(fps: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Each fingerprint and all that differ from it in one of the free bits; rows are fingerprints."""
    return np.concatenate([fps[:, None], fps[:, None] ^ free[None, :]], axis=1)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n reaches over links a-b."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label = label[label]
        if (label == before).all():
            return label


def links_within_two(fps: DataFrame) -> DataFrame:
    """Links (a, b) that span, within each group of distinct fp values, all that differ in at most 2 bits.

    A bucket of a covering table that a task can hold is solved there: two values of it
    are within 2 bits if and only if they, or values one free bit away, are equal, which
    a sort finds without comparing pairs. A larger bucket is dealt out by those
    midpoints, at most 65 rows to each; so no bucket is too large and none is cut.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(64, 2)]
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
    dealt = fps.select("fp", tables.alias("x")).select(F.col("x.t").alias("t"), F.col("x.key").alias("key"), "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    free = [np.array([1 << i for i in range(64) if not (m >> i) & 1], np.uint64) for m in covering_masks(64, 2)]
    most = BUCKET_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, over = [], [], []

        def out() -> pa.RecordBatch:
            rest = [np.concatenate(x) if x else np.empty(0, "<i8") for x in (a, b, over)]
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([rest[0], rest[2]])), pa.array(np.concatenate([rest[1], rest[2]]))], names=["a", "b"])
            a.clear(), b.clear(), over.clear()
            return batch

        for (t, _), cols, part, _first in _groups(batches, most):
            own = cols["fp"]
            if part or len(own) >= most:
                over.append(own)
                yield out()
            elif len(own) > 1:
                x = np.ascontiguousarray(own).view("<u8")
                keys = _midpoints(x, free[t])
                owner = np.repeat(np.arange(len(x)), keys.shape[1])
                order = np.argsort(keys.ravel(), kind="stable")
                same = np.flatnonzero(np.diff(keys.ravel()[order].view("<i8")) == 0)
                if len(same):
                    label = _spanning(len(x), owner[order[same]], owner[order[same + 1]])
                    far = np.flatnonzero(label != np.arange(len(x)))
                    a.append(own[far]), b.append(own[label[far]])
            if len(a) >= 10_000:
                yield out()
        yield out()

    found = dealt.mapInArrow(run, "a long, b long").checkpoint()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i)) for i in range(64)])
    points = found.where("a = b").select(F.col("a").alias("fp")).distinct().select("fp", F.explode(flips).alias("point"))
    stars = points.groupBy("point").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return found.where("a <> b").union(stars.select(F.explode("fps").alias("a"), "b").where("a <> b")).distinct()


def simhash_components(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long, component_id): texts whose fingerprints differ in at most 2 bits are linked.

    component_id is the smallest id reachable over links, the document's own included.
    Rows are kept as they are: repeated ids give repeated rows. A null text, or one
    without words, has fingerprint 0 and is linked by it; a null id is never a
    component's name unless all its ids are null. An empty table gives an empty table.
    """
    fps = written(fingerprints(docs, size, id_col, text_col), "simhash")
    groups = fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    comps = connected_components(links_within_two(groups.select("fp"))).checkpoint()
    placed = groups.join(comps, groups["fp"] == comps["node"], "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("component"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = written(placed.join(names, "component").select("fp", "component_id", "n"), "simhash-components")
    # Copies, and texts without words, share a fingerprint that a third of all rows may have; such ones go to all tasks.
    total = of_fp.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * MOST_HOT > total
    hot = F.broadcast(of_fp.where(is_hot).drop("n"))
    by_hot = fps.join(hot, "fp")
    by_fp = fps.join(hot.select("fp"), "fp", "left_anti").join(of_fp.where(~is_hot).drop("n"), "fp")
    return by_hot.union(by_fp.select(by_hot.columns)).select(id_col, "fp", "component_id")


# Near-duplicates at a similarity of 0.8 and more.


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group of linked texts, the row with the smallest id stays.

    The columns and the rows that stay are not changed. Texts are linked if their sets of
    five-word shingles have a Jaccard similarity of 0.8 or more; a group is what such links
    join. Pairs are found by covering tables of the sets' SimHash, and, since no radius that
    tables can cover reaches 0.8, by common shingles of their prefixes as well; each is
    confirmed by the whole sets, see jaccard.py. Texts of fewer words are one shingle.
    Texts without words, null ones included, are one group. A null id comes after
    all others; of rows that are alike in id and text one stays. An empty table gives
    an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # A row's key is made of its id and content, so that a second reading finds it again.
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = [F.xxhash64(text), F.xxhash64(F.lit(7), text, F.length(text))]
    keys = ["_k0", "_k1", "_k2"]
    keyed = docs.select(F.col(id_col).alias("_k0"), content[0].alias("_k1"), content[1].alias("_k2"), text.alias("_text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        memo = jaccard.WordHashes()
        for b in batches:
            yield [jaccard.shingle_set(words(t), memo) for t in b.column("_text").to_pylist()]

    order = spark.sparkContext.broadcast(jaccard.common_shingles(keyed.select("_text"), sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = jaccard.WordHashes()
        seen: set[int] = set()  # sets that this task has sent on; a set that is sent again does no harm
        for b in batches:
            own = [jaccard.shingle_set(words(t), memo) for t in b.column("_text").to_pylist()]
            ids = [jaccard.set_id(x) for x in own]
            if len(seen) > 1_000_000:
                seen.clear()
            new = [not (i in seen or seen.add(i)) for i in ids]
            first = [jaccard.prefix(x, *order.value).view("<i8") if n else np.empty(0, "<i8") for x, n in zip(own, new)]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            prefixes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "<i8"), *first])))
            fp = pa.array([np.uint64(majority(x)).view(np.int64) if n else None for x, n in zip(own, new)], pa.int64())
            bins = pa.array([jaccard.sketch(x) if n else None for x, n in zip(own, new)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(ids, pa.int64()), pa.array([len(x) for x in own], pa.int64()), fp, bins, prefixes], names=[*keys, "id", "size", "fp", "bins", "prefix"])

    long = F.lit(0).cast("long")
    schema = keyed.select(*keys, long.alias("id"), long.alias("size"), long.alias("fp"), F.lit(b"").alias("bins"), F.array(long).alias("prefix")).schema
    for f in schema.fields[len(keys) :]:
        f.nullable = True
    rows = written(keyed.mapInArrow(run, schema), "near-rows")
    first = F.min(F.struct(F.col("_k0").isNull().alias("z"), *keys)).alias("least")
    nodes = written(rows.groupBy("id").agg(first), "near-nodes")

    repeats = rows.groupBy(*keys).count().where("count > 1")
    again = not repeats.isEmpty()

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, shingles) of ids, from the text of one row of each."""
        wanted = written(nodes.join(ids, "id").select("id", *[F.col(f"least.{k}").alias(f"_w{k}") for k in keys]), "near-wanted")
        few = wanted.count() <= 300_000

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = jaccard.WordHashes()
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([jaccard.shingle_set(words(t), memo).tobytes() for t in b.column("_text").to_pylist()], pa.binary())], names=["id", "shingles"])

        same = [F.col(k).eqNullSafe(F.col(f"_w{k}")) for k in keys]
        texts = keyed.join(F.broadcast(wanted) if few else wanted, [same[0], F.col("_k1") == F.col("_w_k1"), F.col("_k2") == F.col("_w_k2")]).select("id", "_text")
        texts = texts.groupBy("id").agg(F.first("_text").alias("_text")) if again else texts
        return written(texts.mapInArrow(one, "id long, shingles binary"), "near-sets")

    sketches = rows.where("bins is not null").select("id", "size", "fp", "bins")
    # Texts that share a fingerprint go with the least of them, and this one with those of fingerprints that are near.
    of_fp = written(sketches.groupBy("fp").agg(F.min("id").alias("lead")), "near-fps")
    near = links_within_two(of_fp.select("fp"))
    far = near.join(of_fp.select(F.col("fp").alias("a"), F.col("lead").alias("ia")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("lead").alias("ib")), "b").select("ia", "ib")
    alike = sketches.join(of_fp, "fp").where("id <> lead").select("id", "lead").union(far).toDF("a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    once = sketches.select("id", "size", "bins")
    if rows.rdd.getNumPartitions() > 1:  # two tasks may have sent the same set
        once = once.groupBy("id").agg(F.first("size").alias("size"), F.first("bins").alias("bins"))
    once = written(once, "near-sketches")

    entries = rows.select("id", "size", F.posexplode("prefix").alias("pos", "key")).select("key", "id", (F.shiftleft("size", 32) + F.col("pos")).alias("at"))
    comps = joined(jaccard.similar_links(entries, once, sets_of, alike))
    placed = nodes.join(comps, nodes["id"] == comps["node"], "left").groupBy(F.coalesce("component", "id")).agg(F.min("least").alias("least"))
    kept = placed.select("least.*").drop("z")
    gone = written(rows.select(*keys).join(kept, [rows[k].eqNullSafe(kept[k]) for k in keys], "left_anti").distinct(), "near-gone")
    # Bounded by a count: 24 bytes a key.
    small = gone.count() <= 300_000
    k1, k2 = free_name(docs, "_k1"), free_name(docs, "_k2")
    found = docs.withColumns({k1: F.xxhash64(text), k2: F.xxhash64(F.lit(7), text, F.length(text))})
    other = (F.broadcast(gone) if small else gone).select(*[F.col(k).alias(f"_g{k}") for k in keys])
    stays = found.join(other, found[id_col].eqNullSafe(other["_g_k0"]) & (found[k1] == other["_g_k1"]) & (found[k2] == other["_g_k2"]), "left_anti")
    repeated = repeats.select(*[F.col(k).alias(f"_g{k}") for k in keys])
    if not again:
        return stays.drop(k1, k2)
    match = stays[id_col].eqNullSafe(repeated["_g_k0"]) & (stays[k1] == repeated["_g_k1"]) & (stays[k2] == repeated["_g_k2"])
    ones = stays.join(repeated, match, "left_anti")
    return ones.union(stays.join(repeated, match, "left_semi").dropDuplicates([id_col, k1, k2])).drop(k1, k2)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
