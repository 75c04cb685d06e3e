"""Approximate nearest neighbours by stable projections and a kd-tree.

A component that makes all vectors equally long turns the largest inner product into the
smallest distance. Vectors are projected on a few Gaussian directions; the squared
projected distance of two vectors, over their squared distance, has a chi-square
distribution. A kd-tree of the projections, split by a bounded sample, deals all rows to
cells. In a block of a cell a query takes the vectors nearest in projection, ring by ring, and
verifies each by its product; it stops when the next ones, if they were nearer than the
k-th found, would be that far with little probability. Vectors behind that are not
multiplied. Its own cell gives the first bound, which chooses the other cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .vectors import blocks, rows_of, unpack, usual_size, valid

DIRECTIONS = 32
#: Chance that a true neighbour is within the projected radius at which a query stops.
SURE = 0.9
#: Vectors of a block that a query verifies first; each further ring is twice as large.
FIRST_RING = 64
#: The bound of the sample that the tree is split by, and of its cells.
SAMPLE_ROWS, MOST_CELLS, CELL_ROWS = 20_000, 2_048, 1_024
BLOCK_ROWS, QUERY_ROWS = 2_048, 512
#: Rows of a cell that are dealt to one place; a larger cell, such as one of many copies, is dealt to several.
SHARD_ROWS = 65_536
#: Queries whose bound a task remembers.
MOST_REACHED = 500_000


def chi_square_quantile(p: float, freedom: int) -> float:
    """For an even number of degrees of freedom."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def kd_splits(points: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Inner nodes (axis, value, left, right) of a tree split at medians of the widest axis; a negative child -c - 1 is cell c."""
    nodes: list = []
    n_cells = 0

    def grow(p: np.ndarray, want: int) -> int:
        nonlocal n_cells
        axis = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
        value = float(np.median(p[:, axis])) if len(p) else 0.0
        left = p[:, axis] <= value if len(p) else np.zeros(0, bool)
        if want <= 1 or len(p) < 2 or left.all():
            n_cells += 1
            return -n_cells
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (axis, value, grow(p[left], want // 2), grow(p[~left], want - want // 2))
        return at

    root = grow(points, cells)
    return nodes if root == 0 else []


def cell_of(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    todo = [(0, np.arange(len(points)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out[rows] = -at - 1
        elif len(rows):
            axis, value, a, b = nodes[at]
            left = points[rows, axis] <= value
            todo += [(a, rows[left]), (b, rows[~left])]
    return out


def top_of_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of the k highest finite scores of each row; of those that are alike but for rounding the first columns."""
    if scores.shape[1] > k:
        cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        margin = 1e-12 * np.maximum(1.0, np.abs(np.where(np.isfinite(cut), cut, 0.0)))
        above, tied = scores > cut + margin, np.abs(scores - np.where(np.isfinite(cut), cut, np.nan)) <= margin
        pick = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(1)[:, None]))
        pick = np.where(np.isfinite(cut), pick, np.isfinite(scores))
    else:
        pick = np.isfinite(scores)
    return np.nonzero(pick)


def verified(q: np.ndarray, other: np.ndarray, mat: np.ndarray, between: np.ndarray, far: float, longest: float, limit: float, slack: float, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Vectors of a block that a query has verified, their products, and the squared distance of the k-th best so far.

    between has the squared projected distances, other tells which rows are candidates, far is
    the distance that is to be bettered. Rows are taken by projected distance until the next
    is beyond limit times the k-th distance.
    """
    order = np.flatnonzero(other)
    order = order[np.argsort(between[order], kind="stable")]
    near = between[order]
    square = float(q @ q)
    taken: list[np.ndarray] = []
    dots: list[np.ndarray] = []
    best = np.empty(0)
    at, ring = 0, FIRST_RING
    while at < len(order):
        stop = min(at + ring, int(np.searchsorted(near, (far + slack) * limit, "right")))
        if stop <= at:
            break
        rows = order[at:stop]
        taken.append(rows)
        dots.append(mat[rows] @ q)
        best = np.concatenate([best, np.maximum(0.0, longest + square - 2 * dots[-1])])
        if len(best) >= k:
            best = np.partition(best, k - 1)[:k]
            far = min(far, float(best[k - 1]))
        at, ring = stop, 2 * ring
    if not taken:
        return np.empty(0, np.int64), np.empty(0), far
    return np.concatenate(taken), np.concatenate(dots), far


def nearest(queries: DataFrame, base: DataFrame, k: int = 20, sure: float = SURE, directions: int = DIRECTIONS, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 11, products=None) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest inner products of each query with other rows of base.

    score is the product of the original vectors in doubles. queries must be rows of
    base. Rows of the query's own id are no candidates; ties go to smaller ids; if
    there are fewer candidates, all are found. products is an accumulator that counts
    the products made, if it is given. Vectors that are null or zero, hold null
    or non-finite components, or have another number of components than most, take no
    part, nor do null ids. Other columns are ignored. An empty table gives an empty one.
    """
    spark = base.sparkSession
    small_batches(spark)
    dim = usual_size(base, vec_col)

    def usable(df: DataFrame) -> DataFrame:
        return valid(df, dim, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))

    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    rows = usable(base)
    total, longest = rows.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0))).first()
    axes = np.random.default_rng(seed).normal(size=(dim + 1, directions))

    def project(mat: np.ndarray, lift: bool = True) -> np.ndarray:
        last = np.sqrt(np.maximum(0.0, longest - (mat * mat).sum(1))) if lift else np.zeros(len(mat))
        return mat @ axes[:-1] + last[:, None] * axes[-1]

    sample = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE_ROWS).toArrow()
    seen = np.array(sample.column("vec").to_pylist(), np.float64).reshape(sample.num_rows, dim)
    nodes = kd_splits(project(seen), min(MOST_CELLS, -(-total // CELL_ROWS), max(1, len(seen) // 8)))

    def deal(lift: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = cell_of(project(rows_of(b, "vec", dim), lift), nodes) if b.num_rows else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), b.column("id"), b.column("vec")], names=["cell", "id", "vec"])

        return run

    with_cell = "cell int, id long, vec array<double>"

    def box(lift: bool):
        def run(mat: np.ndarray) -> np.ndarray:
            p = project(mat, lift)
            return np.concatenate([p.min(0), p.max(0)])

        return run

    order = [F.col("cell"), F.col("id")]

    def dealt(df: DataFrame, lift: bool) -> tuple[DataFrame, list]:
        """Rows with their cell, and what they are dealt by, so that a cell's blocks are full however many tasks there are."""
        found = df.mapInArrow(deal(lift), with_cell)
        large = found.groupBy("cell").count().where(F.col("count") > SHARD_ROWS).collect()  # at most MOST_CELLS rows
        pairs = [F.lit(x) for r in large for x in (r["cell"], -(-r["count"] // SHARD_ROWS))]
        shards = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("cell")), F.lit(1)) if pairs else F.lit(1)
        return found, [F.col("cell"), F.pmod(F.xxhash64("id"), shards)]

    placed, by = dealt(rows, True)
    index = written(blocks(placed, dim, BLOCK_ROWS, order, box(True), by), "ann-index")
    placed, by = dealt(usable(queries), False)
    asked = blocks(placed, dim, QUERY_ROWS, order, box(False), by)
    limit = chi_square_quantile(sure, directions)
    slack = 1e-9 * max(longest, 1e-300)

    def count(n: int) -> None:
        if products is not None:
            products.add(n)

    def in_block(ids: np.ndarray, mat: np.ndarray, q_ids: np.ndarray, q: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        """For each query of a block: its place, what it has verified, the products, and its k-th distance."""
        asked_at, points = project(q, False), project(mat)
        between = np.maximum(0.0, (asked_at**2).sum(1)[:, None] + (points**2).sum(1) - 2 * asked_at @ points.T)
        for i in range(len(q)):
            rows, dots, most = verified(q[i], ids != q_ids[i], mat, between[i], float(far[i]), longest, limit, slack, k)
            count(len(rows))
            yield i, rows, dots, most

    def best_of(rows: np.ndarray, dots: np.ndarray, q: np.ndarray, mat: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Of the verified vectors those within a distance, at most k, smaller ids first, with their products."""
        by_id = np.argsort(rows)
        rows, dots = rows[by_id], dots[by_id]
        near = longest + float(q @ q) - 2 * dots <= most + slack
        rows = rows[near][top_of_rows(dots[near][None, :], k)[1]]
        # One way of summing for all, so that equal vectors have equal scores.
        return rows, (mat[rows] * q).sum(1)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block of queries with what they have found in one block of their cell, and the squared distances of the k-th."""
        for b in batches:
            for r in b.to_pylist():
                ids, mat = np.frombuffer(r["hids"] or b"", "<i8"), unpack(r["hmat"] or b"", dim)
                q_ids, q = np.frombuffer(r["ids"], "<i8"), unpack(r["mat"], dim)
                far, hits = np.full(len(q), np.inf), []
                for i, rows, dots, far[i] in in_block(ids, mat, q_ids, q, np.full(len(q), np.inf)):
                    rows, score = best_of(rows, dots, q[i], mat, far[i])
                    hits.append(np.stack([np.full(len(rows), q_ids[i]), ids[rows], score.astype("<f8").view("<i8")]).astype("<i8"))
                packed = np.concatenate([np.empty((3, 0), "<i8"), *hits], 1).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c]], t) for c, t in (("part", pa.int64()), ("cell", pa.int32()), ("ids", pa.binary()), ("mat", pa.binary()), ("extra", pa.binary()))] + [pa.array([far.astype("<f8").tobytes()]), pa.array([float(far.max())], pa.float64()), pa.array([r["home"]], pa.int64()), pa.array([packed], pa.binary())],
                    names=["qpart", "qcell", "qids", "qmat", "qbox", "far", "most", "home", "hits"],
                )

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("hits").to_pylist():
                qid, vid, score = np.frombuffer(raw, "<i8").reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(vid), pa.array(np.ascontiguousarray(score).view("<f8"))], names=["query_id", "vec_id", "score"])

    home = index.groupBy("cell").agg(F.min("part").alias("part")).join(index, ["cell", "part"]).select("cell", F.col("part").alias("home"), F.col("ids").alias("hids"), F.col("mat").alias("hmat"))
    known = written(asked.join(home, "cell", "left").mapInArrow(bound, "qpart long, qcell int, qids binary, qmat binary, qbox binary, far binary, most double, home long, hits binary"), "ann-queries")

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.frombuffer(b"".join(b.column("box").to_pylist()), "<f8").reshape(-1, 2, directions)
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("most"), *(pa.array(np.ascontiguousarray(ends[:, s, i])) for s in (0, 1) for i in range(directions))], names=["cell", "most", *lows, *highs])

    lows, highs = [f"lo{i}" for i in range(directions)], [f"hi{i}" for i in range(directions)]
    box_schema = "cell int, most double, " + ", ".join(f"{c} double" for c in [*lows, *highs])

    def cells(df: DataFrame, mark: str) -> DataFrame:
        got = df.mapInArrow(boxes, box_schema).groupBy("cell").agg(F.max("most").alias("most"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
        return got.select(*[F.col(c).alias(mark + c) for c in got.columns])

    a = cells(known.select(F.col("qcell").alias("cell"), "most", F.col("qbox").alias("box")), "q_")
    b = cells(index.select("cell", F.lit(0.0).alias("most"), F.col("extra").alias("box")), "b_")
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"q_{lo}") - F.col(f"b_{hi}"), F.col(f"b_{lo}") - F.col(f"q_{hi}")), F.lit(2.0)) for lo, hi in zip(lows, highs)), F.lit(0.0))
    # At most MOST_CELLS rows on either side.
    pairs = a.join(F.broadcast(b), (F.col("q_cell") == F.col("b_cell")) | (gap <= (F.col("q_most") + slack) * limit)).select(F.col("q_cell").alias("qcell"), F.col("b_cell").alias("cell"))
    work = known.join(pairs, "qcell").join(index.select("cell", "part", "ids", "mat", "extra"), "cell").where(~F.col("part").eqNullSafe(F.col("home"))).select("qids", "qmat", "far", "ids", "mat", "extra")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, float] = {}  # the k-th distance that this task has found for a query in one block
        for batch in batches:
            if len(reached) > MOST_REACHED:
                reached.clear()
            for r in batch.to_pylist():
                ids, mat = np.frombuffer(r["ids"], "<i8"), unpack(r["mat"], dim)
                q_ids, q_mat, far = np.frombuffer(r["qids"], "<i8"), unpack(r["qmat"], dim), np.frombuffer(r["far"], "<f8")
                lo, hi = np.frombuffer(r["extra"], "<f8").reshape(2, directions)
                asked_at = project(q_mat, False)
                edge = (np.maximum(0.0, np.maximum(lo - asked_at, asked_at - hi)) ** 2).sum(1)
                start = np.minimum(far, [reached.get(i, np.inf) for i in q_ids.tolist()])
                asks = np.flatnonzero(edge <= (start + slack) * limit)
                qid, vid, score = [], [], []
                for i, rows, dots, most in in_block(ids, mat, q_ids[asks], q_mat[asks], start[asks]):
                    at = asks[i]
                    if most < reached.get(int(q_ids[at]), np.inf):
                        reached[int(q_ids[at])] = most
                    rows, own = best_of(rows, dots, q_mat[at], mat, most)
                    qid.append(np.full(len(rows), q_ids[at])), vid.append(ids[rows]), score.append(own)
                columns = [np.concatenate(x) if x else np.empty(0) for x in (qid, vid, score)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t), p) for c, t, p in zip(columns, ("i8", "i8", "f8"), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    hit = "query_id long, vec_id long, score double"
    found = known.select("hits").mapInArrow(unpacked, hit).union(work.mapInArrow(search, hit))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other vectors for each vector whose id is divisible by 20."""
    base = table(spark, sf_dir, "embeddings")
    return nearest(base.where(F.col("vec_id") % 20 == 0), base)
