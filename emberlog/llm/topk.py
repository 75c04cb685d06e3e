"""Exact search for the largest inner products in buckets of like length.

Vectors are sorted by length and cut into buckets. A query's k-th best product in the
bucket of the longest vectors bounds its result from below. From that bound each bucket
gets a local cosine threshold: above 1 the bucket is left out; near 1 the vectors are
pruned by single coordinates, which a cosine that high confines to an interval; below,
by length. What is left is verified by its products. Queries come in blocks, sorted by
how much length they ask for, so that a block leaves out a bucket as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .vectors import blocks, unpack, usual_size, valid

BUCKET_ROWS, QUERY_ROWS = 2_048, 512
#: Coordinates looked at, and the local cosine threshold from which coordinates are looked at.
FOCUS, COORDINATE_FROM = 6, 0.5
#: Query blocks whose number and bound, 16 bytes each, are broadcast.
MOST_BROADCAST = 500_000
_SLACK = 1e-9
_LONG, _DOUBLE = np.iinfo(np.int64), np.finfo(np.float64)


def products(mat: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where all sums stay below 2^53, else in Python's integers."""
    with np.errstate(over="ignore"):
        most = np.abs(mat).max(initial=0) * np.abs(q).max(initial=0) * len(q)
    if most < 2**53:
        return (mat @ q).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return exact(mat) @ exact(q) if len(mat) else np.empty(0, np.int64)


def in_range(found: np.ndarray) -> np.ndarray:
    """Products as longs; those beyond the range of a long become the largest or smallest."""
    return found if found.dtype == np.int64 else np.array([min(max(x, _LONG.min), _LONG.max) for x in found], np.int64)


def below(x: int) -> float:
    """A double that is x or less: a long may have no double of its own."""
    return float(x) if abs(x) < 2**53 else float(np.nextafter(float(x), -np.inf))


def candidates(q: np.ndarray, floor: float, mat: np.ndarray, lens: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Rows of a bucket (longest first) that may have a product of floor or more with q."""
    length = float(np.sqrt(q @ q))
    if floor == -np.inf or length == 0 or lens[0] == 0:
        return np.arange(len(mat)) if floor <= 0 else np.empty(0, int)
    local = floor / (length * lens[0])
    if local > 1 + _SLACK:
        return np.empty(0, int)
    if local < COORDINATE_FROM:
        return np.arange(len(mat)) if floor <= 0 else np.flatnonzero(lens * length >= floor - _SLACK * abs(floor))
    local = min(local, 1.0)
    qn = q / length
    left = np.arange(len(mat))
    for f in np.argsort(-np.abs(qn))[:FOCUS]:
        left = left[_within(unit[left, f], qn[f], local)]
        if not len(left):
            break
    return left


def _within(x: np.ndarray, c: float, local: float) -> np.ndarray:
    """Whether coordinates can belong to a unit vector whose cosine with the query is local or more.

    With c the query's own coordinate, the cosine is at most c x + sqrt(1 - c^2) sqrt(1 - x^2).
    """
    return c * x + np.sqrt(max(0.0, 1 - c * c)) * np.sqrt(np.maximum(0.0, 1 - x * x)) >= local - _SLACK


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    order = np.lexsort((ids[near], ~scores[near]))
    return near[order][:k]


def top_products(queries: DataFrame, base: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer products of each query with other rows of base.

    Components x count as floor(scale * x), the largest double at most. Products are
    exact; those beyond the range of a long count as the largest or smallest long. Rows of the query's own id are no candidates;
    ties go to smaller ids; fewer candidates give fewer rows. Vectors that are null, hold
    null or non-finite components, or have another number of components than most, take
    no part, nor do null ids. Other columns are ignored. An empty table gives an empty one.
    """
    spark = base.sparkSession
    small_batches(spark)
    dim = usual_size(base, vec_col)

    def whole(x):
        # floor() gives a long; from 2^53 on a double is whole anyway.
        y = F.least(F.greatest(x * scale, F.lit(float(_DOUBLE.min))), F.lit(float(_DOUBLE.max)))
        return F.when(F.abs(y) < 2**53, F.floor(y).cast("double")).otherwise(y)

    def scaled(df: DataFrame) -> DataFrame:
        return valid(df, dim, id_col, vec_col).select(F.lit(0).alias("cell"), "id", F.transform("vec", whole).alias("vec")).withColumn("len", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))

    buckets = written(blocks(scaled(base), dim, BUCKET_ROWS, [-F.col("len"), F.col("id")]).withColumn("part", F.monotonically_increasing_id()), "buckets")

    def lengths(mat: np.ndarray) -> np.ndarray:
        return np.sqrt((mat * mat).sum(1))

    longest = buckets.orderBy("part").limit(1)  # one bucket, of bounded size
    first = longest.first()
    first_ids, first_mat = (np.frombuffer(first["ids"], "<i8"), unpack(first["mat"], dim)) if first else (np.empty(0, "<i8"), np.empty((0, dim)))
    head = spark.sparkContext.broadcast((first_ids, first_mat))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with its k-th best product in the longest bucket."""
        ids, mat = head.value
        for b in batches:
            out = []
            for i, v in zip(b.column("id").to_pylist(), b.column("vec").to_pylist()):
                other = mat[ids != i]
                out.append(below(int(np.sort(in_range(products(other, np.array(v))))[-k])) if len(other) >= k else float("-inf"))
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("id"), b.column("vec"), b.column("len"), pa.array(out, pa.float64())], names=["cell", "id", "vec", "len", "floor"])

    # The bound travels as one more component.
    asked = scaled(queries).mapInArrow(bound, "cell int, id long, vec array<double>, len double, floor double")
    need = F.when(F.col("len") > 0, F.col("floor") / F.sqrt("len")).otherwise(F.lit(float("-inf")))
    asked = asked.select("cell", "id", F.concat("vec", F.array("floor")).alias("vec"), need.alias("need"))
    wanted = written(blocks(asked, dim + 1, QUERY_ROWS, [F.col("need"), F.col("id")], extra=lambda m: np.array([(m[:, -1] / np.maximum(np.sqrt((m[:, :-1] ** 2).sum(1)), 1e-300)).min()])).withColumn("part", F.monotonically_increasing_id()), "queries")

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = [float(lengths(unpack(x, dim)[:1])[0]) for x in b.column("mat").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(most, pa.float64())], names=["part", "longest"])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array([float(np.frombuffer(x, "<f8")[0]) for x in b.column("extra").to_pylist()], pa.float64())], names=["qpart", "need"])

    of_bucket = buckets.mapInArrow(edge, "part long, longest double")
    of_query = wanted.mapInArrow(least, "qpart long, need double")
    # A row for each pair of blocks, not of vectors; 16 bytes for some hundreds of vectors.
    few = wanted.count() <= MOST_BROADCAST
    pairs = (F.broadcast(of_query) if few else of_query).join(of_bucket, of_query["need"] <= of_bucket["longest"] * (1 + _SLACK) + _SLACK).select("qpart", "part")
    work = (
        pairs.join(wanted.select(F.col("part").alias("qpart"), F.col("ids").alias("qids"), F.col("mat").alias("qmat")), "qpart")
        .join(buckets.select("part", "ids", "mat"), "part")
        .select("qids", "qmat", "ids", "mat")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, mat = np.frombuffer(r["ids"], "<i8"), unpack(r["mat"], dim)
                lens = lengths(mat)
                unit = mat / np.maximum(lens, 1e-300)[:, None]
                qid, vid, score = [], [], []
                for q_id, q in zip(np.frombuffer(r["qids"], "<i8"), unpack(r["qmat"], dim + 1)):
                    floor, q = q[-1], q[:-1]
                    rows = candidates(q, floor, mat, lens, unit)
                    rows = rows[ids[rows] != q_id]
                    got = in_range(products(mat[rows], q))
                    rows, got = rows[got >= floor], got[got >= floor]
                    top = best(got, ids[rows], k)
                    qid += [int(q_id)] * len(top)
                    vid += ids[rows[top]].tolist()
                    score += got[top].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(vid, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    found = work.mapInArrow(verify, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for each vector whose id is divisible by 50."""
    base = table(spark, sf_dir, "embeddings")
    return top_products(base.where(F.col("vec_id") % 50 == 0), base)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
