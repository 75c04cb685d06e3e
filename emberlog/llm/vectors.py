"""Vectors as blocks: sorted rows, some thousand to a block, each block one row with packed arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


def usual_size(df: DataFrame, vec_col: str) -> int:
    """The most frequent number of components, the larger of two; 0 if there is no vector."""
    found = df.where(F.col(vec_col).isNotNull()).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def valid(df: DataFrame, dim: int, id_col: str, vec_col: str) -> DataFrame:
    """(id long, vec array<double>) of rows that have an id and dim finite components."""
    vec = F.col(vec_col).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim) & ~F.exists(vec, odd)).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def rows_of(b: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    """An array column of dim numbers as a matrix."""
    col = b.column(name)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)


def unpack(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, dim)


BLOCK_SCHEMA = "part long, cell int, n int, ids binary, mat binary, extra binary"


def blocks(df: DataFrame, dim: int, rows: int, order: list, extra: Callable[[np.ndarray], np.ndarray] | None = None, by: list | None = None) -> DataFrame:
    """df(cell int, id, vec) in the given order, cut where cell changes and after so many rows.

    The order ends in id, so that range partitions also split rows that are alike in all
    else; by deals rows by a hash instead. extra maps a block's vectors to an array that is packed beside them.
    """
    small_batches(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        held_ids, held, cell, count = [], [], None, 0

        def out() -> pa.RecordBatch:
            nonlocal part
            ids, mat = np.concatenate(held_ids), np.concatenate(held)
            held_ids.clear(), held.clear()
            more = extra(mat) if extra else np.empty(0)
            part += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part - 1]), pa.array([cell], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([mat.astype("<f8").tobytes()]), pa.array([more.astype("<f8").tobytes()])],
                names=["part", "cell", "n", "ids", "mat", "extra"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            cells, ids, mat = b.column("cell").to_numpy(), b.column("id").to_numpy(), rows_of(b, "vec", dim)
            at = 0
            while at < len(ids):
                if held and (cells[at] != cell or count == rows):
                    yield out()
                    count = 0
                cell = int(cells[at])
                end = min(at + rows - count, len(ids))
                other = np.flatnonzero(cells[at:end] != cell)
                end = at + int(other[0]) if len(other) else end
                held_ids.append(ids[at:end]), held.append(mat[at:end])
                count += end - at
                at = end
        if held:
            yield out()

    dealt = df.select("cell", "id", "vec", *[o.alias(f"_o{i}") for i, o in enumerate(order)], *[c.alias(f"_b{i}") for i, c in enumerate(by or ())])
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = dealt.repartition(*[f"_b{i}" for i in range(len(by))]) if by else dealt.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).select("cell", "id", "vec").mapInArrow(cut, BLOCK_SCHEMA)
