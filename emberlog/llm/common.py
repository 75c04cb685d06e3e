"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows in one Arrow batch. Texts may be very long, so batches are small.
BATCH_ROWS = 256
#: Edges that one task joins by itself before tasks exchange any.
TASK_EDGES = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only in local mode a temporary one is made where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives the loss of an executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds an Arrow batch by rows and by bytes, since one text may have many megabytes.

    Python workers on this machine also get the folder of this library, wherever the
    driver was started; on a cluster it is installed or sent with --py-files as usual.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), ROOT])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest node that each node of edges(a, b) reaches: (node, component), nodes without edges left out.

    Alternates large-star and small-star steps until the edges no longer change. Each
    step is one aggregation and one join; a node with very many neighbours is never
    gathered into one group. Null nodes are dropped. Raises if max_rounds do not suffice.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    now = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
        .checkpoint()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    before = mark(now)
    for _ in range(max_rounds if before[0] else 0):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .distinct()
            .checkpoint()
        )
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of long nodes from each node of these edges to the smallest one that they join it with, that one left out."""
    ends = [(np.empty(0, "<i8"), np.empty(0, "<i8"))]
    ends += [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    a, b = (np.concatenate(x) for x in zip(*ends))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        before = label.copy()
        # A root goes below the smaller root that an edge joins it with; then all go to their roots.
        ra, rb = label[a], label[b]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    far = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])


def joined(edges: DataFrame) -> DataFrame:
    """As connected_components(), of a table edges(a long, b long), for which tasks first join what they hold.

    The edges are read by as many tasks as they are TASK_EDGES each. One task has then
    joined all there is; what several have joined goes to connected_components().
    """
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    tasks = -(-edges.count() // TASK_EDGES) or 1
    links = written(edges.coalesce(tasks).mapInArrow(forest, "a long, b long"), "near-forest")
    if tasks > 1:
        return connected_components(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
