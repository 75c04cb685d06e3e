"""What formats share whose records may lie across splits of a file.

A format reads pieces that end at one character. What a split does to the state of its scanner is
an effect for each state that it may begin in; a prefix of effects over the splits of a file gives the state
at each beginning. Each split then cuts its records with that state, and what lies across splits is
put together by its number.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ingest import SOURCE
from ..session import importable, prepared
from .lines import MOST_SPLITS, source_name

PLACE = (*SOURCE, "block", "single")


def read_pieces(spark: SparkSession, paths: str | list[str], end: str, session_id: str = "default") -> DataFrame:
    """(SOURCE, block, single, piece) of files, in order within a split; single tells that the split is the whole file."""
    prepared(spark)
    raw = spark.read.option("lineSep", end).text(paths)
    m = F.col("_metadata")
    path = m["file_path"]
    return raw.select(F.lit(session_id).alias("session_id"), path.alias("source_path"), source_name(path).alias("source_name"), m["file_block_start"].alias("block"), (m["file_block_length"] >= m["file_size"]).alias("single"), F.col("value").alias("piece"))


def may_be_split(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether a file is so large that Spark may split it; from the listing of files, none is read."""
    largest = spark.read.format("binaryFile").load(paths).agg(F.max("length")).first()[0] or 0
    of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return largest > min(of(spark.conf.get("spark.sql.files.openCostInBytes")), of(spark.conf.get("spark.sql.files.maxPartitionBytes")))


def values_of(column: pa.Array) -> list:
    """As to_pylist(), which takes each string apart."""
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator]]:
    """Rows of batches by runs of equal keys, each run as an iterator of the rest of the row's values.

    Keys are compared as columns and made once for a run of a batch, since pieces are small and many.
    """

    def parts() -> Iterator[tuple]:
        for b in batches:
            if not b.num_rows:
                continue
            ends = sorted(set().union(*(pc.run_end_encode(b.column(k)).run_ends.to_pylist() for k in keys)))
            for start, end in zip([0, *ends], ends):
                own = b.slice(start, end - start)
                yield tuple(own.column(k)[0].as_py() for k in keys), zip(*(values_of(own.column(n)) for n in b.schema.names if n not in keys))

    for key, run in groupby(parts(), key=lambda r: r[0]):
        yield key, chain.from_iterable(r[1] for r in run)


def split_states(pieces: DataFrame, begin: object, effects: Callable[[Iterator[tuple[bool, str]]], object], after: Callable[[object, object], object]) -> DataFrame:
    """(source_path, block, state) of files of several splits: the state each split begins in, and that behind the last as block -1.

    effects takes the pieces of a split, each with whether it is the first of its file. States and effects are kept as JSON; a task
    that makes the prefix reads one small row for each split of a file.
    """
    importable(pieces.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block), run in runs(batches, ("source_path", "block")):
            own = ((block == 0 and i == 0, r[0] or "") for i, r in enumerate(run))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([json.dumps(effects(own))])], names=["source_path", "block", "effect"])

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path,), run in runs(batches, ("source_path",)):
            state = begin
            for block, effect in run:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([json.dumps(state)])], names=["source_path", "block", "state"])
                state = after(json.loads(json.dumps(state)), json.loads(effect))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([-1]), pa.array([json.dumps(state)])], names=["source_path", "block", "state"])

    several = pieces.where("not single").select("source_path", "block", "piece").mapInArrow(sums, "source_path string, block long, effect string")
    return several.repartition("source_path").sortWithinPartitions("source_path", "block").mapInArrow(prefix, "source_path string, block long, state string")


def with_states(pieces: DataFrame, states: DataFrame | None) -> DataFrame:
    """pieces with the state that their split begins in; null for the beginning of a file, and for files of one split."""
    if states is None:
        return pieces.select(*PLACE, F.lit(None).cast("string").alias("state"), "piece")
    own = states.select(F.col("source_path").alias("_path"), F.col("block").alias("_block"), "state").where("_block >= 0")
    own = F.broadcast(own) if own.count() <= MOST_SPLITS else own
    return pieces.join(own, (F.col("source_path") == F.col("_path")) & (F.col("block") == F.col("_block")) & ~F.col("single"), "left").select(*PLACE, "state", "piece")


def numbered(cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole records, and records put together from parts, of cuts(SOURCE, block, k, whole, raw_source) with record_number.

    k counts the records that begin in a split from 1, 0 is the rest of one that began before; a row with
    k = -1 - n tells that n begin there.
    """
    counts = cuts.where("k < 0").select("source_path", "block", (-1 - F.col("k")).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("source_path", "block", before.alias("_before"))
    rows = cuts.where("k >= 0").join(F.broadcast(counts) if counts.count() <= MOST_SPLITS else counts, ["source_path", "block"]).withColumn("record_number", F.col("_before") + F.col("k"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", "raw_source"))), lambda x: x["raw_source"])
    parts = rows.where("not whole").groupBy(*SOURCE, "record_number").agg(F.array_join(ordered, "").alias("raw_source"))
    return rows.where("whole"), parts
