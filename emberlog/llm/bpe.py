"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of up to chunk_chars characters is one chunk. A longer one is cut into chunks
that overlap; each chunk is pre-tokenised by itself, in parallel, from its own start.
Where the boundaries found by one chunk and by the next meet in their overlap, the two
scans agree from there on, since a match depends only on what follows its start. The
text is cut at that point, the pieces are encoded in parallel and their ids are
concatenated. If an overlap has no such point, the whole text is one piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

CHUNK_CHARS, OVERLAP_CHARS = 65_536, 4_096
#: The longest look of the pattern past the end of a match, in characters.
LOOK_AHEAD = 3


@lru_cache(maxsize=4)
def encoder(vocab: str, pattern: str):
    """The encoding of a file of ranks, once for each Python worker."""
    import tiktoken

    with open(vocab, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def _ids(enc, text: str | None) -> bytes:
    import numpy as np

    return np.asarray(enc.encode_ordinary(text or ""), dtype="<u4").tobytes()


def _encode_rows(df: DataFrame, vocab: str, pattern: str, keys: list[str]) -> DataFrame:
    """keys and ids of the rows of df(keys..., _text)."""
    schema = df.select(*keys, F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, pattern)
        for b in batches:
            ids = pa.array((_ids(enc, t.as_py()) for t in b.column("_text")), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), ids], names=[*keys, "ids"])

    return df.select(*keys, "_text").mapInArrow(run, schema)


def boundaries(text: str, pattern: str, last: bool) -> list[int]:
    """Where matches start in a chunk, as far as its end (unless it is the last of its text) cannot change them."""
    out = []
    for m in splitter(pattern).finditer(text):
        out.append(m.start())
        if not last and m.end() > len(text) - LOOK_AHEAD:
            break
    return out


def encode(docs: DataFrame, vocab: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Token ids of every whole text: (id_col, n_tokens long, ids binary of little-endian uint32).

    docs: any columns besides id_col and text_col are ignored. A null text counts as
    empty and has no ids; a null or repeated id is kept, with one row out for each row
    in. An empty table gives an empty table. vocab must be readable on every executor.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("need 0 < overlap_chars < chunk_chars")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    short = _encode_rows(docs.where(F.length("_text") <= chunk_chars), vocab, pattern, ["_id"])

    # The row number tells long texts apart, be their ids null or repeated; it is written once, since a second reading may give others.
    long = written(docs.where(F.length("_text") > chunk_chars).withColumn("_row", F.monotonically_increasing_id()), "bpe-long")
    n_chunks = F.ceil(F.length("_text") / chunk_chars).cast("int")
    chunks = (
        long.withColumn("_k", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
        .select("_row", "_k", n_chunks.alias("_n"), F.substring("_text", F.col("_k") * chunk_chars + 1, F.lit(chunk_chars + overlap_chars)).alias("_text"))
        .repartition(F.col("_row"), F.col("_k"))
    )

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            found = [boundaries(r["_text"], pattern, r["_k"] == r["_n"] - 1) for r in rows]
            at = [r["_k"] * chunk_chars for r in rows]
            head = [[p + s for p in f if p < overlap_chars] for f, s in zip(found, at)]
            tail = [[p + s for p in f if p >= chunk_chars] for f, s in zip(found, at)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), b.column("_k"), b.column("_n"), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))],
                names=["_row", "_k", "_n", "_head", "_tail"],
            )

    from pyspark.sql import Window

    marks = chunks.mapInArrow(pretokenise, "_row long, _k int, _n int, _head array<long>, _tail array<long>")
    of_text = Window.partitionBy("_row").orderBy("_k")
    cuts = (
        marks.withColumn("_from", F.when(F.col("_k") == 0, F.lit(0).cast("long")).otherwise(F.array_min(F.array_intersect("_head", F.lag("_tail").over(of_text)))))
        .withColumn("_to", F.lead("_from").over(of_text))
        .withColumn("_whole", F.max(F.col("_from").isNull()).over(Window.partitionBy("_row")))
        .select("_row", "_k", "_from", "_to", "_whole")
    )
    start = F.col("_from") - F.col("_k") * chunk_chars
    pieces = (
        chunks.join(cuts.where("not _whole"), ["_row", "_k"])
        .select("_row", "_k", F.when(F.col("_to").isNull(), F.expr(f"substring(_text, int(_from - _k * {chunk_chars} + 1))")).otherwise(F.substring("_text", (start + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int"))).alias("_text"))
    )
    whole = long.join(cuts.where("_whole and _k = 0").select("_row"), "_row").select("_row", F.lit(0).alias("_k"), "_text")
    encoded = _encode_rows(pieces.union(whole), vocab, pattern, ["_row", "_k"])
    joined = (
        encoded.groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("_k", "ids"))).alias("p"))
        .select("_row", F.aggregate("p", F.lit(b""), lambda out, x: F.concat(out, x["ids"])).alias("ids"))
    )
    ids = short.union(long.select("_row", "_id").join(joined, "_row").select("_id", "ids"))
    return ids.select(F.col("_id").alias(id_col), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode(ids: DataFrame, vocab: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col: the bytes of all tokens of ids_col, concatenated; null for null ids. An existing out_col is replaced."""
    schema = ids.drop(out_col).select("*", F.lit(b"").cast("binary").alias(out_col)).schema
    schema[out_col].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(vocab, pattern)
        for b in batches:
            out = [None if x is None else enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, out_col])

    small_batches(ids.sparkSession)
    return ids.drop(out_col).mapInArrow(run, schema)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, decoded again, and digests of both."""
    import public_tokenizers as P

    from .common import table

    vocab = P.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), vocab, P.PATTERN), vocab, P.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
