"""Token counts through a digest cache.

A stored table holds (content digest, tokenizer digest, n_tokens). A run joins the
digests of its texts to it, encodes only distinct texts that it lacks, appends their
counts, and reads every count back from it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, table, written

#: A digest that more than one of so many rows have is hot; so there are fewer hot ones than this.
MOST_HOT = 10_000
CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


@lru_cache(maxsize=4)
def counter(model: str):
    """A function from texts to counts, without begin, end or special tokens; once for each Python worker."""
    if model.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    if model.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(model)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    raise ValueError(f"no library for {model}")


def tokenizer_digest(model: str) -> str:
    """Digest of the vocabulary file and of the library's version: a change of either misses the cache."""
    import importlib.metadata as meta

    library = "sentencepiece" if model.endswith(".model") else "tokenizers"
    with open(model, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library}|{meta.version(library)}".encode()).hexdigest()


def token_counts(docs: DataFrame, model: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text: (id_col, n_bytes long, n_tokens long, over_limit boolean).

    Content is normalised only by null to empty: the library's own normaliser comes
    after it, so equal digests always mean equal counts. A null or repeated id is
    kept, one row out for each row in; other columns are ignored. An empty table gives
    an empty table. The cache at cache_path is made if it is missing; two runs that
    append the same digest do no harm.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_digest(model)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))

    # An empty append makes the table where there is none.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def stored() -> DataFrame:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
        return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(of(b.column("_text").to_pylist()), pa.int64())], names=["digest", "n_tokens"])

    # Copies meet in the partial aggregation, before anything is shuffled.
    distinct = base.groupBy("digest").agg(F.first("_text").alias("_text"))
    misses = distinct.join(stored().select("digest"), "digest", "left_anti")
    misses.mapInArrow(count, "digest binary, n_tokens long").withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache_path)
    # One text may be that of a third of all rows. Such texts are few, and their counts go to all tasks.
    rows = written(base.select("_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes")), "token-rows")
    total = rows.count()
    hot = written(rows.groupBy("digest").count().where(F.col("count") * MOST_HOT > total).select("digest").join(stored(), "digest"), "token-hot")
    by_hot = rows.join(F.broadcast(hot), "digest")
    by_digest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(stored(), "digest", "left")
    return by_hot.unionByName(by_digest).select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of all documents, through a cache of this call's own that starts empty."""
    import public_tokenizers as P

    return token_counts(table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"), new_path(spark, "token-cache"))
