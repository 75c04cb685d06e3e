import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from emberlog.llm import bpe, token_counts

TEXTS = [None, "", " ", "plain words here", "tabs\t\tand   spaces  \n\n x", "l'été à 12345 's don't we'll", "<|endoftext|> <s>", "漢字かな交じり文 😀😀", "a" * 700, " " * 500 + "x" + " " * 300, "word " * 400, "né" * 333 + "'re" * 50]
VOCAB = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "null id", 1), (3, "plain words here", 2)], "doc_id long, text string, ids int")


@pytest.mark.parametrize("chunk,overlap", [(65_536, 4_096), (64, 24), (33, 8), (10, 9)])
def test_chunked_encoding_equals_the_library(docs, chunk, overlap):
    path = P.path(VOCAB)
    enc = bpe.encoder(path, P.PATTERN)
    out = bpe.decode(bpe.encode(docs, path, P.PATTERN, chunk_chars=chunk, overlap_chars=overlap), path, P.PATTERN).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        t = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(t)
        assert r["n_tokens"] == len(enc.encode_ordinary(t))
        assert bytes(r["decoded"]) == t.encode()


def test_boundaries_hold_whatever_follows():
    for text in TEXTS:
        for cut in range(5, min(len(text or ""), 60)):
            whole = bpe.boundaries(text, P.PATTERN, True)
            assert set(bpe.boundaries(text[:cut], P.PATTERN, False)) <= set(whole)


def test_digest_cache(spark, docs, tmp_path):
    model = P.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    path = f"file://{tmp_path}/cache"
    got = token_counts.token_counts(docs, model, path, limit=100).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        t = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(sp.encode(t))) and r["over_limit"] == (r["n_tokens"] > 100)
    stored = spark.read.parquet(path)
    n = stored.count()
    assert n == len({t or "" for t in TEXTS}) + 1 and stored.select("digest").distinct().count() == n
    # Hits are not encoded again: what the cache holds is what counts.
    digest = F.unhex(F.sha2(F.lit("new").cast("binary"), 256))
    spark.range(1).select(digest.alias("digest"), F.lit(77).cast("long").alias("n_tokens"), F.lit(token_counts.tokenizer_digest(model)).alias("tokenizer")).write.mode("append").parquet(path)
    again = token_counts.token_counts(docs.union(spark.createDataFrame([(99, "new", 0)], docs.schema)), model, path).where("doc_id = 99").first()
    assert again["n_tokens"] == 77
    assert spark.read.parquet(path).count() == n + 1
    # Another tokenizer misses.
    other = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), path).collect()
    assert len(other) == len(TEXTS) + 2 and spark.read.parquet(path).count() == 2 * n + 1


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, P.path(VOCAB), P.PATTERN).count() == 0
    assert token_counts.token_counts(none, P.path("piece_bpe_32k.model"), f"file://{tmp_path}/c").count() == 0


def test_query_digests(spark, tmp_path):
    spark.createDataFrame([(1, "ein Text"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in bpe.op4_byte_bpe(spark, str(tmp_path)).collect()}
    assert rows[1]["decoded_sha256"] == hashlib.sha256(b"ein Text").hexdigest()
    assert rows[2]["n_tokens"] == 0 and rows[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert tiktoken is not None
