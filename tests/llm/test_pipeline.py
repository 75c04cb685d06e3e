import random

import public_tokenizers as P
import pytest

import __spark_entry__
import corpus_pipeline
from emberlog.llm import bpe


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean, junk, copied and personal documents, of two sources."""
    rng = random.Random(7)
    vocab = ["word%d" % i for i in range(2000)]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(vocab) for _ in range(60)]
        junk = i % 6 == 5
        text = " ".join(w.upper() + "!!" if junk else w for w in words)
        if i % 6 == 4:
            text += f" write to me{i}@mail.org"
        rows.append((i, text, "en", "a" if i % 4 else "b", len(text)))
        labels.append((i, 0 if junk else 1, 0))
    rows += [(1000 + i, rows[i][1], "en", "a", rows[i][4]) for i in range(0, 60, 6)]
    rows += [(2000 + i, rows[i][1] + " more", "en", "b", rows[i][4] + 5) for i in range(1, 60, 6)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_in_turn(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "pii", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "bpe" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = {n: {r["doc_id"] for r in rows} for n, rows in kept.items()}
    clean = {i for i in range(240) if i % 6 != 5}
    assert not any(i < 240 and i % 6 == 5 for i in ids["quality"]) and clean <= ids["quality"]
    # Copies and near copies go, the first of each group stays.
    assert ids["near_dedup"] == clean
    assert all("@" not in r["text"] and (r["doc_id"] % 6 != 4 or "[EMAIL]" in r["text"]) and r["n_chars"] == len(r["text"]) for r in kept["pii"])
    assert ids["mixing"] <= clean and len(kept["mixing"]) > 120
    enc = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in kept["pii"]}
    assert sorted(r["doc_id"] for r in kept["bpe"]) == sorted(r["doc_id"] for r in kept["mixing"])
    assert all(r["n_tokens"] == len(enc.encode_ordinary(texts[r["doc_id"]])) for r in kept["bpe"])


def test_run_gives_what_the_stages_give(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "n_tokens", "ids"] and 120 < rows.count() < 280


def test_entry_lists_the_queries():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
