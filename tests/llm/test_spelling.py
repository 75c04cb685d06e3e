import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from emberlog.llm import spelling

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_vocabulary(docs, length=5, count=3):
    total = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= length and n >= count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def invented(seed, n, letters="abcé", least=1, most=8):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(least, most))): r.choice([1, 2, 3, 5, 9, 20, 40, 90]) for _ in range(n)}


def got(df):
    return sorted(tuple(r) for r in df.select(NAMES).collect())


@pytest.mark.parametrize("most, block, batch", [(8192, 8192, 65536), (20, 7, 50), (2, 3, 1)])
def test_variants_equal_brute_force_whatever_the_groups(spark, monkeypatch, most, block, batch):
    monkeypatch.setattr(spelling, "GROUP_WORDS", most)
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "BATCH_WORDS", batch)
    words = invented(most, 600)
    assert got(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_neighbours_of_one_list():
    words = sorted(invented(3, 500, "ab", 1, 9))
    i, j = spelling.neighbours(np.zeros(len(words), int), words)
    assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(len(words)) for b in range(len(words)) if one_edit(words[a], words[b])]


def texts(seed, n=150):
    r = random.Random(seed)
    words = [w for w in invented(seed, 250, "abcÉé÷", 4, 7)]
    return [(i, " ".join(r.choice(words).title() + r.choice(["", ".", "1", "_"]) for _ in range(60))) for i in range(n)]


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    docs = texts(1) + [(900, None), (901, ""), (902, "123 _"), (903, "Straße" * 3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = got(spelling.op12_spelling(spark, str(tmp_path)))
    assert out == brute(brute_vocabulary(docs)) and any(r[1] for r in out)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.sql(f"SELECT {', '.join(NAMES)} FROM ({spelling.OP12_SQL})").fetchall()) == out


def test_long_texts_nulls_repeats_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    monkeypatch.setattr(spelling, "COUNTED", 10)
    docs = texts(2, 20) + [(None, "hello hello hullo"), (7, "hello"), (7, "hello"), (8, "z" * 4000), (8, "z" * 4000), (8, "z" * 4000)] + [(9, "z" * 3999)] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n")
    vocabulary = {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()}
    assert vocabulary == brute_vocabulary(docs)
    out = {r["word"]: r for r in spelling.spelling_variants(spelling.vocabulary(df)).collect()}
    assert out["z" * 4000]["n_near"] == (1 if "z" * 3999 in vocabulary else 0) and sorted(tuple(out[w][c] for c in NAMES) for w in out) == brute(vocabulary)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.vocabulary(empty)).count() == 0
