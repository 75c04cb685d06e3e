import hashlib
import random
import zlib

import duckdb
import pytest

from emberlog.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=120, longest=6, words=2):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        turns = [(t if t or r.random() < 0.7 else None, r.choice(["user", "bot", None]), r.choice(["", "é", None, "a" * 40][: words + 1])) for t in range(r.randint(1, longest))]
        rows += [(c, *t) for t in turns]
    r.shuffle(rows)
    return rows


def got(df):
    return sorted((tuple(r) for r in df.select(NAMES).collect()), key=str)


@pytest.mark.parametrize("chunk, last", [(4096, 1024), (3, 4), (2, 1)])
def test_query_equals_brute_force_whatever_the_chunks(spark, tmp_path, monkeypatch, chunk, last):
    monkeypatch.setattr(trie, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(trie, "LAST_ROWS", last)
    rows = conversations(chunk) + [(500, 0, "user", "same")] + [(600 + i, 0, "user", "same") for i in range(40)] + [(None, 1, "user", "lost")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute_trie(brute_rebuilt(rows))
    assert got(trie.op11_conversation_trie(spark, str(tmp_path))) == want


def test_query_equals_its_sql(spark, tmp_path):
    rows = conversations(7) + [(10_000 + i, t, "user", f"turn {t} {i % 3}") for i in range(9) for t in range(12)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted((tuple(r) for r in c.sql(f"SELECT {', '.join(NAMES)} FROM ({trie.OP11_SQL})").fetchall()), key=str)
    assert got(trie.op11_conversation_trie(spark, str(tmp_path))) == want


def test_ties_long_texts_turnless_and_clashing_columns(spark):
    rows = [(1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, "u", "b"), (3, 0, "u", "x" * 3_000_000), (4, 0, "u", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS path", "2 AS key", "3 AS digest", "4 AS _by")
    out = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(trie.turn_lists(df)).collect()}
    assert out[1, 2]["n_convs"] == 2 and out[3, 1]["saved_tokens"] == 3_000_000 and out[1, 0]["n_convs"] == 4
    # Conversation 1 takes its first 1 + turns from the absent 0; it may be left without any turn.
    alone = trie.prefix_trie(trie.rebuilt(df.where("conv_id = 1"))).collect()
    h = zlib.crc32(b"1") % 9
    assert max(r["depth"] for r in alone) == max(0, 2 - h)


def test_digests_tell_role_from_text(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, None, "abc")]
    assert trie.prefix_trie(trie.turn_lists(spark.createDataFrame(rows, SCHEMA))).count() == 4


def test_many_equal_conversations_hash_as_one_list(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id AS conv_id", "0L AS turn", "'u' AS role", "'t' AS text")
    rows = trie.prefix_trie(trie.turn_lists(df)).collect()
    assert sorted(r["n_convs"] for r in rows) == [5000, 5000]
    want = hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert [r["ends_sha256"] for r in rows if r["depth"] == 1] == [want]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(trie.rebuilt(empty)).count() == 0
