import hashlib
import random

import numpy as np
import pytest

from emberlog.llm import suffix_dedup as S


def brute(rows, length=100):
    """kept bytes and spans by row, rows in order of (id, place in the list), nulls first."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        b = (rows[i][1] or "").encode()
        cover = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                cover[s] += 1
                cover[s + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[:-1] > 0
        edge = np.diff(gone.astype(int), prepend=0, append=0)
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out[i] = (np.frombuffer(b, np.uint8)[~gone].tobytes(), spans)
    return out


def make_rows():
    rng = random.Random(4)
    passage = lambda n: "".join(rng.choice("abcdefgh é\0漢") for _ in range(n))
    shared = [passage(n) for n in (60, 99, 100, 101, 150, 400, 1500)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "x" * 700), (4, "x" * 99), (5, "ab" * 400), (6, "yx" + "x" * 130 + "z")]
    for i in range(7, 60):
        text = passage(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(shared) + passage(rng.randint(0, 90))
        rows.append((i, text))
    rows += [(70, rows[20][1]), (71, rows[20][1] + "!"), (72, rows[21][1][:-1]), (73, rows[22][1] * 2)]
    return rows


@pytest.mark.parametrize("batch,group,flush", [(16_384, 100_000, 400_000), (40, 60, 50), (2, 3, 5)])
def test_equals_brute_force(spark, monkeypatch, batch, group, flush):
    """Also with batches so small that groups go over several, and anchors' groups so large that they are dealt by further levels."""
    monkeypatch.setattr(S, "BATCH_WINDOWS", batch)
    monkeypatch.setattr(S, "GROUP_WINDOWS", group)
    monkeypatch.setattr(S, "FLUSH_ROWS", flush)
    rows = make_rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, uid int").repartition(3).cache()
    want = brute(rows)
    got = {r["doc_id"]: r for r in S.remove_repeats(df).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        assert got[i]["n_bytes"] == len((t or "").encode())
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == want[k][1], i
        assert bytes(got[i]["kept"]) == want[k][0]


@pytest.mark.parametrize("common", [40, 70, 95, 130])
def test_a_hot_anchor_is_dealt_by_further_levels(spark, monkeypatch, common):
    """One passage in every row, among text that differs or that a few rows share: groups stay small, nothing is lost."""
    monkeypatch.setattr(S, "GROUP_WINDOWS", 8)
    rng = random.Random(common)
    passage = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    hot, near = passage(common), [passage(60) for _ in range(5)]
    rows = [(i, (rng.choice(near) if i % 3 else passage(50)) + hot + (rng.choice(near) if i % 2 else passage(70))) for i in range(90)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    got = {r["doc_id"]: r for r in S.remove_repeats(df).collect()}
    for k, (i, _) in enumerate(rows):
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == want[k][1], i
        assert bytes(got[i]["kept"]) == want[k][0]


def test_repeated_and_null_ids(spark):
    rng = random.Random(1)
    a, b = "lorem ipsum " * 12, "".join(rng.choice("abcdefghijk") for _ in range(230))
    rows = [(5, a + b), (5, a + b), (None, b), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = S.remove_repeats(df).collect()
    kept = sorted((str(r["doc_id"]), len(r["kept"])) for r in got)
    # The null id comes first and stays whole; one row of id 5 keeps what b has not.
    assert kept[0] == ("5", 0) and kept[2] == ("9", 0) and kept[3] == ("None", 230) and 0 < kept[1][1] < 144


def test_empty_table_and_query(spark, tmp_path):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    spark.createDataFrame([(1, "q" * 150), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in S.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    # Every string of the run but the first starts later too.
    assert got[1] == (150, 149, 1, hashlib.sha256(b"q").hexdigest())
    assert got[2] == (0, 0, 0, hashlib.sha256(b"").hexdigest())


def test_windows_cover_every_start_once_and_follow_content():
    rng = random.Random(8)
    text = bytes(rng.choice(b"abc") for _ in range(3000))
    h, _, lo, size = S.windows(text)
    starts = [s for a, n in zip(lo.tolist(), size.tolist()) for s in range(a, a + n - 99)]
    assert starts == list(range(len(text) - 99))
    of = {s: int(x) for x, a, n in zip(h, lo.tolist(), size.tolist()) for s in range(a, a + n - 99)}
    h2, _, lo2, size2 = S.windows(b"zz" + text[500:900])
    of2 = {s: int(x) for x, a, n in zip(h2, lo2.tolist(), size2.tolist()) for s in range(a, a + n - 99)}
    assert all(of2[s + 2] == of[s + 500] for s in range(301))


def test_long_texts_are_cut_into_segments(monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 512)
    S._powers.cache_clear()
    rng = random.Random(8)
    text = bytes(rng.choice(b"abcdefg") for _ in range(5000))
    try:
        h, _, lo, size = S.windows(text)
        assert sorted({s for a, n in zip(lo.tolist(), size.tolist()) for s in range(a, a + n - 99)}) == list(range(4901))
    finally:
        S._powers.cache_clear()


def test_two_stage_order():
    rng = random.Random(3)
    for _ in range(30):
        wins = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(16, 40))) for _ in range(rng.randint(1, 9))]
        gap = bytes(24)
        text = np.frombuffer(gap.join(wins) + gap, np.uint8)
        size = np.array([len(w) for w in wins])
        starts = np.concatenate([[0], np.cumsum(size + 24)[:-1]])
        order = S.two_stage(text, starts, starts + size, 16)
        of = np.searchsorted(starts, order, side="right") - 1
        whole = [(i, o) for i, o in zip(of.tolist(), (order - starts[of]).tolist()) if o <= len(wins[i]) - 16]
        keys = [wins[i][o : o + 16] for i, o in whole]
        assert keys == sorted(keys) and len(set(whole)) == sum(len(w) - 15 for w in wins)
