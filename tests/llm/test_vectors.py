import math
import sys

import numpy as np
import pytest

from emberlog.llm import ann, topk


def rows_of(mat, ids=None):
    return [(int(i), [float(x) for x in v], "x") for i, v in zip(ids if ids is not None else range(len(mat)), mat)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").repartition(3).cache()


ODD = [(10_001, None, "x"), (10_002, [1.0, float("nan")] + [0.0] * 6, "x"), (10_003, [None] + [1.0] * 7, "x"), (10_004, [float("inf")] * 8, "x"), (10_005, [0.0] * 8, "x"), (None, [1.0] * 8, "x"), (10_006, [1.0] * 3, "x")]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    mat = rng.normal(size=(300, 8)) * rng.lognormal(0, 0.7, (300, 1))
    mat[100:140] = mat[7]  # ties
    mat[0] = 0
    return mat.astype(np.float32)


def test_products_equal_brute_force(spark, vectors, monkeypatch):
    base = frame(spark, rows_of(vectors) + ODD)
    ints = np.floor(256 * vectors.astype(np.float64)).astype(np.int64)
    ids = np.array([*range(300), 10_005])
    ints = np.concatenate([ints, np.zeros((1, 8), np.int64)])
    for rows in (2_048, 16):
        monkeypatch.setattr(topk, "BUCKET_ROWS", rows)
        monkeypatch.setattr(topk, "QUERY_ROWS", 7)
        got = {}
        for r in topk.top_products(base.where("vec_id % 10 = 0"), base, 5).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert sorted(got) == list(range(0, 300, 10))
        for q, found in got.items():
            score = ints @ ints[q]
            other = ids != q
            order = np.lexsort((ids[other], -score[other]))[:5]
            assert [found[i + 1] for i in range(5)] == list(zip(ids[other][order].tolist(), score[other][order].tolist()))


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(5)
    mat = np.floor(256 * rng.normal(size=(500, 16)))
    mat = mat[np.argsort(-np.sqrt((mat * mat).sum(1)))]
    lens = np.sqrt((mat * mat).sum(1))
    unit = mat / lens[:, None]
    pruned = 0
    for i in range(50):
        q = mat[i] + np.floor(20 * rng.normal(size=16))
        score = mat @ q
        for floor in (np.sort(score)[-5], np.sort(score)[-1], np.sort(score)[250], -np.inf, 1e12):
            rows = topk.candidates(q, floor, mat, lens, unit)
            assert set(np.flatnonzero(score >= floor)) <= set(rows.tolist())
            pruned += len(rows) < 500
    assert pruned > 100


def test_large_components_stay_exact():
    a = np.array([[2.0**40, 3.0], [1.0, 2.0**41]])
    assert topk.products(a, a[0]).tolist() == [2**80 + 9, 2**40 + 3 * 2**41]


def test_components_and_products_beyond_a_long(spark):
    """Whole components of any size count exactly, products are cut to the range of a long, ties go to smaller ids."""
    mat = [[1e18, 1.0], [1e18, 2.0], [-1e18, 3.0], [2.0**20, 1.0], [2.0**20, 1.0 + 2.0**-8], [1.7e308, -1.7e308], [0.0, 0.0]]
    base = spark.createDataFrame(list(enumerate(mat)), "vec_id long, embedding array<double>")
    most, least = 2**63 - 1, -(2**63)
    whole = [[min(max(int(math.floor(256 * x)) if abs(x) < 1e300 else int(math.copysign(sys.float_info.max, x)), -(2**1024)), 2**1024) for x in v] for v in mat]
    got = {}
    for r in topk.top_products(base, base, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(len(mat)):
        score = {i: min(max(sum(a * b for a, b in zip(whole[q], whole[i])), least), most) for i in range(len(mat)) if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:4]
        assert sorted(got[q]) == [(n + 1, i, score[i]) for n, i in enumerate(want)], q


def test_fewer_candidates_and_empty_tables(spark):
    few = frame(spark, rows_of(np.eye(8)[:3].astype(np.float32)))
    assert topk.top_products(few, few, 5).count() == 6
    assert ann.nearest(few, few, 20).count() == 6
    none = few.where("vec_id < 0")
    assert topk.top_products(none, none).count() == 0
    assert ann.nearest(none, none).count() == 0


def test_recall_and_exact_scores(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    mat = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    mat[500:620] = mat[40]
    monkeypatch.setattr(ann, "CELL_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    base = frame(spark, rows_of(mat) + [(i, (v + [1.0] * 8 if v and len(v) == 8 else v), x) for i, v, x in ODD[:1]])
    got = {}
    for r in ann.nearest(base.where("vec_id % 20 = 0"), base, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 3000, 20))
    m = mat.astype(np.float64)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert len(found) == 20 and [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) == 20
        score = m @ m[q]
        assert all(abs(f[2] - score[f[1]]) < 1e-9 for f in found)
        score[q] = -np.inf
        hits += len({f[1] for f in found} & set(np.lexsort((np.arange(3000), -score))[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_chi_square_quantile():
    # Known values of the distribution.
    assert abs(ann.chi_square_quantile(0.95, 2) - 5.991) < 1e-3
    assert abs(ann.chi_square_quantile(0.95, 10) - 18.307) < 1e-3


def test_query_matches_its_sql(spark, vectors, tmp_path):
    import duckdb

    frame(spark, rows_of(vectors) + ODD[:4]).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(c.sql(topk.SQL).fetchall())
    assert sorted(tuple(r) for r in topk.op2_topk(spark, str(tmp_path)).collect()) == want


def test_only_what_passes_the_stopping_test_is_multiplied(spark, monkeypatch):
    """Clusters far from each other: most vectors are behind the radius at which a query stops."""
    rng = np.random.default_rng(12)
    centres = 4 * rng.normal(size=(20, 16))
    mat = centres[np.repeat(np.arange(20), 200)] + 0.3 * rng.normal(size=(4000, 16))
    monkeypatch.setattr(ann, "CELL_ROWS", 1_000)
    base = frame(spark, rows_of(mat.astype(np.float32)))
    made = spark.sparkContext.accumulator(0)
    queries = base.where("vec_id % 50 = 0")
    got = ann.nearest(queries, base, 10, products=made).collect()
    assert len(got) == 80 * 10 and 0 < made.value < 0.5 * 80 * 4000
    m = mat.astype(np.float32).astype(np.float64)
    best = {q: set(np.argsort(-np.where(np.arange(4000) == q, -np.inf, m @ m[q]))[:10].tolist()) for q in range(0, 4000, 50)}
    assert sum(r["vec_id"] in best[r["query_id"]] for r in got) >= 0.9 * 800


def test_verified_takes_rings_until_the_test_holds():
    rng = np.random.default_rng(13)
    mat = rng.normal(size=(500, 6))
    q = rng.normal(size=6)
    longest = float((mat**2).sum(1).max())
    distance = longest + q @ q - 2 * mat @ q
    rows, dots, far = ann.verified(q, np.arange(500) != 3, mat, distance.copy(), np.inf, longest, 1.0, 1e-9, 5)
    want = np.sort(np.delete(distance, 3))
    assert far == pytest.approx(want[4]) and len(rows) == ann.FIRST_RING and np.allclose(dots, mat[rows] @ q) and 3 not in rows
    rows, _, far = ann.verified(q, np.ones(500, bool), mat, distance.copy(), float(want[0]) - 1, longest, 1.0, 1e-9, 5)
    assert len(rows) == 0 or far == float(want[0]) - 1
