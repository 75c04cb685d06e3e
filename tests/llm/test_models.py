import random

import numpy as np
import pytest

from emberlog.llm import quality, toxicity
from emberlog.llm.features import Hashed, row_sums


def auc(label, score):
    label, score = np.asarray(label), np.asarray(score)
    a, b = score[label == 1], score[label == 0]
    return (a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()


@pytest.fixture(scope="module")
def graded(spark):
    """Three grades: good words, some junk, mostly junk."""
    rng = random.Random(2)
    good, junk = ["alpha", "beta", "gamma", "delta"], ["###", "!!", "zz|zz"]
    rows = []
    for i in range(600):
        g = i % 3
        rows.append((i, " ".join(rng.choice(good) if rng.random() < (0.2, 0.6, 0.95)[g] else rng.choice(junk) for _ in range(40)), g))
    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in rows] + [(9_000, None, "a"), (9_001, "", "b"), (None, "alpha beta", "c"), (0, rows[0][1], "d")], "doc_id long, text string, selected string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    return docs, labels


def test_ordinal_grades(spark, graded):
    docs, labels = graded
    model = quality.train(docs, labels.where("doc_id % 5 <> 0"))
    assert model.grades == (0, 1, 2) and model.theta[0] < model.theta[1]
    rows = quality.score(docs, model).collect()
    assert len(rows) == 604
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] % 5 == 0]
    by = [np.mean([r["expected_grade"] for r in held if r["doc_id"] % 3 == g]) for g in range(3)]
    assert by[0] < 0.5 < by[1] < 1.5 < by[2]
    assert auc([int(r["doc_id"] % 3 == 2) for r in held], [r["tail_prob"] for r in held]) > 0.95
    lower = {r["doc_id"]: r["tail_prob"] for r in quality.score(docs, model, select_grade=1).collect()}
    assert all(lower[r["doc_id"]] >= r["tail_prob"] for r in held)
    kept = quality.keep_selected(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["selected"])


def test_one_grade_selects_everything(spark, graded):
    docs, labels = graded
    model = quality.train(docs, labels.where("quality = 1"))
    assert quality.score(docs, model).where("selected").count() == 604
    assert quality.keep_selected(docs, model).count() == 604
    empty = quality.train(docs, labels.where("quality = 99"))
    assert quality.score(docs.where("doc_id < 0"), empty).count() == 0


def test_machine_learns_pairs_that_no_weight_shows():
    """Toxic only where an insult meets a group: each term alone is as frequent in both classes."""
    rng = random.Random(6)
    memo = Hashed(toxicity.BITS)
    texts, label = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(["the", "and", "with", "from"]) for _ in range(10)] + ["fool"] * insult + ["nation"] * group
        rng.shuffle(words)
        texts.append(" ".join(words))
        label.append(int(insult == group))
    found = [toxicity.toxicity_terms(t, memo) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])])
    terms, vals = np.concatenate([x for x, _ in found]), np.concatenate([v for _, v in found])
    model = toxicity.fit(np.array(label), starts, terms, vals)
    assert 2 <= len(model.w) < 20
    assert auc(label, model.score(starts, terms, vals)) > 0.95
    linear = toxicity.Machine(model.at, model.b, model.w, np.zeros_like(model.v))
    assert auc(label, linear.score(starts, terms, vals)) < 0.7


def test_query_on_held_out_documents(spark, tmp_path):
    rng = random.Random(1)
    vocab = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        toxic = rng.random() < 0.2
        rows.append((i, " ".join([rng.choice(vocab) for _ in range(30)] + (["idiot"] if toxic else []))))
        labels.append((i, int(toxic)))
    rows += [(5_000, None), (5_001, ""), (None, "idiot")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op7_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1200]
    assert 150 < len(held) < 330
    truth = dict(labels)
    assert auc([truth[r["doc_id"]] for r in held], [r["score"] for r in held]) > 0.95
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)


def test_row_sums():
    v = np.arange(6.0)
    assert row_sums(v, np.array([0, 0, 2, 6])).tolist() == [0, 1, 14]


def machine_score(model, terms, values):
    """The machine's sum over pairs, one by one."""
    known = [(model.at[t], x) for t, x in zip(terms, values) if model.at[t] >= 0]
    z = model.b + sum(model.w[i] * x for i, x in known)
    for a, (i, x) in enumerate(known):
        for j, y in known[a + 1 :]:
            z += float(model.v[i] @ model.v[j]) * x * y
    return 1 / (1 + np.exp(-z))


def test_machine_scores_equal_brute_force():
    rng = np.random.default_rng(3)
    at = np.full(1 << 10, -1, np.int32)
    at[:40] = rng.permutation(40)
    model = toxicity.Machine(at, -0.3, rng.normal(size=40), rng.normal(size=(40, toxicity.FACTORS)) / 3)
    rows = [(rng.choice(80, n, replace=False).astype(np.int32), rng.random(n).astype(np.float32)) for n in (0, 1, 2, 9, 30)]
    starts = np.cumsum([0, *(len(t) for t, _ in rows)])
    got = model.score(starts, np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]))
    assert np.allclose(got, [machine_score(model, t, v) for t, v in rows], atol=1e-9)


def test_gradient_of_the_machine_equals_differences():
    rng = np.random.default_rng(4)
    ptr = np.array([0, 3, 3, 8, 12])
    i, x, y = rng.integers(0, 6, 12), rng.random(12), np.array([1, 0, 1, 0])
    p = [np.array([0.2]), rng.normal(size=6), rng.normal(size=(6, 3))]
    _, g = toxicity.loss_and_gradient(p, i, x, ptr, y, 0.1)
    for k in range(3):
        for at in np.ndindex(p[k].shape):
            moved = []
            for e in (1e-5, -1e-5):
                q = [a.copy() for a in p]
                q[k][at] += e
                loss, _ = toxicity.loss_and_gradient(q, i, x, ptr, y, 0.1)
                # The constant is not held back.
                moved.append(loss)
            assert abs((moved[0] - moved[1]) / 2e-5 - g[k][at]) < 1e-6


def test_ordinal_fit_reaches_the_likelihood_of_a_plain_one():
    """A slow fit of the same likelihood by plain steps along differences finds nothing better."""
    rng = np.random.default_rng(6)
    n, dims = 400, 4
    x = rng.random((n, dims))
    grade = np.digitize(x @ np.array([3.0, -2.0, 1.0, 0.0]) + rng.logistic(size=n) * 0.5, [0.5, 1.5])
    starts, terms, values = np.arange(0, n * dims + 1, dims), np.tile(np.arange(dims), n), x.ravel()

    def loss(w, theta):
        s = x @ w
        f = lambda t: 1 / (1 + np.exp(-(t - s)))
        ends = np.stack([np.zeros(n), *(f(t) for t in theta), np.ones(n)], 1)
        prob = ends[np.arange(n), grade + 1] - ends[np.arange(n), grade]
        return -np.log(np.maximum(prob, 1e-12)).mean() + 0.5 * 1e-5 * (w @ w)

    model = quality.fit(grade, starts, terms, values, bits=2, steps=1_500)
    assert list(model.theta) == sorted(model.theta)
    best = loss(model.weights, model.theta)
    p = np.concatenate([np.zeros(dims), [0.0, 1.0]])
    for _ in range(1_500):
        g = np.array([(loss((p + e)[:dims], (p + e)[dims:]) - loss((p - e)[:dims], (p - e)[dims:])) / 2e-5 for e in 1e-5 * np.eye(len(p))])
        p = p - 1.0 * g
    assert best <= loss(p[:dims], p[dims:]) + 1e-3
    tails = model.tails(starts, terms, values)
    assert np.allclose(tails, 1 / (1 + np.exp(-((x @ model.weights)[:, None] - model.theta))))


def test_pairs_are_found_among_many_frequent_terms():
    """1,300 fillers, each in 62 % of rows, are more frequent than the pair's terms."""
    rng = np.random.default_rng(8)
    n, fillers = 4_000, 1_300
    a, b = rng.random(n) < 0.3, rng.random(n) < 0.3
    y = (a & b).astype(np.int64)
    rows = [np.concatenate([np.flatnonzero(rng.random(fillers) < 0.62) + 2, np.flatnonzero([a[i], b[i]])]) for i in range(n)]
    starts = np.cumsum([0, *map(len, rows)])
    terms = np.concatenate(rows).astype(np.int32)
    own = toxicity.telling_terms(y, terms, np.repeat(np.arange(n), np.diff(starts)), 11)
    assert {0, 1} <= set(own.tolist())
    # The label of the other case is whether both or none are there, so rows with one of them count against it.
    same = (a == b).astype(np.int64)
    own = toxicity.telling_terms(same, terms, np.repeat(np.arange(n), np.diff(starts)), 11)
    assert {0, 1} <= set(own.tolist()) and len(own) < 20
    train, test = slice(0, 3_000), slice(3_000, n)
    model = toxicity.fit(same[train], starts[:3_001], terms[: starts[3_000]], np.ones(starts[3_000], np.float32), bits=11, epochs=20)
    score = model.score(starts[3_000:] - starts[3_000], terms[starts[3_000] :], np.ones(len(terms) - starts[3_000], np.float32))
    truth = same[test] == 1
    assert (score[truth][:, None] > score[~truth]).mean() > 0.95


def test_pairs_equal_brute_force():
    rng = np.random.default_rng(9)
    n, dims = 600, 40
    x = rng.random((n, dims)) < rng.uniform(0.05, 0.6, dims)
    y = ((x[:, 0] & x[:, 1]) | (rng.random(n) < 0.05)).astype(np.int64)
    row, terms = np.nonzero(x)
    want = set()
    pos, neg = float(y.sum()), float(n - y.sum())
    g = lambda m: float(toxicity.deviance(np.array([float((m & (y == 1)).sum())]), np.array([float((m & (y == 0)).sum())]), pos, neg)[0])
    for i in range(dims):
        for j in range(i):
            pair = g(x[:, i] & x[:, j])
            if pair >= 5 and pair >= max(g(x[:, i]), g(x[:, j])) + 1:
                want |= {i, j}
    before = toxicity.PAIR_BYTES
    try:
        toxicity.PAIR_BYTES = 1
        assert set(toxicity.telling_pairs(y, terms.astype(np.int32), row, 6, 5.0, 1.0).tolist()) == want and want
    finally:
        toxicity.PAIR_BYTES = before
