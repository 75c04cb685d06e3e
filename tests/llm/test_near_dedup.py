import random

import numpy as np
import pytest

from emberlog.llm import common, jaccard, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_kept(rows):
    """The smallest id of each component of all pairs at 0.8 and more."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in sets})


def kept(spark, rows, partitions=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions).cache()
    return sorted(r["doc_id"] for r in simhash.near_dedup(df).select("doc_id").collect())


def test_added_cut_moved_and_swapped_passages_equal_brute_force(spark):
    rng = random.Random(11)
    draw = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for f in range(24):
        base = draw(rng.randint(30, 500))
        n = len(base)
        k = int(n * rng.uniform(0.02, 0.26))
        at = rng.randrange(n - k)
        moved = base[:at] + base[at + k :]
        to = rng.randrange(len(moved))
        swapped = list(base)
        for _ in range(max(1, k // 6)):
            swapped[rng.randrange(n)] = draw(1)[0]
        for text in (base, base[:at] + draw(k) + base[at:], moved, moved[:to] + base[at : at + k] + moved[to:], swapped):
            rows.append((len(rows), " ".join(text)))
    want = brute_kept(rows)
    assert 24 < len(want) < 100
    assert kept(spark, rows) == want


def test_texts_of_the_same_words_in_another_order_stay(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(20):
        base = [f"w{rng.randrange(3000)}" for _ in range(240)]
        blocks = [base[i : i + 6] for i in range(0, 240, 6)]
        rng.shuffle(blocks)
        few = list(base)
        for i in rng.sample(range(240), 12):
            few[i] = f"w{rng.randrange(3000)}"
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate((base, sum(blocks, []), few))]
    want = brute_kept(rows)
    assert len(want) == len(rows)
    assert kept(spark, rows) == want


@pytest.mark.parametrize("small", [16, 2])  # 2: all but the smallest buckets go through leaders and blocks
def test_drifting_copies_are_the_same_for_one_and_many_partitions(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", small)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "NEAREST", (1,))
    rng = random.Random(8)
    rows = []
    for _ in range(6):
        text = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(24):  # each a few words from one before it, so that no leader is near all
            rows.append((rng.randrange(10**6), " ".join(text)))
            text = rng.choice(rows[-3:])[1].split() if rng.random() < 0.2 else text
            text = list(text)
            for _ in range(rng.choice([1, 1, 2, 3])):
                text[rng.randrange(120)] = f"w{rng.randrange(3000)}"
    want = brute_kept(rows)
    assert 6 < len(want) < 120
    for partitions in (1, 8):
        assert kept(spark, rows, partitions) == want


def test_a_prefix_of_each_similar_pair_shares_a_shingle():
    rng = np.random.default_rng(1)
    for _ in range(500):
        n = int(rng.integers(1, 200))
        both = rng.integers(1, 1 << 62, n).astype("<u8")
        gone, new = int(rng.integers(0, n // 9 + 1)), int(rng.integers(0, n // 9 + 1))
        x, y = np.unique(both), np.unique(np.concatenate([both[gone:], rng.integers(1, 1 << 62, new).astype("<u8")]))
        common = np.unique(rng.choice(x, min(len(x), 20)))
        counts = rng.integers(2, 50, len(common))
        if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
            assert len(np.intersect1d(jaccard.prefix(x, common, counts), jaccard.prefix(y, common, counts)))


def test_sketches_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(2)
    for n in (3, 60, 129, 700, 5000):
        for _ in range(30):
            both = rng.integers(1, 1 << 62, n).astype("<u8")
            x, y = np.unique(both), np.unique(np.concatenate([both[int(rng.integers(0, n // 8 + 1)) :], rng.integers(1, 1 << 62, n // 16).astype("<u8")]))
            a, b = (np.frombuffer(jaccard.sketch(s), np.uint8).astype(int) for s in (x, y))
            bins = min(len(a), len(b))
            apart = len(np.setxor1d(x, y))
            assert np.abs(jaccard.folded(a, bins) - jaccard.folded(b, bins)).sum() <= apart
            if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
                assert 9 * apart <= len(x) + len(y) and jaccard.sizes_match(len(x), len(y))


def test_hot_bucket_of_many_sizes_equals_brute_force(spark, monkeypatch):
    """Texts of very different lengths share a passage; blocks hold sketches of several sizes."""
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for i in range(90):
        own = passage + [f"w{rng.randrange(9000)}" for _ in range(rng.choice([5, 20, 30, 36, 60, 400]))]
        rows.append((i, " ".join(own)))
    want = brute_kept(rows)
    assert 5 < len(want) < 80
    assert kept(spark, rows, 5) == want


def test_shingles_of_few_of_many_texts_come_last_in_the_order(spark, monkeypatch):
    """A sample of a fixed number of texts saw a shingle of 60 texts the less often the more texts there are."""
    monkeypatch.setattr(jaccard, "SAMPLE_TEXTS", 16)
    rows = [(f"text {i} " + " ".join(f"w{i}x{j}" for j in range(6)) + f" this line is in sixty texts {i % 40}",) for i in range(2400)]
    hashes = lambda t: jaccard.shingle_set(simhash.words(t), jaccard.WordHashes())
    sets = lambda batches: ([hashes(t) for t in b.column("_text").to_pylist()] for b in batches)
    found, counts = jaccard.common_shingles(spark.createDataFrame(rows, "_text string"), sets)
    shared = np.unique(np.concatenate([hashes(f"is in sixty texts {i}") for i in range(40)]))
    assert len(np.intersect1d(found, shared)) >= 36 and (counts > 1).all()
    monkeypatch.setattr(jaccard, "COMMON", 3)
    fewer, times = jaccard.common_shingles(spark.createDataFrame(rows, "_text string"), sets)
    assert 0 < len(fewer) <= 3 and times.min() > counts.min()


def test_a_row_of_a_bucket_that_one_block_holds_is_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    cols = "key long, id long, comp long, todo boolean, major long, whole boolean, nm int, nr int"
    one = spark.createDataFrame([(1, i, i if i % 3 else 0, True, 0, True, 1, 1) for i in range(60)], cols)
    got = jaccard.dealt(one).collect()
    assert len(got) == 60 and {(r.p, r.q) for r in got} == {(0, -2)} and {r.id for r in got if r.own == -1} == {*range(0, 60, 3)}
    more = spark.createDataFrame([(1, i, i if i % 3 else 0, True, 0, False, 3, 5) for i in range(60)], cols)
    assert jaccard.dealt(more).count() == 20 + 40 * (3 + 5)


@pytest.mark.parametrize("most", [50_000, 7])
def test_joined_edges_are_those_of_connected_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "TASK_EDGES", most)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(-90, 90), rng.randrange(100, 160)) for _ in range(60)] + [(300, 300), (None, 3), (400, -400)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = {(r.node, r.component) for r in common.connected_components(df).collect()}
    got = [(r.node, r.component) for r in common.joined(df.cache()).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert common.joined(df.where("a > 1000")).count() == 0
