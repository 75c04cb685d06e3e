import random

import pytest
import xxhash

from emberlog.llm import simhash


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_masks_cover_every_pair_within_the_radius():
    for bits, radius in ((64, 2), (42, 2), (16, 3)):
        masks = simhash.covering_masks(bits, radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(1)
        for _ in range(2000):
            diff = sum(1 << i for i in rng.sample(range(bits), radius))
            assert any(diff & m == 0 for m in masks)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(60)]
    out = [None, "", "  \t", "One", "one", "One two", "É a b c", "é a b c"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 400))]
        out.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(vocab)
            out.append("  ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    return out


def test_query_equals_brute_force(spark, texts, tmp_path, monkeypatch):
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    fps = {i: brute_fp(t) for i, t, _ in rows}
    want = brute_components(fps)
    assert len(set(want.values())) < len(set(fps.values())) < len(rows)
    for size in (65_536, 2):  # 2: every bucket is dealt out by midpoints
        monkeypatch.setattr(simhash, "BUCKET_ROWS", size)
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op10_simhash(spark, str(tmp_path)).collect()}
        assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_repeated_and_null_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (2, None), (None, "zz")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.simhash_components(df).collect())
    assert got == [("2", "2"), ("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]


def test_links_of_random_values(spark, monkeypatch):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(8)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = brute_components({v: v for v in values})
    for size in (65_536, 2):
        monkeypatch.setattr(simhash, "BUCKET_ROWS", size)
        links = simhash.links_within_two(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
        assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 2 for r in links) or size == 65_536
        comp = {r["node"]: r["component"] for r in simhash.connected_components(spark.createDataFrame(links or [], "a long, b long")).collect()}
        groups = {}
        for s in signed:
            groups.setdefault(comp.get(s, s), set()).add(s & (2**64 - 1))
        other = {}
        for v in values:
            other.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_dedup_keeps_one_of_each_group_and_all_else(spark):
    rng = random.Random(3)
    vocab = ["word%d" % i for i in range(3000)]
    rows, family = [], {}
    for f in range(20):
        base = [rng.choice(vocab) for _ in range(200)]
        for c in range(4 if f < 10 else 1):
            text = list(base)
            if c:
                text[rng.randrange(200)] = "changed%d" % c
            family[len(rows)] = f
            rows.append((len(rows), " ".join(text), "en"))
    rows += [(3, rows[3][1], "en"), (None, rows[0][1], "en"), (500, None, "xx"), (501, "", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k1 string").repartition(3)
    got = sorted(r["doc_id"] for r in simhash.near_dedup(df.cache()).collect())
    firsts = sorted(min(i for i in family if family[i] == f) for f in range(20))
    assert got == [*firsts, 500]
    assert simhash.near_dedup(df.where("doc_id < 0")).count() == 0


def test_near_dedup_links_are_within_the_limit(spark):
    """Texts without a common shingle stay; of a text's beginning, 80 of 100 shingles are a near copy, 79 are none."""
    rng = random.Random(2)
    texts = [["w%d" % rng.randrange(1 << 30) for _ in range(104)] for _ in range(25)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(100, " ".join(texts[0][:84])), (101, " ".join(texts[1][:83]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    assert sorted(r["doc_id"] for r in simhash.near_dedup(df).collect()) == [*range(25), 101]
