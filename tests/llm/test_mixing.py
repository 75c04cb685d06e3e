import math

import duckdb

from emberlog.llm import mixing


def docs(spark, n=4000):
    rows = [(i, f"text {i}", "a" if i % 3 else "b", "orig") for i in range(n)] + [(None, None, None, "x"), (7, "text 7", "a", "orig")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no string")


def test_rates_reach_the_target_weights(spark):
    df = docs(spark)
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("unknown", 9.0), (None, 0.0)], "source string, weight double")
    out = mixing.mix(df, weights, total=8000).collect()
    counts = {s: sum(r["source"] == s for r in out) for s in ("a", "b", None)}
    assert counts[None] == 0 and abs(counts["b"] - 6000) < 300 and abs(counts["a"] - 2000) < 200
    copies = {}
    for r in out:
        copies.setdefault((r["doc_id"], r["source"]), []).append(r["copy_no"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) for k, c in copies.items() if k[0] != 7)


def test_counts_invert_the_distribution(spark):
    for rate in (0.3, 2.5, 40.0, 900.0):
        got = [r[0] for r in spark.range(2000).select(mixing.poisson((mixing.F.col("id") + 0.5) / 2000, mixing.F.lit(rate))).collect()]
        assert got == sorted(got) and abs(sum(got) / 2000 - rate) < 0.02 * rate + 0.02
        k = got[1000]
        below = sum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(k))
        assert below <= (1000.5) / 2000 < below + math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) + 1e-9


def test_same_ids_same_counts_and_the_order_is_mixed(spark):
    df = docs(spark)
    first = [tuple(r) for r in mixing.mix(df.repartition(5)).collect()]
    again = [tuple(r) for r in mixing.mix(df.repartition(2)).collect()]
    assert sorted(map(str, first)) == sorted(map(str, again))
    ids = [r[0] for r in first if r[0] is not None]
    assert sum(a < b for a, b in zip(ids, ids[1:])) < 0.6 * len(ids)
    assert df.columns == mixing.mix(df).columns


def test_empty_table(spark):
    assert mixing.mix(docs(spark).where("doc_id < 0")).count() == 0


def test_query_matches_its_sql(spark, tmp_path):
    docs(spark, 900).drop("copy_no").withColumn("lang", mixing.F.lit("en")).withColumn("n_chars", mixing.F.lit(5)).where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "text", "lang", "source", "n_chars", "copy_no"]
    want = sorted(c.sql(mixing.OP6_SQL).fetchall())
    assert sorted(tuple(r) for r in mixing.op6_mixing(spark, str(tmp_path)).select(names).collect()) == want
