"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is the repetition rate
of its source. The number inverts the Poisson distribution at a uniform value that is a
hash of seed and id, so that it needs no state and any recomputation gives it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

#: Sources up to this number are broadcast: a name and two numbers each.
BROADCAST_SOURCES = 10_000
SEED = "mix-1"


def uniform(*parts: Column | str) -> Column:
    """A value in [0, 1) with 52 bits from a digest of the parts."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson(u: Column, rate: Column) -> Column:
    """The smallest k whose cumulative Poisson probability is above u; the sum ends 12 deviations past the mean."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 16).cast("int")
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0).cast("long").alias("n"), (-rate).alias("log_p"))

    def step(s: Column, k: Column) -> Column:
        cum = s["cum"] + F.exp(s["log_p"])
        return F.struct(cum.alias("cum"), (s["n"] + F.when(cum <= u, 1).otherwise(0)).alias("n"), (s["log_p"] + F.log(rate) - F.log(k + 1.0)).alias("log_p"))

    count = F.aggregate(F.sequence(F.lit(0), last), start, step, lambda s: s["n"])
    return F.when(rate > 0, count).otherwise(F.lit(0).cast("long"))


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, source_col: str = "source") -> DataFrame:
    """(_source, rate): the mean number of times a document of each source is repeated.

    weights(source, weight) are the target shares, scaled to sum to 1 over the sources
    that occur; a source without a weight gets 0. None means the square root of each
    source's number of documents. total is the number of documents wanted, as many as
    there are if None. Documents without a source are a source of their own.
    """
    found = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("_n"))
    if weights is None:
        found = found.withColumn("_w", F.sqrt("_n"))
    else:
        given = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w")).groupBy("_s").agg(F.sum("_w").alias("_w"))
        found = found.join(given, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "_n", F.greatest(F.coalesce("_w", F.lit(0.0)), F.lit(0.0)).alias("_w"))
    found = written(found, "mix-sources")
    n, all_weights = found.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    rate = F.lit(float(n if total is None else total)) * F.col("_w") / F.lit(all_weights) / F.col("_n")
    return found.select("_source", (rate if all_weights > 0 else F.lit(0.0)).alias("rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy_no") -> DataFrame:
    """docs with each row repeated by its Poisson count, in a global random order, and copy_col from 1.

    All columns are kept; an existing copy_col is replaced. Rows with the same id get
    the same count. A null id or source counts as a value of its own; texts are not
    looked at, so null, empty and very long ones are treated alike. An empty table
    gives an empty table. The order is that of a hash partition and, within it, of a
    digest of seed, id, copy number and the row's plain columns, so that it does not depend
    on the input's. A rate of a million makes a million copies of a row in its task.
    """
    rates = source_rates(docs, weights, total, source_col)
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    row = docs.select(F.struct("*").alias("_row"), F.col(source_col).alias("_of"), F.col(id_col).cast("string").alias("_id"))
    rates = F.broadcast(rates) if few else rates
    counted = row.join(rates, F.col("_of").eqNullSafe(F.col("_source")))
    copies = counted.withColumn("_count", poisson(uniform(F.lit(seed), "_id"), F.col("rate"))).where("_count > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_count").cast("int"))))
    # Of rows that share an id, or have none, the plain columns tell where they go.
    plain = [F.col("_row").getField(f.name) for f in docs.schema if isinstance(f.dataType, T.AtomicType) and f.dataType != T.VariantType()]
    order = F.xxhash64(F.lit(seed), F.col("_id"), F.col("_copy"), *plain)
    dealt = copies.withColumn("_order", order).repartition("_order").sortWithinPartitions(F.xxhash64(F.lit(f"{seed}|within"), F.col("_order")))
    return dealt.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() != copy_col.lower()], F.col("_copy").alias(copy_col))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to weights that are the square roots of the sources' sizes."""
    return mix(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s) * w / (SELECT sum(w) FROM s) / n AS rate FROM s),
p AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 16)::BIGINT + 1)) AS k FROM r),
c AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cum FROM p),
a AS (SELECT source, list(cum ORDER BY k) AS cums FROM c GROUP BY source),
d AS (SELECT d.*, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u,
      a.cums FROM documents d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
e AS (SELECT doc_id, text, lang, source, n_chars, len(list_filter(cums, lambda x: x <= u)) AS n FROM d)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INTEGER AS copy_no FROM e WHERE n > 0
"""
