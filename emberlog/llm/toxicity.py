"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j): pairs of terms, such as an
insult and the group that it is aimed at, count beyond what each adds by itself. Terms are
kept if they tell something alone or in a pair, so that a pair can be learned whose terms
tell nothing by themselves; keeping all terms of a small sample lowers held-out accuracy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .features import labelled_sample, row_sums, score_rows, toxicity_terms

BITS = 20
FACTORS = 8
#: The bound of the sample of labelled rows that the model is fitted on.
SAMPLE_ROWS = 12_288
#: The bound of the labelled rows of either label, evenly taken from the sample, that pairs of terms are counted in.
PAIR_ROWS = 4_096
#: Rows, and bytes of counts, that pairs of terms are counted in at once.
PAIR_CHUNK, PAIR_BYTES = 1_024, 32 << 20


@dataclass(frozen=True)
class Machine:
    """at gives a hashed term's place in w and v, -1 for terms that were not learned."""

    at: np.ndarray
    b: float
    w: np.ndarray
    v: np.ndarray

    def score(self, starts, terms, values) -> np.ndarray:
        place = self.at[terms]
        kept = place >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])
        starts, place, x = ends[starts], place[kept], values[kept].astype(np.float64)
        vx = self.v[place] * x[:, None]
        pairs = 0.5 * (row_sums(vx, starts) ** 2 - row_sums(vx**2, starts)).sum(1)
        z = self.b + row_sums(self.w[place] * x, starts) + pairs
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def z_of(a: np.ndarray, b: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """How many standard errors a log odds ratio is from 0: a of pos toxic rows and b of neg others have it."""
    a, b = a + 0.5, b + 0.5
    c, d = pos - a + 1.0, neg - b + 1.0
    return np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def deviance(a: np.ndarray, b: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """The root of the likelihood ratio statistic of the same table, which does not level off where a or b is 0."""
    n, total = a + b, pos + neg
    part = lambda o, e: np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    return np.sqrt(np.maximum(0.0, 2 * (part(a, n * pos / total) + part(b, n * neg / total) + part(pos - a, (total - n) * pos / total) + part(neg - b, (total - n) * neg / total))))


def least_count(pos: float, neg: float, toxic: bool, least: float) -> int | None:
    """The fewest rows of one label that can make a deviance of least, with none of the other; null if all rows do not suffice."""
    n = np.arange(1.0, (pos if toxic else neg) + 1)
    none = np.zeros(len(n))
    enough = np.flatnonzero(deviance(n if toxic else none, none if toxic else n, pos, neg) >= least)
    return int(n[enough[0]]) if len(enough) else None


def telling_pairs(y: np.ndarray, terms: np.ndarray, row: np.ndarray, bits: int, pair_z: float, pair_gain: float) -> np.ndarray:
    """Terms of pairs whose deviance is pair_z or more, and pair_gain more than that of either term.

    Every pair is looked at that its rows of one label alone could make telling; for those the rows
    of the other label are counted too. Blocks of terms, frequent ones first, meet all others in
    matrix products over PAIR_CHUNK rows, so rare terms meet only those that they are often enough with.
    """
    of_label = {k: np.flatnonzero(y == k) for k in (0, 1)}
    rows = {k: r[np.linspace(0, len(r) - 1, min(len(r), PAIR_ROWS)).astype(np.int64)] for k, r in of_label.items()}
    neg, pos = (float(len(rows[k])) for k in (0, 1))
    inside = np.zeros(len(y), bool)
    inside[np.concatenate([rows[0], rows[1]])] = True
    terms, row = terms[inside[row]], row[inside[row]]
    counts = np.stack([np.bincount(terms[y[row] == k], minlength=1 << bits).astype(np.float64) for k in (0, 1)])
    found: list[np.ndarray] = []
    for lead in (1, 0):
        least = least_count(pos, neg, bool(lead), pair_z)
        if least is None:
            continue
        own = np.flatnonzero(counts[lead] >= least)
        own = own[np.argsort(-counts[lead][own], kind="stable")]
        if len(own) < 2:
            continue
        place = np.full(1 << bits, -1, np.int32)
        place[own] = np.arange(len(own))
        at = place[terms]
        kept = at >= 0
        at, of = at[kept], row[kept]
        single = deviance(counts[1][own], counts[0][own], pos, neg)
        step = max(16, PAIR_BYTES // (4 * len(own)))

        def met(label: int, lo: int, columns: np.ndarray, at=at, of=of, rows=rows, own=own, step=step) -> np.ndarray:
            """Rows of a label that have a term of the block and one of the columns."""
            out = np.zeros((min(step, len(own) - lo), len(columns)), np.float32)
            all_columns = len(columns) == len(own)
            for first in range(0, len(rows[label]), PAIR_CHUNK):
                chunk = rows[label][first : first + PAIR_CHUNK]
                starts, ends = np.searchsorted(of, chunk), np.searchsorted(of, chunk, "right")
                size = ends - starts
                take = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
                x = np.zeros((len(chunk), len(own)), np.float32)
                x[np.repeat(np.arange(len(chunk)), size), at[take]] = 1
                out += x[:, lo : lo + step].T @ (x if all_columns else x[:, columns])
            return out

        for lo in range(0, len(own), step):
            led = met(lead, lo, np.arange(len(own)))
            often = led >= least
            often[np.arange(len(led)), lo + np.arange(len(led))] = False
            columns = np.flatnonzero(often.any(0))
            if not len(columns):
                continue
            other = met(1 - lead, lo, columns)
            i, c = np.nonzero(often[:, columns])
            a, b = led[i, columns[c]].astype(np.float64), other[i, c].astype(np.float64)
            pair = deviance(a, b, pos, neg) if lead else deviance(b, a, pos, neg)
            tells = (pair >= pair_z) & (pair >= np.maximum(single[lo + i], single[columns[c]]) + pair_gain)
            found += [own[lo + i[tells]], own[columns[c[tells]]]]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def telling_terms(y: np.ndarray, terms: np.ndarray, row: np.ndarray, bits: int, least_z: float = 4.0, least_rows: int = 4, pair_z: float = 8.0, pair_gain: float = 4.0) -> np.ndarray:
    """Terms that tell something alone or in pairs; rows are in order, and no term is twice in one.

    Alone: their log odds ratio with the label is least_z standard errors from 0 or more, in least_rows rows.
    In pairs: see telling_pairs(); how frequent a term is does not keep it from being looked at.
    """
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    b, a = (np.bincount(terms[y[row] == k], minlength=1 << bits).astype(np.float64) for k in (0, 1))
    alone = (np.abs(z_of(a, b, pos, neg)) >= least_z) & (a + b >= least_rows)
    alone[telling_pairs(y, terms, row, bits, pair_z, pair_gain)] = True
    return np.flatnonzero(alone)


def loss_and_gradient(p: list[np.ndarray], i: np.ndarray, x: np.ndarray, ptr: np.ndarray, y: np.ndarray, l2: float) -> tuple[float, list[np.ndarray]]:
    """Mean log loss of rows, with half of l2 times the squares of w and v, and its gradient in [b, w, v].

    i and x are terms and values, row by row from ptr on.
    """
    of = np.repeat(np.arange(len(y)), np.diff(ptr))
    vx = p[2][i] * x[:, None]
    sums = row_sums(vx, ptr)
    z = p[0][0] + row_sums(p[1][i] * x, ptr) + 0.5 * (sums**2 - row_sums(vx**2, ptr)).sum(1)
    err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    n, k = p[2].shape
    g_v = (err[of] * x)[:, None] * (sums[of] - vx)
    g = [np.array([err.sum()]), np.bincount(i, weights=err[of] * x, minlength=n) + l2 * p[1], np.stack([np.bincount(i, weights=g_v[:, c], minlength=n) for c in range(k)], 1) + l2 * p[2]]
    loss = np.logaddexp(0, -z * (2 * y - 1)).mean() + 0.5 * l2 * sum((q**2).sum() for q in p[1:])
    return float(loss), g


def fit(label: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 40, batch: int = 256, rate: float = 0.02, l2: float = 1e-4, seed: int = 7) -> Machine:
    """Minimises log loss with Adam in small batches. One label, or no rows, gives a constant."""
    y = (label > 0).astype(np.int64)
    at = np.full(1 << bits, -1, np.int32)
    share = (y.sum() + 0.5) / (len(y) + 1)
    b = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Machine(at, b, np.zeros(0), np.zeros((0, factors)))
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    own = telling_terms(y, terms, row, bits)
    at[own] = np.arange(len(own))
    kept = at[terms] >= 0
    idx, row, x = at[terms[kept]], row[kept], values[kept].astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(y)))])
    rng = np.random.default_rng(seed)
    p = [np.array([b]), np.zeros(len(own)), rng.normal(0, 0.05, (len(own), factors))]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            rows = np.sort(order[lo : lo + batch])
            size = starts[rows + 1] - starts[rows]
            ptr = np.concatenate([[0], np.cumsum(size)])
            take = np.arange(ptr[-1]) + np.repeat(starts[rows] - ptr[:-1], size)
            _, g = loss_and_gradient(p, idx[take], x[take], ptr, y[rows], l2)
            t += 1
            for j in range(3):
                m[j] = 0.9 * m[j] + 0.1 * g[j]
                s[j] = 0.99 * s[j] + 0.01 * g[j] ** 2
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.99**t)) + 1e-8)
    return Machine(at, float(p[0][0]), p[1], p[2])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits on at most rows labelled documents; labels above 0 are toxic. Only texts and labels are looked at."""
    return fit(*labelled_sample(docs, labels, label_col, rows, toxicity_terms, BITS, id_col, text_col))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double from 0 to 1) of every whole text.

    A null text is scored as an empty one: by the model's constant. Null and repeated
    ids are kept, one row out for each row in; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return score_rows(docs, toxicity_terms, BITS, lambda *x: [shared.value.score(*x)], ["score"], id_col, text_col)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document scored by a model of the labels that are not held out."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels.where(fold != 0)))
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
