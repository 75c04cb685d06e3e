"""Quality by ordinal cumulative-link regression.

P(grade >= k) = sigmoid(w.x - theta_k): one weight for each hashed term, shared by all
grades, and thresholds that are kept in order as a first one and positive steps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .features import labelled_sample, quality_terms, row_sums, score_rows

BITS = 16
#: The bound of the sample of labelled rows that the model is fitted on.
SAMPLE_ROWS = 8_192


@dataclass(frozen=True)
class Ordinal:
    """grades in order; theta has one fewer."""

    grades: tuple[int, ...]
    weights: np.ndarray
    theta: np.ndarray

    def tails(self, starts, terms, values) -> np.ndarray:
        """P(grade >= grades[k]) for k from 1, a row for each text."""
        s = row_sums(self.weights[terms] * values, starts)
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.theta, -40, 40)))


def fit(grade: np.ndarray, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, bits: int = BITS, steps: int = 150, rate: float = 0.1, l2: float = 1e-5) -> Ordinal:
    """Maximum likelihood with Adam over all rows at once. One grade, or no rows, gives a model without terms."""
    levels = np.unique(grade)
    if len(levels) < 2:
        return Ordinal(tuple(levels.tolist()) or (0,), np.zeros(1 << bits), np.empty(0))
    y = np.searchsorted(levels, grade)
    k = len(levels) - 1
    above = 1 - np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / len(y)
    theta = -np.log(above / (1 - above))
    # The first threshold and the logarithms of the steps between thresholds.
    p = np.concatenate([np.zeros(1 << bits), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    n, dims = len(y), 1 << bits
    for t in range(1, steps + 1):
        w, gaps = p[:dims], np.exp(p[dims + 1 :])
        theta = p[dims] + np.concatenate([[0], np.cumsum(gaps)])
        s = row_sums(w[terms] * values, starts)
        # P(y) = F(theta[y]) - F(theta[y-1]), F(theta) = sigmoid(theta - s)
        hi = np.where(y < k, sig(theta[np.minimum(y, k - 1)] - s), 1.0)
        lo = np.where(y > 0, sig(theta[np.maximum(y - 1, 0)] - s), 0.0)
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        g = np.zeros_like(p)
        g[:dims] = np.bincount(terms, weights=values * ((d_hi - d_lo) / n)[row], minlength=dims) + l2 * w
        g_theta = (-np.bincount(y[y < k], weights=d_hi[y < k], minlength=k) + np.bincount(y[y > 0] - 1, weights=d_lo[y > 0], minlength=k)) / n
        g[dims] = g_theta.sum()
        g[dims + 1 :] = gaps * np.cumsum(g_theta[::-1])[::-1][1:]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    theta = p[dims] + np.concatenate([[0], np.cumsum(np.exp(p[dims + 1 :]))])
    return Ordinal(tuple(levels.tolist()), p[:dims].copy(), theta)


def train(docs: DataFrame, labels: DataFrame, grade_col: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Fits on at most rows labelled documents; grades may be any integers, two or more."""
    return fit(*labelled_sample(docs, labels, grade_col, rows, quality_terms, BITS, id_col, text_col))


def score(docs: DataFrame, model: Ordinal, select_grade: int | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, expected_grade, tail_prob, selected) of every whole text.

    tail_prob is the probability of select_grade (the highest if None) or more; a text
    is selected from least on. A null text is scored as an empty one. Null and repeated
    ids are kept, one row out for each row in; other columns are ignored. A model fitted
    without two grades selects everything.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    levels = np.array(model.grades, np.float64)
    at = len(levels) - 1 if select_grade is None else int(np.searchsorted(levels, select_grade))

    def run(starts, terms, values):
        tails = shared.value.tails(starts, terms, values)
        full = np.concatenate([np.ones((len(tails), 1)), tails], axis=1)
        expected = levels[0] + (full[:, 1:] * np.diff(levels)).sum(1)
        return expected, full[:, at] if at < len(levels) else np.zeros(len(tails))

    out = score_rows(docs, quality_terms, BITS, run, ["expected_grade", "tail_prob"], id_col, text_col)
    return out.withColumn("selected", F.col("tail_prob") >= least)


def keep_selected(docs: DataFrame, model: Ordinal, select_grade: int | None = None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model selects, with all their columns; nothing is shuffled."""
    import pyarrow as pa

    from .common import small_batches
    from .features import Hashed

    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = len(model.grades) - 1 if select_grade is None else int(np.searchsorted(np.array(model.grades), select_grade))

    def run(batches):
        memo = Hashed(BITS)
        for b in batches:
            found = [quality_terms(t, memo) for t in b.column(text_col).to_pylist()]
            if not found or at == 0:
                yield b
                continue
            starts = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]).astype(np.int64)
            tails = shared.value.tails(starts, np.concatenate([x for x, _ in found]), np.concatenate([v for _, v in found]))
            yield b.filter(pa.array(tails[:, at - 1] >= least) if at <= tails.shape[1] else pa.array(np.zeros(len(tails), bool)))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Every document graded by a model of labels.quality."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
