"""Toxicity: a character n-gram linear classifier with naive-Bayes-scaled features.

Features: presence of character n-grams (code points, lower case, sizes in SIZES) hashed into a
fixed table. Each feature is scaled by its naive Bayes log-count ratio on the labelled rows, and
a logistic regression is fitted to the scaled features. Scoring reads every whole text on the
executors; training uses a bounded, documented sample of labelled rows (see fit).

The model is one float32 table of 2**BITS weights (1 MB at the default), whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (5,)
BITS = 18
#: At most about so many labelled rows of each class are learned from.
SAMPLE_PER_CLASS = 1500
#: Longer texts (bytes) are scored but not learned from, so that the sample is bounded in bytes too.
LONGEST = 1 << 16
PIECE = 1 << 20
FOLDS = 3


def features(text: str, bits: int = BITS, sizes: tuple[int, ...] = SIZES):
    """Table indices of the n-grams of a whole text, piece by piece, repeats included."""
    low = f" {text.lower()} "
    for at in range(0, len(low), PIECE):
        a = np.frombuffer(low[at : at + PIECE + max(sizes) - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = a
        for n in range(2, max(sizes) + 1):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + a[n - 1 :]
            if n in sizes:
                yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int
    sizes: tuple[int, ...]

    def logit(self, text: str, flags: np.ndarray) -> float:
        flags[:] = 0
        for idx in features(text, self.bits, self.sizes):
            flags[idx] = 1
        return float(flags @ self.weights) + self.bias


def _fit(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float, l2: float, rounds: int, least_df: int) -> tuple[np.ndarray, float]:
    """(weights, bias): log-count ratios, then logistic regression on the scaled features (Adam)."""
    held = np.zeros((2, size), np.int32)
    for r, label in zip(rows, y):
        held[int(label)][r] += 1
    n1 = int(y.sum())
    ratio = np.log(((alpha + held[1]) / (n1 + 2 * alpha)) / ((alpha + held[0]) / (len(y) - n1 + 2 * alpha))).astype(np.float32)
    # Rare features, and those that tell little (their scaled value is near zero), are left out.
    ratio[(held.sum(0) < least_df) | (np.abs(ratio) <= 0.5)] = 0
    rows = [r[ratio[r] != 0] for r in rows]
    row, cols = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]), np.concatenate(rows)
    value = ratio[cols]
    weight, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for k in range(1, rounds + 1):
        z = np.bincount(row, weights=value * weight[cols], minlength=len(y)) + bias
        err = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad, gb = np.bincount(cols, weights=value * err[row], minlength=size) + l2 * weight / len(y), err.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        step = 0.02 * np.sqrt(1 - 0.99**k) / (1 - 0.9**k)
        weight -= step * m / (np.sqrt(v) + 1e-9)
        bias -= step * mb / (np.sqrt(vb) + 1e-9)
    return (weight * ratio).astype(np.float32), float(bias)


def train(texts: list[str], toxic: list[int], rate: float | None = None, bits: int = BITS, sizes: tuple[int, ...] = SIZES, alpha: float = 1.0, l2: float = 30.0, rounds: int = 60, least_df: int = 3) -> Model:
    """Fit on labelled texts. One class only (or none): a constant model of that class's rate.

    The score 0.5 is put where logits of texts that a fold's model did not see split the classes
    with the fewest errors, if label 1 has the share `rate` (by default the sample's).
    """
    y = (np.asarray(toxic) > 0).astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), bits, sizes)
    rows = [np.unique(np.concatenate([*features(t, bits, sizes), np.empty(0, np.int64)])).astype(np.int32) for t in texts]
    fit = lambda pick: _fit([rows[k] for k in pick], y[pick], 1 << bits, alpha, l2, rounds, least_df)
    every, fold = np.arange(len(y)), np.zeros(len(y), int)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        fold[own] = np.arange(len(own)) % FOLDS
    shift = 0.0
    if y.sum() >= 2 * FOLDS <= len(y) - y.sum():
        z = np.zeros(len(y))
        for f in range(FOLDS):
            w, b = fit(every[fold != f])
            for k in every[fold == f]:
                z[k] = w[rows[k]].sum() + b
        share = y.mean() if rate is None else rate
        cost = np.where(y > 0, share / y.sum(), (1 - share) / (len(y) - y.sum()))
        order = np.argsort(z, kind="stable")
        # Errors where the first k of the order count as clean.
        errors = np.concatenate(([0], np.cumsum(np.where(y[order] > 0, cost[order], 0)))) + np.concatenate((np.cumsum(np.where(y[order] > 0, 0, cost[order])[::-1])[::-1], [0]))
        least = np.flatnonzero(errors <= errors.min() + 1e-12)
        k = int(least[len(least) // 2])
        shift = (z[order][max(k - 1, 0)] + z[order][min(k, len(z) - 1)]) / 2
    weights, bias = fit(every)
    return Model(weights, bias - float(shift), bits, sizes)


def sample_ids(rows: DataFrame, by: str, key: str, bound: int, most: int = 256, total: int = 1 << 30) -> DataFrame:
    """About `bound` keys at most of each value of `by`, chosen by a hash of the key.

    Counts every row; the thresholds follow from the counts, so the sample does not depend on
    how the table is split, and what it returns is bounded by the parameters. Of more than
    `most` values those with the most rows count, of equals the first; all share `total`.
    """
    counts = rows.groupBy(by).count().orderBy(F.desc("count"), by).limit(most).collect()
    bound = min(bound, total // max(len(counts), 1))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(by).eqNullSafe(F.lit(r[by])), F.lit(min(1.0, bound / r["count"]))).otherwise(share)
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(unit < share)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, train_fold=None) -> Model:
    """Learn from labelled documents.

    labels: doc_id, toxic (0 or 1). Rows with a null id or label are ignored; of conflicting
    labels of one id the toxic one counts; of repeated ids in docs the smallest text counts.
    train_fold: a Column on labels that is true for rows that may be learned from.
    per_class bounds the sample: about so many ids of each class reach the driver, without texts
    of more than LONGEST bytes. Without rows of both classes (an empty table too) the model is
    constant.
    """
    known = labels.where("doc_id is not null and toxic is not null")
    known = known.where(train_fold) if train_fold is not None else known
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("__toxic"))
    ids = sample_ids(known, "__toxic", "doc_id", per_class)
    # Bounded by per_class, so the broadcast is safe at any size of the corpus.
    short = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= LONGEST)
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "__toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    rate = known.agg(F.avg("__toxic")).first()[0]
    return train([r["text"] or "" for r in rows], [r["__toxic"] for r in rows], rate)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for each whole text; null counts as empty.

    Repeated rows get equal scores; no other column is read.
    """

    @F.arrow_udf("double")
    def of(a: pa.Array) -> pa.Array:
        flags = np.zeros(1 << model.bits, np.float32)
        z = np.array([model.logit(x or "", flags) for x in a.to_pylist()], np.float64)
        return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())

    return of(text)
