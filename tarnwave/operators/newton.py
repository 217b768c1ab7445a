"""Logistic regressions of many folds and penalties at once, by Newton steps over grouped sums.

A pass over the rows gives every model's loss, gradient and curvature: a task folds its rows into one small matrix for
each model, and only these are added up. All models move in the same pass, so passes grow neither with the channels nor
with the penalties, and rows are never copied for a fold: a row simply doesn't count for the fold it belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwave.operators.folds import folded

#: Folds at most; more channels share folds. So what comes back to the driver is bounded, whatever the table's size.
FOLDS = 64
#: The fold of rows that count for every model.
NONE = -1


@dataclass(frozen=True)
class Models:
    """weights[fold, penalty]: one for each feature, the intercept last. A fold's model hasn't seen its rows."""

    features: tuple[str, ...]
    penalties: tuple[float, ...]
    weights: np.ndarray
    passes: int

    def scored(self, rows: DataFrame, fold: Column, penalty: int = 0) -> DataFrame:
        """rows with bit and confidence under the model of each row's fold; rows with a missing feature are left out."""
        table = F.array(*[F.array(*[F.lit(float(x)) for x in w[penalty]]) for w in self.weights])
        w = F.element_at(table, fold.cast("int") + 1)
        z = sum((F.col(c) * F.element_at(w, j + 1) for j, c in enumerate(self.features)), F.element_at(w, len(self.features) + 1))
        p = 1 / (1 + F.exp(-z))
        known = rows.dropna(subset=list(self.features))
        return known.select(*rows.columns, (p > 0.5).cast("long").alias("bit"), (2 * F.abs(p - 0.5)).alias("confidence"))


def fold_of(df: DataFrame, key: str, most: int = FOLDS) -> DataFrame:
    """df with fold and __folds: the number of its key among the distinct keys, in order, or a hash of it beyond `most` keys.

    Up to `most` keys, each is a fold of its own, as leaving one channel out asks for.
    """
    keys = [r[0] for r in df.select(key).distinct().orderBy(key).limit(most + 1).collect()]
    if len(keys) > most:
        return df.withColumns({"fold": F.pmod(F.xxhash64(key), F.lit(most)).cast("int"), "__folds": F.lit(most)})
    place = F.array_position(F.array(*map(F.lit, keys)), F.col(key)) - 1 if keys else F.lit(0)
    return df.withColumns({"fold": place.cast("int"), "__folds": F.lit(len(keys))})


def fit(table: DataFrame, features: Sequence[str], folds: int = 1, penalties: Sequence[float] = (1.0,), label: str = "label", fold: str | None = None, passes: int = 40, close: float = 1e-9) -> Models:
    """A model for each fold and penalty c, least in  c * sum of log losses + |weights|^2 / 2  (without the intercept).

    fold: the column that tells which of the folds' models a row must not count for (NONE or null: it counts for all);
    without it, all rows count. Rows with a missing feature or label are left out. A step that makes the loss greater is
    halved. Without rows, weights are 0.
    """
    d, shape = len(features) + 1, (folds, len(penalties))
    upper = np.triu_indices(d)
    names = ("loss", *(f"g{j}" for j in range(d)), *(f"h{j}" for j in range(len(upper[0]))))
    rows = table.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("__y"), (F.coalesce(F.col(fold), F.lit(NONE)) if fold else F.lit(NONE)).cast("int").alias("__fold")).dropna()
    c = np.array(penalties)
    ridge = np.r_[np.ones(d - 1), 0.0]

    def sums(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = weights.reshape(-1, d)

        def run(*cols: np.ndarray) -> np.ndarray:
            *x, y, own = cols
            x = np.stack([*x, np.ones(len(y))], 1)
            out = np.empty((len(flat), len(names)))
            for i, w in enumerate(flat):
                counts = own != i // len(c)
                xi, yi = x[counts], y[counts]
                z = xi @ w
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                h = (xi * (p * (1 - p))[:, None]).T @ xi
                out[i] = np.r_[(np.logaddexp(0, z) - yi * z).sum(), xi.T @ (p - yi), h[upper]]
            return out

        found = np.zeros((len(flat), len(names)))
        for r in folded(rows, [], [*features, "__y", "__fold"], names, len(flat), run).collect():
            found[r["i"]] = [r[x] for x in names]
        h = np.zeros((len(flat), d, d))
        h[:, upper[0], upper[1]] = found[:, 1 + d :]
        h[:, upper[1], upper[0]] = found[:, 1 + d :]
        each = np.tile(c, folds)
        loss = each * found[:, 0] + (flat * flat * ridge).sum(1) / 2
        return loss, each[:, None] * found[:, 1 : 1 + d] + flat * ridge, each[:, None, None] * h + np.diag(ridge)

    at = np.zeros((folds * len(c), d))
    loss, gradient, curve = sums(at)
    step = np.zeros_like(at)
    best, done = at.copy(), 0
    for done in range(1, passes + 1):
        for i in range(len(at)):
            step[i] = np.linalg.lstsq(curve[i], gradient[i], rcond=None)[0]
        size = np.ones(len(at))
        while True:
            tried = best - step * size[:, None]
            now = sums(tried)
            worse = now[0] > loss + 1e-9 * np.abs(loss)
            if not worse.any() or size.min() < 1e-6:
                break
            size[worse] /= 2
        moved = np.abs(tried - best).max()
        best, (loss, gradient, curve) = tried, now
        if moved < close:
            break
    return Models(tuple(features), tuple(penalties), best.reshape(*shape, d), done)
