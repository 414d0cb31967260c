"""Linear, ridge and lasso regression of every fold from one pass over the rows.

The pass keeps, for each part of the rows, their number and the sums and products of features and label. Parts can be added and taken
away, so the training rows of a fold are all parts but its own, and a model's squared error on a part needs no second look
at the rows. What the models are solved from does not grow with the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.sums import summed

# Widest matrix of products that is kept; wider models are fitted by descent on the rows, with the same optimum.
WIDEST = 2_048
# Below this share of its own spread, what the other features leave of a feature is rounding.
_RANK = 1e-10
_ROUNDS = 200


@dataclass(frozen=True)
class Moments:
    """Number, sums and products of rows ``(features..., label)``, all taken from ``origin``."""

    n: float
    origin: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.n + other.n, self.origin, self.sums + other.sums, self.products + other.products)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.n - other.n, self.origin, self.sums - other.sums, self.products - other.products)

    @property
    def means(self) -> np.ndarray:
        return self.origin + self.sums / self.n

    def spread(self) -> np.ndarray:
        """Products of deviations from the means."""
        return self.products - np.outer(self.sums, self.sums) / self.n

    def squared_error(self, weights: np.ndarray, intercept: float) -> float:
        """Sum over the rows of (label - prediction) squared."""
        spread, means = self.spread(), self.means
        off = np.append(-weights, 1.0)
        return float(max(0.0, off @ spread @ off) + self.n * (means[-1] - intercept - means[:-1] @ weights) ** 2)

    def r2(self, weights: np.ndarray, intercept: float) -> float | None:
        total = self.spread()[-1, -1] if self.n else 0.0
        return float(1.0 - self.squared_error(weights, intercept) / total) if total > 0 else None


def moments(rows: DataFrame, part: Column, features: str = "features", label: str = "label") -> dict[int, Moments]:
    """The moments of the rows of every ``part`` (a small number); rows without a label take no part.

    Each task adds up its rows and hands on its sums, which are added in a shuffle.
    """
    given = rows.select(part.cast("int").alias("part"), vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).filter("y IS NOT NULL AND part IS NOT NULL")
    first = given.select("x", "y").first()
    if first is None:
        return {}
    origin = np.array([*first["x"], first["y"]])  # near the data, so that products of deviations keep their digits
    width = len(origin)
    upper = np.triu_indices(width)

    def add_up(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            z = np.column_stack([x, batch.column(2).to_numpy(zero_copy_only=False)]) - origin
            for p in np.unique(parts).tolist():
                own = z[parts == p]
                total = held.setdefault(p, [0.0, np.zeros(width), np.zeros((width, width))])
                total[0] += len(own)
                total[1] += own.sum(axis=0)
                total[2] += own.T @ own
        return {p: np.concatenate([[n], sums, products[upper]]) for p, (n, sums, products) in held.items()}

    found = {}
    for p, flat in summed(given, add_up).items():
        products = np.zeros((width, width))
        products[upper] = flat[width + 1 :]
        found[p] = Moments(float(round(flat[0])), origin, flat[1 : width + 1], products + np.triu(products, 1).T)
    return found


def total(parts: dict[int, Moments], but: int | None = None) -> Moments | None:
    """All parts together, or all but one; None without rows."""
    kept = [m for p, m in parts.items() if p != but]
    return reduce(add, kept) if kept else None


# -- solutions, each (weights, intercept) ---------------------------------------------------------


def _scaled(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which features vary, their deviations, correlations, and covariances with the label over the deviations."""
    spread = m.spread() / m.n
    own = np.diag(spread)[:-1]
    scale = m.products.diagonal()[:-1] / m.n
    varies = np.flatnonzero(own > 1e-14 * scale)
    d = np.sqrt(own[varies])
    return varies, d, spread[np.ix_(varies, varies)] / np.outer(d, d), spread[varies, -1] / d


def _finished(m: Moments, varies: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, float]:
    full = np.zeros(len(m.sums) - 1)
    full[varies] = weights
    means = m.means
    return full, float(means[-1] - means[:-1] @ full)


def least_squares(m: Moments) -> tuple[np.ndarray, float]:
    """min |y - Xw - b|^2; of all minima, as features may depend on each other, the one with the smallest weights."""
    varies, d, corr, target = _scaled(m)
    if not len(varies):
        return _finished(m, varies, np.zeros(0))
    values, vectors = np.linalg.eigh(corr)
    kept = values > _RANK * values[-1]
    weights = vectors[:, kept] @ ((vectors[:, kept].T @ target) / values[kept]) / d
    if not kept.all():
        free = vectors[:, ~kept] / d[:, None]  # directions that change no prediction
        weights -= free @ np.linalg.lstsq(free, weights, rcond=None)[0]
    return _finished(m, varies, weights)


def ridge(m: Moments, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """min |y - Xw - b|^2 + alpha |w|^2."""
    if alpha <= 0:
        return least_squares(m)
    varies, d, corr, target = _scaled(m)
    matrix = corr + np.diag(alpha / (m.n * d * d))
    u = np.linalg.solve(matrix, target)
    u += np.linalg.solve(matrix, target - matrix @ u)
    return _finished(m, varies, u / d)


def lasso(m: Moments, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """min |y - Xw - b|^2 / (2n) + alpha |w|_1: coordinate descent, then exactly on the features that stay."""
    if alpha <= 0:
        return least_squares(m)
    varies, d, corr, target = _scaled(m)
    penalty = alpha / d
    u = np.zeros(len(varies))
    rest = target.copy()  # covariances of the features with what is not explained yet
    size = max(1e-300, np.abs(target).max(initial=0.0))
    for _ in range(_ROUNDS):
        moved = 0.0
        for j in range(len(u)):
            pull = rest[j] + u[j]
            new = np.sign(pull) * max(abs(pull) - penalty[j], 0.0)
            if new != u[j]:
                rest -= corr[:, j] * (new - u[j])
                moved = max(moved, abs(new - u[j]))
                u[j] = new
        if moved <= 1e-12 * size:
            break
    return _finished(m, varies, _settled(corr, target, penalty, u, size) / d)


def _settled(corr: np.ndarray, target: np.ndarray, penalty: np.ndarray, u: np.ndarray, size: float) -> np.ndarray:
    """From a nearby ``u`` to the minimum: Newton steps on the active features, each up to the first sign that would change.

    Where active features depend on each other the step goes along what they leave free, which makes one of them leave.
    """
    active, signs = [int(j) for j in np.flatnonzero(u)], np.sign(u)
    for _ in range(20 * len(u) + 20):
        rest = target - corr @ u
        off = rest[active] - penalty[active] * signs[active]
        if not len(active) or np.abs(off).max() <= 1e-12 * size:
            too_far = np.abs(rest) - penalty * (1 + 1e-10) - 1e-12 * size
            too_far[active] = -1.0
            j = int(np.argmax(too_far)) if len(too_far) else -1
            if j < 0 or too_far[j] <= 0:
                break
            active.append(j)
            signs[j] = np.sign(rest[j])
            continue
        own = corr[np.ix_(active, active)]
        values, vectors = np.linalg.eigh(own)
        kept = values > _RANK * values[-1]
        along = vectors.T @ off
        free = vectors[:, ~kept] @ along[~kept]
        if np.abs(free).max(initial=0.0) > 1e-9 * np.abs(off).max():
            step, most = free, np.inf
        else:
            step, most = vectors[:, kept] @ (along[kept] / values[kept]), 1.0
        at = u[active]
        with np.errstate(divide="ignore", invalid="ignore"):
            crossing = np.where(signs[active] * step < 0, -at / step, np.inf)
        first = int(np.argmin(crossing))
        if crossing[first] <= most:
            u[active] = at + crossing[first] * step
            u[active[first]] = 0.0
            active.pop(first)
        elif np.isinf(most):
            break  # nothing leaves: rounding only
        else:
            u[active] = at + step
    return u


SOLVERS = {"linear": lambda m: least_squares(m), "ridge": lambda m: ridge(m), "lasso": lambda m: lasso(m)}


# -- models ---------------------------------------------------------------------------------------


def as_model(spark: SparkSession, weights: np.ndarray, intercept: float, features: str = "features") -> LinearRegressionModel:
    """A fitted model of the library Spark ships, so that it transforms, saves and loads like one."""
    from pyspark.ml.common import _py2java

    made = spark._jvm.org.apache.spark.ml.regression.LinearRegressionModel(f"linear_{uuid.uuid4().hex[:12]}", _py2java(spark.sparkContext, Vectors.dense(weights)), float(intercept))
    model = LinearRegressionModel(made)
    return model.setFeaturesCol(features)


def width_of(rows: DataFrame, features: str = "features") -> int:
    first = rows.select(features).first()
    return len(first[0]) if first else 0


def fit(rows: DataFrame, solver, features: str = "features", label: str = "label") -> LinearRegressionModel:
    """A model of all rows by one of the solutions above."""
    found = total(moments(rows, F.lit(0), features, label))
    if found is None:
        raise ValueError("no rows to fit a model on")
    return as_model(rows.sparkSession, *solver(found), features)


def descend(train: DataFrame, name: str, alpha: float = 1.0, features: str = "features", label: str = "label") -> LinearRegressionModel:
    """The same three models for more features than products are kept of."""
    if name == "linear":
        return LinearRegression(regParam=0.0, labelCol=label, featuresCol=features).fit(train)
    if name == "ridge":  # the penalty is divided by n and by the label's deviation
        n, spread = train.agg(F.count("*"), F.stddev_pop(label)).first()
        return LinearRegression(regParam=alpha * (spread or 0.0) / n, elasticNetParam=0.0, standardization=False, labelCol=label, featuresCol=features).fit(train)
    return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, tol=1e-10, maxIter=1000, labelCol=label, featuresCol=features).fit(train)
