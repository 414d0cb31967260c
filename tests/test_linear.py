import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from plumbline.config import EngineConfig
from plumbline.functions import sums
from plumbline.operators import linear, models


def moments_of(x, y):
    z = np.column_stack([x, y])
    origin = z[0].copy()
    d = z - origin
    return linear.Moments(float(len(z)), origin, d.sum(axis=0), d.T @ d)


def centred(x, y):
    return x - x.mean(axis=0), y - y.mean()


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) * [1, 300, 0.01, 5, 1, 2] + [1e5, -7, 3, 0, 1, 1]
    return x, x @ [3.0, 0.1, -50.0, 0.0, 2.0, 0.2] + rng.normal(size=500)


def test_solutions_by_their_conditions(data):
    x, y = data
    xc, yc = centred(x, y)
    m = moments_of(x, y)
    weights, intercept = linear.least_squares(m)
    assert np.allclose(weights, np.linalg.lstsq(xc, yc, rcond=None)[0], rtol=1e-7) and np.isclose(intercept, y.mean() - x.mean(axis=0) @ weights)
    for alpha in (0.5, 40.0):
        assert np.allclose(linear.ridge(m, alpha)[0], np.linalg.solve(xc.T @ xc + alpha * np.eye(6), xc.T @ yc), rtol=1e-7)
    for alpha in (0.001, 0.1, 1.0, 30.0, 1e6):
        check_lasso(xc, yc, linear.lasso(m, alpha)[0], alpha)
    assert m.squared_error(weights, intercept) == pytest.approx(((y - x @ weights - intercept) ** 2).sum(), rel=1e-6)


def check_lasso(xc, yc, w, alpha):
    """At the minimum the gradient is -alpha sign(w) on features kept and at most alpha on the others."""
    slope = xc.T @ (yc - xc @ w) / len(yc)
    size = np.sqrt((xc**2).mean(axis=0)) * yc.std() + alpha
    kept = np.abs(w) > 0
    assert np.all(np.abs(slope - alpha * np.sign(w))[kept] <= 1e-7 * size[kept])
    assert np.all(np.abs(slope)[~kept] <= alpha + 1e-7 * size[~kept])


def test_dependent_and_constant_features(data):
    x, y = data
    x = np.column_stack([x, 0.6 * x[:, 1], np.full(len(x), 4.0), x[:, 0] + x[:, 3]])
    xc, yc = centred(x, y)
    m = moments_of(x, y)
    # The smallest of all minima, in the features' own units.
    assert np.allclose(linear.least_squares(m)[0], np.linalg.pinv(xc, rcond=1e-12) @ yc, rtol=1e-4, atol=1e-6)
    for alpha in (0.01, 1.0, 20.0):
        w = linear.lasso(m, alpha)[0]
        check_lasso(xc, yc, w, alpha)
        assert w[6] == 0.0 and w[7] == 0.0  # of x and 0.6 x the penalty keeps the larger
    assert np.isfinite(linear.ridge(m)[0]).all()


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 7), st.integers(0, 10**6), st.floats(1e-3, 10))
def test_lasso_of_correlated_features(width, seed, alpha):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, width)) @ rng.normal(size=(width, width)) + 0.01 * rng.normal(size=(40, width))
    y = x @ rng.normal(size=width) + rng.normal(size=40)
    check_lasso(*centred(x, y), linear.lasso(moments_of(x, y), alpha)[0], alpha)


def test_parts_add_up_and_come_off(data):
    x, y = data
    whole, some = moments_of(x, y), None
    d = np.column_stack([x, y]) - whole.origin
    some = linear.Moments(100.0, whole.origin, d[:100].sum(axis=0), d[:100].T @ d[:100])
    rest = whole - some
    assert np.allclose(rest.means, np.column_stack([x, y])[100:].mean(axis=0)) and np.allclose((rest + some).products, whole.products)


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    given = [(Vectors.dense(a) if i % 2 else Vectors.sparse(6, range(6), a), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y))]
    schema = T.StructType([T.StructField("features", VectorUDT()), T.StructField("label", T.DoubleType()), T.StructField("part", T.IntegerType())])
    return spark.createDataFrame([*given, (given[0][0], None, 1)], schema).repartition(5)


def test_moments_of_parts(rows, data, monkeypatch):
    monkeypatch.setattr(sums, "BLOCK", 7)
    z = np.column_stack(data)
    found = linear.moments(rows, F.when(F.col("part") < 3, F.col("part")))
    assert set(found) == {0, 1, 2}
    for p, m in found.items():
        own = z[np.arange(len(z)) % 4 == p]
        assert m.n == len(own) and np.allclose(m.means, own.mean(axis=0)) and np.allclose(m.spread() / m.n, np.cov(own.T, ddof=0), rtol=1e-6, atol=1e-9)
    assert linear.moments(rows.limit(0), F.lit(0)) == {}


def test_models_like_descent_on_the_rows(rows, monkeypatch):
    given = rows.filter("label IS NOT NULL")
    fits = {"linear": lambda r: models.REGRESSORS["linear"](r, EngineConfig()), "ridge": lambda r: models.ridge(r, 5.0), "lasso": lambda r: models.lasso(r, 0.4)}
    summed = {name: fit(given) for name, fit in fits.items()}
    monkeypatch.setattr(linear, "WIDEST", 5)
    for name, fit in fits.items():
        predicted = summed[name].transform(given).withColumnRenamed("prediction", "p")
        off = fit(given).transform(predicted).agg(F.max(F.abs(F.col("p") - F.col("prediction")))).first()[0]
        assert off < 0.05, name


def test_board_equals_fits_fold_by_fold(spark, data, monkeypatch):
    x, y = data
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, e double, f double, y double")
    made = models.prepare(df, list("abcdef"), "y", ["id"])
    jobs = []
    monkeypatch.setattr(linear, "moments", lambda *a, real=linear.moments: jobs.append(1) or real(*a))
    board = models.leaderboard(made, EngineConfig(), ["linear", "ridge", "lasso"])
    assert len(jobs) == 1  # three models, six fits each
    for row in board.table.collect():
        fit = models.REGRESSORS[row["model"]]
        scores = models._scores(fit(made.train, EngineConfig()), made, "regression")
        mean, deviation = models.cross_validate(fit, made, EngineConfig())
        assert all(row[m] == pytest.approx(v, rel=1e-6) for m, v in scores.items())
        assert row["cv_mean"] == pytest.approx(mean, rel=1e-7) and row["cv_std"] == pytest.approx(deviation, rel=1e-3, abs=1e-9)
