import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import charts


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    n = 3000
    g = np.where(np.arange(n) % 3 == 0, "hot", np.char.add("g", (np.arange(n) % 5).astype(str)))
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": np.round(rng.gamma(2.0, 10.0, n), 2), "w": rng.integers(1, 51, n)})
    return spark.createDataFrame(pdf).cache(), pdf


@pytest.mark.parametrize("column", ["v", "w"])
def test_histogram_matches_numpy(table, column):
    df, pdf = table
    counts, edges = np.histogram(pdf[column], 20)
    rows = charts.histogram(df, column).orderBy("bin").collect()
    assert [r["n"] for r in rows] == list(counts)
    assert np.allclose([r["low"] for r in rows] + [rows[-1]["high"]], edges)


def test_histogram_edges(spark):
    rows = charts.histogram(spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [0, 0, 2, 0] and (rows[0]["low"], rows[-1]["high"]) == (1.5, 2.5)
    assert charts.histogram(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


@pytest.mark.parametrize("counted", [100_000, 10])
def test_density_matches_direct_sum(table, counted, monkeypatch):
    df, pdf = table
    monkeypatch.setattr(charts, "COUNTED_VALUES", counted)
    v = pdf["v"].to_numpy()
    width = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), 200)
    direct = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / width) ** 2).sum(axis=1) / (len(v) * width * math.sqrt(2 * math.pi))
    rows = charts.density(df, "v").orderBy("point").collect()
    assert np.allclose([r["x"] for r in rows], grid) and np.allclose([r["density"] for r in rows], direct, rtol=1e-9)


def test_density_without_spread(spark):
    assert charts.density(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").count() == 0


def test_scatter(table):
    df, pdf = table
    assert charts.scatter_points(df, "v", "w").count() == 3000
    grid = charts.scatter_grid(df, "v", "w", 10).toPandas()
    expected, _, _ = np.histogram2d(pdf["v"], pdf["w"], 10)
    mine = np.zeros((10, 10))
    mine[grid["x_bin"], grid["y_bin"]] = grid["n"]
    assert (mine == expected).all()


@pytest.mark.parametrize("limit", [2_000_000, 50])
def test_boxes(table, limit):
    df, pdf = table
    rows = {r["x"]: r for r in charts.box_stats(df, "g", "v", limit).collect()}
    outliers = charts.box_outliers(df, "g", "v", limit).toPandas()
    for g, part in pdf.groupby("g"):
        q1, q2, q3 = part["v"].quantile([0.25, 0.5, 0.75])
        inside = part["v"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        r = rows[g]
        assert np.allclose([r["q1"], r["median"], r["q3"]], [q1, q2, q3])
        assert (r["low_whisker"], r["high_whisker"]) == (part["v"][inside].min(), part["v"][inside].max())
        assert r["n_outliers"] == (~inside).sum() == (outliers["x"] == g).sum()


def test_bars_and_lines(table):
    df, pdf = table
    rows = {r["x"]: r for r in charts.bars(df, "g", "v").collect()}
    sums = {r["x"]: r["value"] for r in charts.bars(df, "g", "v", "sum").collect()}
    for g, part in pdf.groupby("g"):
        assert math.isclose(rows[g]["value"], part["v"].mean()) and math.isclose(sums[g], part["v"].sum())
        assert rows[g]["low"] < part["v"].mean() < rows[g]["high"]
    xs = [r["x"] for r in charts.lines(df, "w", "v").collect()]
    assert xs == sorted(xs) and len(xs) == 50
    with pytest.raises(ValueError):
        charts.bars(df, "g", "v", "median")


def test_bootstrap_interval_is_near_the_normal_one(table):
    df, pdf = table
    normal = {r["x"]: r for r in charts.bars(df, "g", "v").collect()}
    found = charts.bootstrap_intervals(df, "g", "v", ["id"], resamples=300, blocks=256)
    first, again = found.orderBy("x").collect(), found.orderBy("x").collect()
    assert first == again
    for r in first:
        n = normal[r["x"]]
        assert r["n"] == n["n"] and math.isclose(r["mean"], n["value"])
        assert r["low"] < r["mean"] < r["high"]
        assert 0.7 < (r["high"] - r["low"]) / (n["high"] - n["low"]) < 1.35


def test_poisson_weights():
    weights = charts.resampling_weights(40, 500, 42)
    assert math.isclose(weights.mean(), 1.0, abs_tol=0.03) and math.isclose(weights.var(), 1.0, abs_tol=0.05) and 5 <= weights.max() <= 9
    assert (weights == charts.resampling_weights(40, 500, 42)).all() and (weights != charts.resampling_weights(40, 500, 1)).any()


@pytest.mark.parametrize("estimator", ["mean", "sum"])
def test_bootstrap_written_out(spark, estimator):
    """Against weights drawn row by row in plain Python."""
    rows = [(i, None if i % 31 == 0 else f"g{i * i % 11}", None if i % 17 == 0 else (i * 7 % 23) - 3.5) for i in range(400)]
    found = charts.bootstrap_intervals(spark.createDataFrame(rows, "id int, g string, v double").repartition(3), "g", "v", ["id"], 50, 8, 7, estimator)
    hashed = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    weight = lambda u: next(k for k in range(20) if u < sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))
    weights = [[weight(hashed(f"{b}|{r}|7") / 2**32) for r in range(50)] for b in range(8)]
    assert found.count() == len({g for _, g, v in rows if g and v is not None})
    for row in found.collect():
        own = [(v, weights[hashed(f"{i}|7") % 8]) for i, g, v in rows if g == row["x"] and v is not None]
        sums = [(sum(v * w[r] for v, w in own), sum(w[r] for _, w in own)) for r in range(50)]
        drawn = [s / n for s, n in sums if n] if estimator == "mean" else [s for s, _ in sums]
        value = sum(v for v, _ in own) / (len(own) if estimator == "mean" else 1)
        assert row["n"] == len(own) and math.isclose(row[estimator], value)
        assert np.allclose([row["low"], row["high"]], np.percentile(drawn, [2.5, 97.5]))
    assert charts.bootstrap_intervals(spark.createDataFrame([], "id int, g string, v double"), "g", "v").count() == 0


def test_specs(table):
    df, _ = table
    specs = [
        {"chart_type": "histogram", "title": "h", "x_axis": "v", "y_axis": "频率"},
        {"chart_type": "histogram", "title": "again", "x_axis": "v", "y_axis": ""},
        {"chart_type": "bar", "title": "b", "x_axis": "g", "y_axis": "v"},
        {"chart_type": "bar", "title": "no", "x_axis": "g", "y_axis": "nope"},
        {"chart_type": "pie", "title": "pie", "x_axis": "g", "y_axis": "v"},
        {"chart_type": "line", "x_axis": "g", "y_axis": "v"},
        {"chart_type": "line", "title": "l", "x_axis": "w", "y_axis": "v", "recommended": False},
        {"chart_type": "scatter", "title": "half", "x_axis": "w"},
        {"chart_type": "heatmap", "title": "all", "x_axis": "数值", "y_axis": None},
        {"chart_type": "line", "title": "bands", "x_axis": "w", "y_axis": "v", "interval": "bootstrap"},
        {"chart_type": "density", "title": "curve", "x_axis": "v", "y_axis": "频率"},
        {"chart_type": "histogram", "title": "odd", "x_axis": "w", "interval": "bootstrap"},
    ]
    drawn, skipped = charts.chart_data(df, specs)
    assert [s["title"] for s, _ in drawn] == ["h", "b", "all", "bands", "curve"]
    assert [s["reason"] for s in skipped] == [
        "duplicate", "no such column: nope", "unsupported chart type pie", "no chart type or title",
        "not recommended", "no such column: None", "unsupported interval bootstrap",
    ]
    assert drawn[0][1].count() == 20 and drawn[2][1].count() == 9 and drawn[3][1].columns == drawn[1][1].columns and drawn[4][1].count() == 200
    assert [r["x"] for r in drawn[3][1].collect()] == [r["x"] for r in charts.lines(df, "w", "v").collect()]
