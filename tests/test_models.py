import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from plumbline.config import EngineConfig
from plumbline.operators import models
from plumbline.sources.tables import load_model, save_model

FAST = EngineConfig(forest_trees=5, forest_depth=5, boosting_stages=5, folds=3, parallel_fits=3)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    n = 400
    x = rng.normal(size=(n, 3)) * [1, 5, 0.3] + [10, 0, 3]
    y = x @ [2.0, -1.0, 4.0] + rng.normal(size=n) * 0.5 + 7
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, id=np.arange(n) * 3)
    pdf["kind"] = np.where(pdf["b"] > 2, "up", np.where(pdf["b"] < -2, "down", "flat"))
    pdf["flag"] = np.where(pdf["b"] + rng.normal(size=n) > 0, "yes", "no")
    return spark.createDataFrame(pdf).cache(), pdf


def closed_form(x, y, alpha):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    return np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)


def test_linear_models_match_closed_forms(table):
    df, pdf = table
    train = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumnRenamed("y", "label")
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf["y"].to_numpy()
    assert np.allclose(models.REGRESSORS["linear"](train, FAST).coefficients.toArray(), closed_form(x, y, 0), rtol=1e-8)
    assert np.allclose(models.ridge(train, 25.0).coefficients.toArray(), closed_form(x, y, 25.0), rtol=1e-7)
    w = models.lasso(train, 0.3).coefficients.toArray()
    # optimality: the gradient of the smooth part equals -alpha*sign(w) on kept and is below alpha on dropped features
    xc, yc = x - x.mean(axis=0), y - y.mean()
    slope = xc.T @ (yc - xc @ w) / len(y)
    for wi, si in zip(w, slope):
        assert math.isclose(si, 0.3 * np.sign(wi), abs_tol=1e-4) if abs(wi) > 1e-9 else abs(si) <= 0.3 + 1e-6


def test_split_is_stable(table):
    df, _ = table
    picked = df.filter(models.is_test_row(["id"])).select("id").toPandas()["id"].tolist()
    again = df.repartition(7).filter(models.is_test_row(["id"])).select("id").toPandas()["id"].tolist()
    assert sorted(picked) == sorted(again) and 50 < len(picked) < 110
    other = df.filter(models.is_test_row(["id"], seed=1)).select("id").toPandas()["id"].tolist()
    assert sorted(other) != sorted(picked)


@pytest.mark.parametrize("limit", [200_000, 16])
def test_contiguous_folds(table, limit):
    df, pdf = table
    part = df.filter("id < 1190")  # 397 rows
    rows = part.select("id", models.contiguous_fold(part, "id", 5, limit).alias("f")).orderBy("id").toPandas()
    expected = np.repeat(np.arange(5), [80, 80, 79, 79, 79])
    assert (rows["f"].to_numpy() == expected).all()


def dealt(labels, folds):
    """Rows of each class per fold when the sorted labels are dealt in turn."""
    out = {}
    for p, label in enumerate(sorted(labels)):
        out.setdefault(label, [0] * folds)[p % folds] += 1
    return out


def test_stratified_folds(table):
    df, pdf = table
    rows = models.with_stratified_fold(df.select("id", "kind"), "id", "kind", 5, "f").toPandas()
    sizes = dealt(pdf["kind"], 5)
    for kind, wanted in sizes.items():
        part = rows[rows["kind"] == kind].sort_values("id")
        assert list(part["f"]) == list(np.repeat(np.arange(5), wanted))
    totals = [sum(s[f] for s in sizes.values()) for f in range(5)]
    assert len(rows) == len(pdf) and max(totals) - min(totals) <= 1


def test_many_classes(spark):
    """2 000 classes, the first of them with a third of all rows, and rows without a class."""
    df = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 1000 = 1 THEN NULL ELSE id % 2000 END AS y", "id * 1.0 AS x")
    rows = models.with_stratified_fold(df, "id", "y", 4, "f").toPandas()
    given = rows.dropna(subset="y")
    assert len(rows) == 9000 and rows[rows["y"].isna()]["f"].isna().all()
    for y, wanted in dealt(given["y"], 4).items():
        part = given[given["y"] == y].sort_values("id")
        assert list(part["f"]) == list(np.repeat(np.arange(4), wanted))
    data = models.prepare(df, ["x"], "y", ["id"], models.EngineConfig(task="classification"))
    assert data.class_count == given["y"].nunique()
    joined = data.rows.join(df, data.rows["id"] == df["id"].cast("string"))
    wanted = {y: i for i, y in enumerate(sorted(given["y"].unique()))}
    assert all(wanted[r["y"]] == r["label"] for r in joined.select("y", "label").collect())


def test_regression_metrics(table):
    df, pdf = table
    row = models.regression_metrics(df.withColumn("p", F.col("b") * -1.1 + 30), "y", "p").first()
    p = pdf["b"] * -1.1 + 30
    assert math.isclose(row["mse"], ((pdf["y"] - p) ** 2).mean()) and math.isclose(row["mae"], (pdf["y"] - p).abs().mean())
    assert math.isclose(row["r2"], 1 - ((pdf["y"] - p) ** 2).sum() / ((pdf["y"] - pdf["y"].mean()) ** 2).sum())


def test_classification_metrics(spark):
    y, p = [0, 0, 0, 1, 1, 2], [0, 0, 1, 1, 3, 2]
    row = models.classification_metrics(spark.createDataFrame(list(zip(y, p)), "y int, p int"), "y", "p").first()
    assert math.isclose(row["accuracy"], 4 / 6) and math.isclose(row["recall"], 4 / 6)
    assert math.isclose(row["precision"], (3 * 1.0 + 2 * 0.5 + 1 * 1.0) / 6)
    assert math.isclose(row["f1"], (3 * 0.8 + 2 * 0.5 + 1.0) / 6)


def test_auc_shares_ties(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)]
    assert math.isclose(models.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s"), (1 + 1 + 0.5 + 1 + 0 + 0.5) / 6)
    assert models.roc_auc(spark.createDataFrame([(1, 0.1)], "y int, s double"), "y", "s") is None


def test_regression_leaderboard(table, tmp_path):
    df, _ = table
    data = models.prepare(df, ["a", "b", "c"], "y", ["id"], FAST)
    board = models.leaderboard(data, FAST)
    rows = board.table.collect()
    assert {r["model"] for r in rows} == set(models.REGRESSORS)
    assert [r["test_r2"] for r in rows] == sorted((r["test_r2"] for r in rows), reverse=True)
    linear = next(r for r in rows if r["model"] == "linear")
    assert linear["test_r2"] > 0.98 and linear["cv_mean"] > 0.98 and 0 <= linear["cv_std"] < 0.02
    assert board.best == rows[0]["model"]
    coefficients = models.coefficient_ranking(df, board.models, data.features).collect()
    assert [r["rank"] for r in coefficients] == [1, 2, 3] * 3 and coefficients[0]["feature"] == "c"
    importances = models.importance_ranking(df, board.models, data.features).collect()
    assert len(importances) == 6 and importances[0]["feature"] == "b"
    path = save_model(board.best_pipeline(), str(tmp_path / "best"))
    scored = load_model(path).transform(df.select("a", "b", "c", "y"))
    assert models.regression_metrics(scored, "y").first()["r2"] > 0.97


@pytest.mark.parametrize("target", ["flag", "kind"])
def test_classification_leaderboard(table, target):
    df, pdf = table
    from dataclasses import replace

    config = replace(FAST, task="classification", boosting_stages=3)
    data = models.prepare(df, ["a", "b", "c"], target, ["id"], config)
    assert [r["_y"] for r in data.classes.orderBy("label").collect()] == sorted(pdf[target].unique())
    board = models.leaderboard(data, config)
    rows = {r["model"]: r for r in board.table.collect()}
    assert set(rows) == set(models.CLASSIFIERS)
    for name, r in rows.items():
        assert r["test_accuracy"] > 0.7 and 0.6 < r["cv_mean"] <= 1.0, (name, r)
        assert (r["test_roc_auc"] is None) == (target == "kind")
        if target == "flag":
            assert r["test_roc_auc"] > 0.7, (name, r)


def test_machines_are_fitted_in_as_few_tasks_as_the_size_asks_for(table, monkeypatch):
    """Hundreds of passes over few rows: one task each, with the same machine; more rows keep more tasks."""
    df, pdf = table
    data = models.prepare(df.repartition(8), ["a", "b", "c"], "flag", ["id"], EngineConfig(task="classification"))
    rows, seen = data.rows.repartition(8), []
    whole = models.LinearSVC(regParam=1.0 / 400, maxIter=50, tol=1e-4).fit(rows)
    fit = models.LinearSVC.fit
    monkeypatch.setattr(models.LinearSVC, "fit", lambda self, train: seen.append(train.rdd.getNumPartitions()) or fit(self, train))
    model = models._linear_svm(rows, FAST)
    assert seen == [1] and np.allclose(model.coefficients.toArray(), whole.coefficients.toArray(), rtol=1e-3, atol=1e-3)
    monkeypatch.setattr(models, "_TASK_CELLS", 400)
    models._linear_svm(rows, FAST)
    assert seen == [1, 3]


def test_logistic_matches_newton(table):
    df, pdf = table
    data = models.prepare(df, ["a", "b", "c"], "flag", ["id"], EngineConfig(task="classification"))
    model = models._logistic(data.rows, FAST)
    x = np.c_[np.ones(len(pdf)), pdf[["a", "b", "c"]].to_numpy()]
    y, w, keep = (pdf["flag"] == "yes").to_numpy(float), np.zeros(4), np.diag([0.0, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (p - y) + keep @ w)
    assert np.allclose(model.coefficients.toArray(), w[1:], atol=1e-3)
