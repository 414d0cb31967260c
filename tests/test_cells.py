"""Tree fits on counted cells: the same trees as from the rows, at a size that does not grow with them."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from plumbline.config import EngineConfig
from plumbline.operators import cells, features, models
from plumbline.sources.tables import load_model, save_model

CONFIG = EngineConfig(forest_trees=6, forest_depth=4, boosting_stages=4, folds=3, parallel_fits=3)


def rows_of(spark, n, values=12):
    some = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(k)).cast("double")
    made = spark.range(n).select("id", some(1, values).alias("a"), (some(2, 8) - 4).alias("b"), F.lit(3.0).alias("c"), some(3, 100).alias("e"))
    return made.withColumn("y", F.col("a") * F.col("a") + 5 * F.col("b") + F.col("e") / 10)


def vectors(df):
    return df.select("id", array_to_vector(F.array("a", "b", "c")).alias("features"), F.col("y").alias("label"), (F.col("id") % 3).alias("fold"))


@pytest.fixture(scope="module")
def rows(spark):
    return vectors(rows_of(spark, 12_000)).persist()


def refuse(*_, **__):
    raise AssertionError("a fit read the rows")


def test_boosted_trees_are_those_of_the_rows(rows):
    counted = cells.counted(rows, F.col("fold"), F.col("id"), 0, 42)
    assert counted.size == 3 * 12 * 8 and counted.rows.agg(F.sum("n")).first()[0] == 12_000
    mine = cells.boosted(counted, 4, 3, 0.1, 42)
    theirs = GBTRegressor(maxIter=4, maxDepth=3, stepSize=0.1, seed=42).fit(rows)
    pairs = mine.transform(rows).withColumnRenamed("prediction", "mine").join(theirs.transform(rows).select("id", "prediction"), "id")
    assert pairs.filter(F.abs(F.col("mine") - F.col("prediction")) > 1e-6).isEmpty()
    held = rows.filter("fold = 1")
    fitted = cells.boosted(counted.without(1), 4, 3, 0.1, 42)
    assert cells.r2(fitted, counted.only(1)) == pytest.approx(models.regression_metrics(fitted.transform(held), "label").first()["r2"], abs=1e-9)


def test_forest_is_a_bootstrap_over_rows(spark, rows, tmp_path):
    counted = cells.counted(rows, F.col("fold"), F.col("id"), 12, 42)
    bags = np.array([r["w"] for r in counted.rows.collect()])
    assert bags.shape[1] == 12 and np.abs(bags.sum(axis=0) / 12_000 - 1).max() < 0.05
    sizes = np.array([r["n"] for r in counted.rows.collect()])
    assert ((bags - sizes[:, None]) ** 2 / sizes[:, None]).mean() == pytest.approx(1, abs=0.1)  # rows are drawn, not cells
    mine = cells.forest(counted, 12, 4, 42)
    theirs = RandomForestRegressor(numTrees=12, maxDepth=4, featureSubsetStrategy="all", seed=42).fit(rows)
    score = lambda model: models.regression_metrics(model.transform(rows), "label").first()["r2"]
    assert len(mine.trees) == 12 and score(mine) == pytest.approx(score(theirs), abs=0.005)
    assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.01)
    again = load_model(save_model(PipelineModel([mine]), str(tmp_path / "forest")))
    assert score(again) == score(mine)


def test_bins_end_where_thresholds_are(spark):
    rows = vectors(rows_of(spark, 20_000, 500))
    counted = cells.counted(rows, F.lit(0), F.col("id"), 0, 42)
    assert counted.size <= cells.BINS * 8
    model = cells.boosted(counted, 4, 3, 0.1, 42)
    # Rows taken at their own values go to the leaves their bins went to.
    assert cells.r2(model, counted) == pytest.approx(models.regression_metrics(model.transform(rows), "label").first()["r2"], abs=1e-9)


def test_cells_do_not_grow_with_the_rows(spark, rows):
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("id", F.col("id") * 5 + F.col("copy"))
    assert cells.counted(many, F.col("fold"), F.col("id"), 2, 42).size == cells.counted(rows, F.col("fold"), F.col("id"), 2, 42).size
    apart = spark.range(300).select("id", array_to_vector(F.array(F.rand(1), F.rand(2))).alias("features"), F.rand(3).alias("label"))
    assert cells.counted(apart, F.lit(0), F.col("id"), 2, 42) is None  # hardly two rows alike: the rows themselves are read


def test_board_and_elimination_fit_on_cells(spark, monkeypatch):
    df = rows_of(spark, 12_000)
    for place, name in ((models, "RandomForestRegressor"), (models, "GBTRegressor"), (features, "RandomForestRegressor")):
        monkeypatch.setattr(place, name, refuse)
    data = models.prepare(df, ["a", "b", "c"], "y", ["id"], CONFIG)
    board = models.leaderboard(data, CONFIG, ["random_forest", "gradient_boosting"])
    found = {r["model"]: r for r in board.table.collect()}
    assert found["random_forest"]["test_r2"] > 0.9 and found["random_forest"]["cv_mean"] > 0.9 and found["random_forest"]["train_mae"] > 0
    assert [r["feature"] for r in models.importance_ranking(df, board.models, data.features).filter("rank = 1").collect()] == ["a", "a"]
    folded = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    kept, ranking = features.recursive_elimination(folded, ["c", "a", "b"], "y", "fold", CONFIG)
    assert set(kept) == {"a", "b"} and ranking == {"a": 1, "b": 1, "c": 2}
