from dataclasses import replace

import pytest

from plumbline.functions.lookup import attach
from plumbline.operators import derive, features, models, neighbours
from plumbline.config import EngineConfig
from plumbline.plans import flows
from plumbline.session import materialise
from plumbline.sources.tables import load_model, load_table, save_model
from tests.goldens.scenarios import SPECS

FAST = EngineConfig(selection="selectkbest", forest_trees=3, forest_depth=4, boosting_stages=3, folds=3)
DERIVED = [
    {"column_name": "销售额", "calculation": "`价格` * `销量`"},
    {"column_name": "利润", "calculation": "(`价格` - `成本`) * `销量`"},
    {"column_name": "坏", "calculation": "eval('1')"},
]


@pytest.fixture(scope="module")
def raw(spark):
    return load_table(spark, "tests/goldens/raw_sales.csv").cache()


def test_preprocess(raw):
    out, reports = flows.preprocess(raw, FAST, DERIVED)
    assert out.count() == 53
    assert {"销售额", "利润", "销售日期_年份", "销售日期_星期名称"} <= set(out.columns)
    assert [r["column_name"] for r in reports["skipped_columns"].collect()] == ["坏"]
    assert reports["outliers"].filter("n_outliers > 0").count() == 0
    assert reports["nulls"].count() == 0


def test_features_keep_one_target(raw):
    df, _ = flows.preprocess(raw, FAST, DERIVED)
    made = flows.build_features(df, FAST, target="销量")
    assert made.target == "销量" and made.table.columns[-1] == "销量" and len(made.names) == 10
    every = flows.build_features(df, FAST, select=False, exclude=["产品名称"])
    assert every.target == "销量"  # the first numeric column named like a measure
    assert not any(c.startswith("产品名称") for c in every.names)
    assert "地区_华北" in every.names and "地区_华东" not in every.names
    labelled = flows.build_features(df, replace(FAST, encoding="label"), target="销量", select=False, fit_on="train", keys=["销售日期"])
    assert "地区" in labelled.names
    with pytest.raises(ValueError):
        flows.build_features(df, FAST, target="nope")
    with pytest.raises(ValueError):
        flows.build_features(df, replace(FAST, selection="x"), target="销量")


def test_run_all(raw):
    charts = [{"chart_type": "bar", "title": "额", "x_axis": "产品类别", "y_axis": "销售额"}]
    results, board = flows.run_all(
        raw, FAST, DERIVED, charts, scenarios=SPECS, target="销量", keys=["销售日期", "产品名称"], model_names=["linear", "ridge"],
    )
    assert {"cleaned", "features", "chart: 额", "describe", "correlations", "target_correlations", "tests",
            "leaderboard", "coefficients", "importances", "baseline", "scenarios"} <= set(results)
    assert results["chart: 额"].count() == 4 and results["scenarios"].count() == 36
    assert results["leaderboard"].count() == 2 and board.best in ("linear", "ridge")
    assert results["tests"].count() == 3


def test_materialise_uses_the_shared_folder(spark):
    written = materialise(spark.range(5), "t")
    assert written.count() == 5
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert all("plumbline-t-" in f and (named is None or named.split(":")[-1] in f) for f in written.inputFiles())


def test_train_fitted_scaling_without_keys(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), f"g{i % 3}") for i in range(200)], "a double, b double, g string")
    made = flows.build_features(df, target="b", fit_on="train", select=False)
    assert made.table.agg({"a": "stddev"}).first()[0] > 0.9
    with pytest.raises(ValueError):
        models.key_hash([], 42)


def test_refused_calculations(spark):
    df = spark.range(3)
    specs = [{"column_name": f"c{i}", "calculation": c} for i, c in enumerate([
        "reflect('java.lang.System', 'currentTimeMillis')", "java_method('java.util.UUID', 'randomUUID')", "sum(id) over ()", "sum(id) OVER (ORDER BY id)", "id + 1",
    ])]
    out, skipped = derive.add_derived_columns(df, specs)
    assert out.columns == ["id", "c4"] and len(skipped) == 4


def test_lookup_passes_null_keys_by(spark):
    facts = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3), ("c", 4)], "k string, v int")
    lookup = spark.createDataFrame([("a", 10, 1), ("b", 20, 1)], "k string, w int, n int")
    rows = {(r["k"], r["v"], r["w"]) for r in attach(facts, lookup, ["k"], "n", max_rows=1).collect()}
    assert rows == {(None, 1, None), ("a", 2, 10), ("b", 3, 20), ("c", 4, None)}


def test_search_skips_null_queries(spark):
    base = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id int, embedding array<double>")
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, None)], "q int, embedding array<double>")
    assert {r["query_id"] for r in neighbours.search(base, asked, 1, "id", "q").collect()} == {7}


@pytest.mark.parametrize("selection", ["rfecv", "selectkbest"])
def test_wide_category_goes_through_the_flow(spark, selection, monkeypatch):
    """A string column with more values than columns are made for becomes one sparse vector that selection and models accept."""
    monkeypatch.setattr(features, "ONEHOT_COLUMNS", 30)
    df = spark.range(2000).selectExpr("id", "concat('v', id % 40) AS code", "CAST(id % 7 AS double) AS a", "CAST(id % 7 AS double) * 3 AS y")
    config = replace(FAST, selection=selection, forest_trees=2, folds=2)
    made = flows.build_features(df, config, target="y", keys=["id"])
    assert "a" in made.names
    table = flows.build_features(df, config, target="y", keys=["id"], select=False)
    assert sorted(table.names) == ["a", "code_onehot"]
    data = models.prepare(table.table, table.names, "y", ["id"], config)
    assert data.vectors == {"code_onehot": 39} and len(data.slots) == 40
    board = models.leaderboard(data, config, ["random_forest"])
    assert board.table.count() == 1


def test_saved_results(spark, raw, tmp_path):
    config = replace(FAST, processed_path=f"{tmp_path}/cleaned.csv", features_path=f"{tmp_path}/features.parquet", model_path=f"{tmp_path}/model")
    results, board = flows.run_all(raw, config, DERIVED, target="销量", keys=["销售日期", "产品名称"], model_names=["linear", "ridge"])
    paths = flows.save_all(results, board, config, f"{tmp_path}/reports")
    assert load_table(spark, paths["cleaned"], "csv").count() == results["cleaned"].count()
    assert load_table(spark, paths["leaderboard"], "parquet").count() == 2
    scored = load_model(paths["model"]).transform(load_table(spark, paths["features"]))
    assert scored.filter("prediction IS NOT NULL").count() == scored.count() > 0


def test_a_neighbour_that_wins_is_saved(spark, tmp_path):
    df = spark.range(120).selectExpr("id", "CAST(id % 12 AS double) AS a", "CAST(id % 5 AS double) AS b", "CAST(id % 12 < 6 AS int) + 2 * CAST(id % 12 % 2 AS int) AS kind")
    config = replace(FAST, task="classification")
    data = models.prepare(df, ["a", "b"], "kind", ["id"], config)
    board = models.leaderboard(data, config, ["nearest_neighbours"])
    path = save_model(board.best_pipeline(), str(tmp_path / "model"))
    rows = df.select("id", "a", "b")
    again = {r["id"]: r["prediction"] for r in load_model(path).transform(rows).collect()}
    assert again == {r["id"]: r["prediction"] for r in board.best_pipeline().transform(rows).collect()} and len(again) == 120
    without = load_model(path).transform(rows.select("a", "b"))
    assert without.columns == ["a", "b", "features", "prediction"] and without.count() == 120
