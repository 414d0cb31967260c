import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.config import EngineConfig
from plumbline.operators import features
from plumbline.plans import flows, roles
from plumbline.sources.tables import load_table


@pytest.fixture(scope="module")
def processed(spark):
    return load_table(spark, "tests/goldens/processed_sales.csv").cache()


def test_feature_table_golden(processed):
    golden = pd.read_csv("tests/goldens/features_sales.csv")
    categorical = roles.string_columns(processed)
    assert features.encode_onehot(processed, ["产品类别", "产品名称"]).columns[-7:] == [
        "产品类别_服装", "产品类别_电子产品", "产品类别_食品",
        "产品名称_智能电视C", "产品名称_有机大米E", "产品名称_笔记本电脑B", "产品名称_羽绒服D",
    ]
    scalable = roles.scalable_columns(roles.numeric_columns(processed), categorical)
    out = features.scale(features.encode(processed, ["产品类别", "产品名称"]), scalable)
    mine = features.feature_table(out, list(golden.columns[:-1]), "价格").toPandas()
    assert list(mine.columns) == list(golden.columns)
    order = ["销售日期_日", "成本", "销量"]
    mine, golden = mine.sort_values(order), golden.sort_values(order)
    for c in golden:
        assert np.allclose(mine[c].astype(float), golden[c].astype(float), atol=1e-9), c


def test_onehot_edges(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x")], "s string, one string")
    out = features.encode(df, ["s", "one"])
    assert out.columns == ["s_b"] and [r[0] for r in out.collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        features.encode(df, ["s"], "hash")
    assert features.category_values(df, ["s", "one"], 1) == {"s": None, "one": ["x"]}
    assert features.encode_onehot(df, ["s", "one"], 1).columns == ["s_onehot"]
    vectors = features.encode_onehot_vector(df, "s").orderBy("s").collect()
    assert [list(r["s_onehot"].toArray()) for r in vectors] == [[0.0], [0.0], [1.0]]


def test_a_wide_onehot_vector_names_no_places(spark):
    """The column's description does not grow with its values; places, the first value and NULL are as in a narrow one."""
    df = spark.range(3000).select("id", F.when(F.col("id") < 2990, F.format_string("v%05d", F.col("id"))).alias("s"))
    wide = features.encode_onehot_vector(df, "s")
    assert wide.columns == ["id", "s", "s_onehot"] and len(wide.schema["s_onehot"].json()) < 1000
    for r in wide.collect():
        assert r["s_onehot"].size == 2989 and list(r["s_onehot"].indices) == ([r["id"] - 1] if 0 < r["id"] < 2990 else [])
        assert list(r["s_onehot"].values) == [1.0] * (0 < r["id"] < 2990)
    single = features.encode_onehot_vector(df.filter("id > 2988"), "s").collect()
    assert len(single) == 11 and all(r["s_onehot"].size == 0 for r in single)
    assert features.assemble_vector(wide, ["s_onehot", "id"]).first()["features"].size == 2990


@pytest.mark.parametrize("max_rows", [50_000, 3])
def test_label_encoding(spark, max_rows):
    df = spark.range(400).select("id", F.concat(F.lit("v"), (F.col("id") * 7 % 60).cast("string")).alias("s"))
    pdf = df.toPandas()
    expected = {v: i for i, v in enumerate(sorted(pdf["s"].unique()))}
    out = {r["id"]: r["s"] for r in features.encode_label(df, ["s"], max_rows).collect()}
    assert len(out) == 400 and all(out[r.id] == expected[r.s] for r in pdf.itertuples())


def test_many_labels_are_ranked_in_order(spark):
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("s"))
    rows = features.label_ranks(df, "s", max_rows=50).orderBy("s").collect()
    assert [r["label"] for r in rows] == list(range(3000))


def test_scaling_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 2.0), (None, 5.0, None)], "a double, flat double, n double")
    rows = features.scale(df, ["a", "flat"]).collect()
    assert [r["a"] for r in rows] == [-1.0, 1.0, None] and [r["flat"] for r in rows] == [0.0, 0.0, 0.0]
    assert [r["a"] for r in features.scale(df, ["a"], "minmax").collect()] == [0.0, 1.0, None]
    part = features.scale(df, ["a"], "minmax", fit_on=df.filter("a = 1 OR a IS NULL")).collect()
    assert [r["a"] for r in part] == [0.0, 0.0, None]
    with pytest.raises(ValueError):
        features.scale(df, ["a"], "robust")


def test_f_scores(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 4, 300)
    pdf = pd.DataFrame({"y": y, "a": y + rng.normal(size=300), "b": rng.normal(size=300) + 1e6, "flat": 1.0})
    df = spark.createDataFrame(pdf)
    scores = {r["feature"]: r["score"] for r in features.f_scores(df, ["b", "a", "flat"], "y").collect()}
    for c in ("a", "b"):
        groups = [g[c].to_numpy() for _, g in pdf.groupby("y")]
        between = sum(len(g) * (g.mean() - pdf[c].mean()) ** 2 for g in groups) / 3
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (300 - 4)
        assert math.isclose(scores[c], between / within, rel_tol=1e-6)
    assert scores["flat"] is None
    assert features.select_k_best(df, ["b", "a", "flat"], "y", 2) == ["a", "b"]


def place_score(values, y):
    """ANOVA F of one column, written out."""
    groups = [values[y == g] for g in np.unique(y)]
    between = sum(len(g) * (g.mean() - values.mean()) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(values) - len(groups))
    return between / within if within > 1e-15 else None


@pytest.fixture(scope="module")
def coded(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, 400)
    code = np.where(rng.random(400) < 0.6, y, rng.integers(0, 7, 400))
    pdf = pd.DataFrame({"id": np.arange(400), "y": y, "c": [f"v{i}" for i in code], "x": rng.normal(size=400) + 0.3 * y, "z": rng.normal(size=400), "d": np.where(y == 1, "in", "out")})
    pdf.loc[::50, "c"] = None
    return spark.createDataFrame(pdf), pdf


def test_place_scores_from_counts(coded):
    df, pdf = coded
    rows = {r["feature"]: r["score"] for r in features.category_scores(df, ["c", "d"], "y").collect()}
    assert set(rows) == {f"c_v{i}" for i in range(1, 7)} | {"d_out"} and rows["d_out"] == math.inf
    y = pdf["y"].to_numpy()
    for i in range(1, 7):
        assert math.isclose(rows[f"c_v{i}"], place_score((pdf["c"] == f"v{i}").to_numpy().astype(float), y), rel_tol=1e-9)
    wide = features.encode_onehot_vector(df, "c")
    scores = {r["feature"]: r["score"] for r in features.vector_scores(wide, ["c_onehot"], "y").collect()}
    assert all(math.isclose(scores[f"c_onehot[{i - 1}]"], rows[f"c_v{i}"], rel_tol=1e-9) for i in range(1, 7))
    dense = features.assemble_vector(df, ["x", "z"], "v")
    scores = {r["feature"]: r["score"] for r in features.vector_scores(dense, ["v"], "y").collect()}
    assert math.isclose(scores["v[0]"], place_score(pdf["x"].to_numpy(), y), rel_tol=1e-9)
    assert features.category_scores(df.limit(0), ["c"], "y").count() == 0
    assert features.category_scores(df.withColumn("y", F.lit(1)), ["c"], "y").filter("score IS NOT NULL").count() == 0


@pytest.mark.parametrize("limit", [3, 100])
def test_selection_does_not_depend_on_the_number_of_values(coded, limit, monkeypatch):
    df, pdf = coded
    monkeypatch.setattr(features, "ONEHOT_COLUMNS", limit)
    made = flows.build_features(df, EngineConfig(selection="selectkbest"), target="y", keys=["id"])
    y = pdf["y"].to_numpy()
    columns = {f"c_v{i}": (pdf["c"] == f"v{i}").to_numpy().astype(float) for i in range(1, 7)} | {"x": pdf["x"].to_numpy(), "z": pdf["z"].to_numpy()}
    wanted = sorted(columns, key=lambda c: -place_score(columns[c], y))
    assert made.names == ["d_out", *wanted]  # what the target determines comes first
    rows = made.table.orderBy("id").toPandas()
    assert all((rows[c] == columns[c]).all() for c in columns if c.startswith("c_"))


def test_the_k_best_of_a_vector(coded):
    df, _ = coded
    wide = features.encode_onehot_vector(df, "c")
    best = features.best_features(wide, ["x", "z", "c_onehot"], "y", 3)
    assert len(best) == 3 and list(best) == features.select_k_best(wide, ["x", "z", "c_onehot"], "y", 3)
    rows = wide.select("c", *[e.alias(n) for n, e in best.items()]).toPandas()
    for n in best:
        if n.startswith("c_onehot"):
            assert (rows[n] == (rows["c"] == f"v{int(n[9:-1]) + 1}")).all()


def test_elimination_counts_places_alike_in_both_forms(coded):
    df, _ = coded
    config = EngineConfig(task="classification", forest_trees=5, forest_depth=4, folds=2, parallel_fits=2)
    narrow = features.encode_onehot(df, ["c"]).withColumn("fold", (F.col("id") % 2).cast("int"))
    wide = features.encode_onehot_vector(df, "c").withColumn("fold", (F.col("id") % 2).cast("int"))
    kept, ranking = features.recursive_elimination(narrow, ["x", *[f"c_v{i}" for i in range(1, 7)]], "y", "fold", config, step=2)
    same, places = features.recursive_elimination(wide, ["x", "c_onehot"], "y", "fold", config, step=2)
    plain = lambda n: n if n == "x" else f"c_v{int(n[9:-1]) + 1}"
    # Forests draw rows by their order, which differs between the two tables, so only what stands out is sure.
    assert set(map(plain, places)) == set(ranking) and all(ranking[n] == 1 for n in kept)
    assert {"c_v1", "c_v2"} <= set(kept) and {"c_v1", "c_v2"} <= set(map(plain, same))
    shown, names = features.with_places(wide, ["c_onehot[2]", "x"], ["x", "c_onehot"])
    assert names == ["c_onehot[2]", "x"] and shown.select(F.sum("`c_onehot[2]`")).first()[0] == df.filter("c = 'v3'").count()
    assert features.with_places(wide, [f"c_onehot[{i}]" for i in range(6)] + ["x"], ["x", "c_onehot"])[1] == ["c_onehot", "x"]


def test_recursive_elimination_keeps_signal(spark):
    df = spark.range(400).select(
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 10.0).alias("signal"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 10.0).alias("noise"),
        (F.col("id") % 3).cast("int").alias("fold"),
    ).withColumn("y", F.col("signal") * 3)
    config = EngineConfig(forest_trees=5, forest_depth=5, folds=3, parallel_fits=3)
    kept, ranking = features.recursive_elimination(df, ["noise", "signal"], "y", "fold", config)
    assert kept == ["signal"] and ranking == {"signal": 1, "noise": 2}


def test_principal_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) @ np.array([[3.0, 1, 0], [0, 1, 0.5], [0, 0, 0.2]]) + 50
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).reset_index(names="id"))
    out, ratios = features.principal_components(df, ["a", "b", "c"], 2, keep=["id"])
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(ratios, (s**2 / (s**2).sum())[:2], atol=1e-9)
    mine = out.orderBy("id").toPandas()[["PC1", "PC2"]].to_numpy()
    assert np.allclose(np.abs(mine), np.abs(centred @ vt[:2].T), atol=1e-8)
