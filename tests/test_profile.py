import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.tails import chi2_upper, f_upper, incomplete_beta, t_two_sided
from plumbline.operators import profile
from plumbline.plans import roles
from plumbline.sources import tables
from plumbline.sources.tables import load_documents, load_table, nan_to_null, save_results, save_table

GOLDENS = "tests/goldens"


@pytest.fixture(scope="module")
def raw(spark):
    return load_table(spark, f"{GOLDENS}/raw_sales.csv").cache()


@pytest.fixture(scope="module")
def processed(spark):
    return load_table(spark, f"{GOLDENS}/processed_sales.csv").cache()


def test_load_infers_types(raw):
    assert raw.count() == 53
    types = dict(raw.dtypes)
    assert (types["销售日期"], types["产品类别"], types["价格"], types["客户评分"]) == ("date", "string", "int", "double")
    with pytest.raises(FileNotFoundError):
        load_table(raw.sparkSession, "/tmp/does-not-exist.csv")


def test_round_trip(raw, tmp_path):
    path = save_table(raw, str(tmp_path / "out"), "csv")
    again = load_table(raw.sparkSession, path, "csv")
    assert again.count() == 53 and again.columns == raw.columns
    assert again.exceptAll(raw).count() == 0
    out = save_results({"d": profile.describe(raw, ["价格"])}, str(tmp_path / "res"))
    assert load_table(raw.sparkSession, out["d"], "csv").first()["column"] == "价格"


def test_nan_becomes_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "x double, s string"))
    assert df.filter("x IS NULL").count() == 1


def test_documents_with_missing_file(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("line one\nline two", encoding="utf-8")
    meta = [
        {"file_name": "a b.txt", "category": "c", "api_name": "n"},
        {"file_name": "gone.txt", "category": "c", "api_name": "n"},
    ]
    with pytest.warns(UserWarning, match="gone.txt"):
        rows = load_documents(spark, str(tmp_path), meta).collect()
    assert [(r["doc_id"], r["text"], r["category"]) for r in rows] == [("a b.txt", "line one\nline two", "c")]
    with pytest.warns(UserWarning):
        assert load_documents(spark, str(tmp_path), meta[1:]).count() == 0


def test_a_status_for_every_file(spark, tmp_path, monkeypatch):
    (tmp_path / "deep").mkdir()
    for name, content in {"a+b %41.txt": "ä\n".encode(), "deep/a.txt": b"a", "empty.txt": b"", "bad.txt": b"x\xc3(", "long.txt": b"y" * 500, "other.txt": b"z"}.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(tables, "LARGEST_DOCUMENT", 100)
    found = lambda metadata: {r["doc_id"]: (r["status"], r["reason"], r["n_bytes"], r["text"], r["category"]) for r in tables.document_status(spark, str(tmp_path), metadata).collect()}
    read = {"a+b %41.txt": ("read", None, 3, "ä\n", None), "deep/a.txt": ("read", None, 1, "a", None)}
    bad = {"bad.txt": ("unreadable", "not UTF-8", 3, None, None), "long.txt": ("unreadable", "too large", 500, None, None)}
    assert found(None) == read | bad | {"other.txt": ("read", None, 1, "z", None)}
    rows = [(n, "c") for n in [*read, *bad, "gone.txt"]] + [("gone.txt", "b"), (None, "x")]
    metadata = spark.createDataFrame([(n, c, "api") for n, c in rows], "file_name string, category string, api_name string")
    labelled = {n: (*r[:4], "c") for n, r in (read | bad).items()} | {"gone.txt": ("missing", "no such file, or an empty one", None, None, "b")}
    assert found(metadata) == labelled | {"other.txt": ("unnamed", None, 1, None, None)}
    monkeypatch.setattr(tables, "bounded_copy", lambda df: None)  # a list of names too large to send around
    assert found(metadata) == labelled | {"other.txt": ("unnamed", None, 1, None, None)}
    assert found(metadata.limit(0)) == {n: ("unnamed", None, r[2], None, None) for n, r in (read | bad | {"other.txt": (0, 0, 1)}).items()}
    unread = tables.unread_documents(spark, str(tmp_path), metadata).collect()
    assert sorted((r["doc_id"], r["status"]) for r in unread) == [("bad.txt", "unreadable"), ("gone.txt", "missing"), ("long.txt", "unreadable")]


def test_describe_matches_golden(processed):
    golden = pd.read_csv(f"{GOLDENS}/describe.csv", index_col=0)
    rows = {r["column"]: r for r in profile.describe(processed).collect()}
    assert list(rows) == list(golden.columns)
    names = dict(zip(golden.index, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]))
    for column in golden:
        for label, field in names.items():
            assert math.isclose(rows[column][field], golden.loc[label, column], rel_tol=1e-9, abs_tol=1e-9)


def test_describe_turned(processed):
    turned = profile.describe_by_statistic(profile.describe(processed, ["价格", "销量"]))
    assert turned.columns == ["statistic", "价格", "销量"]
    assert [r["statistic"] for r in turned.collect()][:2] == ["count", "mean"]


def test_correlations_match_golden(processed):
    golden = pd.read_csv(f"{GOLDENS}/correlations.csv", index_col=0)
    rows = {(r["a"], r["b"]): r["r"] for r in profile.correlations(processed).collect()}
    assert len(rows) == golden.size
    for a in golden.index:
        for b in golden.columns:
            expected = golden.loc[a, b]
            if math.isnan(expected):
                assert rows[a, b] is None
            else:
                assert math.isclose(rows[a, b], expected, abs_tol=1e-9)


def test_wide_correlations_with_gaps(spark):
    """Against pandas: columns far from zero, constant ones, without a value, constant on the rows shared with another."""
    rng = np.random.default_rng(9)
    n, width = 400, 60
    base = rng.normal(size=(n, 4))
    x = base @ rng.normal(size=(4, width)) + rng.normal(size=(n, width)) + rng.choice([0, 1e6, -3e3], width)
    x[rng.random((n, width)) < rng.random(width) * 0.6] = np.nan
    x[:, 5], x[:, 6], x[:, 7] = 4.25, np.nan, 0.1
    x[:, 8], x[:, 9] = np.where(np.arange(n) < 200, 2.0, np.arange(n)), np.where(np.arange(n) < 200, np.arange(n), np.nan)
    x[1:, 10] = np.nan  # one value
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(width)])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf)).repartition(5)
    found = profile.correlations(df).toPandas().pivot(index="a", columns="b", values="r").loc[list(pdf), list(pdf)].to_numpy()
    assert np.allclose(found, found.T, equal_nan=True) and np.isnan(found[5]).all() and np.isnan(found[7]).all() and np.isnan(found[8, 9]) and np.isnan(found[10]).all()
    expected = pdf.corr(min_periods=2).to_numpy()
    plain = [i for i in range(width) if i not in (5, 6, 7, 8, 9, 10)]
    assert np.allclose(found[np.ix_(plain, plain)], expected[np.ix_(plain, plain)], atol=1e-9, equal_nan=True)
    assert profile.correlations(df.limit(0)).filter("r IS NOT NULL").count() == 0


def test_target_correlations_order(processed):
    matrix = profile.correlations(processed, ["价格", "销量", "成本", "销售月份"])
    assert [r["column"] for r in profile.target_correlations(matrix, "价格").collect()] == ["价格", "成本", "销量", "销售月份"]


def test_dataset_profile(raw, spark):
    rows = {r["column"]: r for r in profile.dataset_profile(raw).collect()}
    assert rows["价格"]["is_possible_target"] and not rows["地区"]["is_possible_target"]
    df = spark.createDataFrame(
        [("2024-01-01", "x", 1, None), ("2024/02/03", "2024-01-01", 2, 3.0)],
        "sale_date string, time_text string, row_id int, v double",
    )
    rows = {r["column"]: r for r in profile.dataset_profile(df).collect()}
    assert rows["sale_date"]["is_datetime"] and not rows["time_text"]["is_datetime"]
    assert not rows["row_id"]["is_possible_target"] and rows["v"]["is_possible_target"]
    assert rows["v"]["n_null"] == 1 and rows["v"]["n_rows"] == 2


def test_null_profile(processed):
    assert [tuple(r) for r in profile.null_profile(processed).collect()] == [("促销利润率", 29, 54.7)]


def test_category_profile(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "s string")
    row = profile.category_profile(df, k=2).first()
    assert (row["n_distinct"], row["sample"], row["truncated"]) == (4, ["a", "b"], True)
    row = profile.category_profile(df, k=3, count_null=False).first()
    assert (row["n_distinct"], row["sample"], row["truncated"]) == (3, ["a", "b", "c"], False)
    row = profile.category_profile(df, k=10).first()
    assert row["sample"] == ["a", "b", "c", None]


def test_roles(processed, raw):
    assert roles.feature_target(processed) == "价格"
    assert roles.analysis_target(processed) == "销量"
    assert roles.analysis_target(processed, "成本") == "成本"
    with pytest.raises(ValueError):
        roles.feature_target(processed, "nope")
    with pytest.raises(ValueError):
        roles.feature_target(processed.select("地区"))
    figures = roles.key_figure_roles(processed)
    assert figures["price"] == "价格" and figures["profit"] == "利润" and figures["region"] == "地区"
    assert figures["product"] == "产品类别" and figures["quantity"] == "销量" and figures["revenue"] == "销售额"
    assert roles.key_figure_roles(processed, {"price": "成本"})["price"] == "成本"
    numeric = roles.numeric_columns(processed)
    scaled = roles.scalable_columns(numeric, roles.string_columns(processed))
    assert "地区平均评分" not in scaled and "价格" in scaled and "是否周末" not in numeric
    kinds = [s["kind"] for s in roles.default_tests(raw, "利润")]
    assert kinds == ["t_pooled", "anova", "anova"]
    assert not roles.has_time_series(raw.select("价格"))
    assert roles.has_time_series(raw.select(F.col("销售日期").alias("sale_date")))
    assert roles.has_time_series(raw.select("价格"), ["sale_month"])


def test_tails():
    assert math.isclose(t_two_sided(2.228138852, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(f_upper(4.964602743730711, 1, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(chi2_upper(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_upper(124.3421134, 100), 0.05, rel_tol=1e-6)
    assert math.isclose(incomplete_beta(2, 3, 0.5), 0.6875, rel_tol=1e-12)
    assert t_two_sided(0.0, 5) == 1.0 and f_upper(0.0, 2, 3) == 1.0 and chi2_upper(0.0, 2) == 1.0
