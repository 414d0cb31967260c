import math

import pytest

from plumbline.operators import inference
from plumbline.sources.tables import load_table


@pytest.fixture(scope="module")
def processed(spark):
    return load_table(spark, "tests/goldens/processed_sales.csv").cache()


def test_published_results(processed):
    specs = [
        {"test_name": "promotion", "kind": "t_welch", "columns": ["促销活动", "销量"]},
        {"test_name": "pooled", "kind": "t_pooled", "columns": ["促销活动", "销量"]},
        {"test_name": "weekend", "kind": "t_welch", "columns": ["是否周末", "销量"]},
        {"test_name": "rating", "kind": "pearson", "columns": ["客户评分", "销量"]},
        {"test_name": "price", "kind": "pearson", "columns": ["价格", "销量"]},
        {"test_name": "independence", "kind": "chi2", "columns": ["促销活动", "产品类别"]},
        {"test_name": "gone", "kind": "anova", "columns": ["nope", "销量"]},
        {"test_name": "three values", "kind": "t_welch", "columns": ["地区", "销量"]},
    ]
    rows = {r["test_name"]: r for r in inference.run_tests(processed, specs).collect()}
    assert set(rows) == {"promotion", "pooled", "weekend", "rating", "price", "independence"}
    assert math.isclose(abs(rows["promotion"]["statistic"]), 1.0180, abs_tol=5e-5)
    assert math.isclose(rows["promotion"]["df1"], 50.946, abs_tol=5e-4)
    assert math.isclose(rows["promotion"]["p_value"], 0.3135, abs_tol=5e-5)
    assert math.isclose(abs(rows["pooled"]["statistic"]), 0.9965, abs_tol=5e-5)
    assert math.isclose(abs(rows["weekend"]["statistic"]), 0.1927, abs_tol=5e-5)
    assert math.isclose(rows["weekend"]["p_value"], 0.8489, abs_tol=5e-5)
    assert math.isclose(rows["rating"]["p_value"], 0.0067, abs_tol=5e-5) and rows["rating"]["reject"]
    assert rows["price"]["p_value"] < 5e-5
    assert math.isclose(rows["independence"]["p_value"], 0.9092, abs_tol=5e-5)
    assert math.isclose(rows["independence"]["statistic"], 0.5435, abs_tol=5e-5)
    assert rows["independence"]["df1"] == 3 and rows["independence"]["decision"] == "not significant"


def test_two_by_two_has_yates(spark):
    cells = {("a", "x"): 12, ("a", "y"): 5, ("b", "x"): 3, ("b", "y"): 9}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "g string, h string")
    n, gap = 29, abs(12 - 17 * 15 / 29)
    expected = sum((gap - 0.5) ** 2 / e for e in (17 * 15 / n, 17 * 14 / n, 12 * 15 / n, 12 * 14 / n))
    row = inference.chi2_statistics(df, "g", "h").first()
    assert math.isclose(row["statistic"], expected, rel_tol=1e-9) and row["df"] == 1


def test_anova_and_edges(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 5.0), ("c", 9.0), ("c", None), (None, 3.0)], "g string, v double"
    )
    row = inference.anova_statistics(df, "g", "v").first()
    # group means 1.5, 4.5, 9.0 around 4.2
    between = 2 * 2.7**2 + 2 * 0.3**2 + 4.8**2
    assert math.isclose(row["statistic"], (between / 2) / (1.0 / 2), rel_tol=1e-9)
    assert (row["df1"], row["df2"]) == (2.0, 2.0)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    assert inference.pearson_statistics(flat, "a", "b").first()["r"] is None
    one = [{"test_name": "t", "kind": "anova", "columns": ["g", "v"]}]
    assert inference.run_tests(df.filter("g = 'a'"), one).count() == 0
    assert inference.run_tests(flat, [{"test_name": "p", "kind": "pearson", "columns": ["a", "b"]}]).count() == 0
    with pytest.raises(ValueError):
        inference.run_tests(df, [{"test_name": "x", "kind": "sign", "columns": ["g", "v"]}])


def test_chi_square_against_fractions(spark):
    """Tables with and without empty cells, against exact arithmetic."""
    from fractions import Fraction

    from plumbline.operators import inference

    small = [[30, 31, 29], [10, 9, 12]]
    df = spark.createDataFrame([(i, j) for i, r in enumerate(small) for j, n in enumerate(r) for _ in range(n)], "a int, b int")
    n, rows, cols = 121, [90, 31], [40, 40, 41]
    exact = sum((small[i][j] - Fraction(rows[i] * cols[j], n)) ** 2 / Fraction(rows[i] * cols[j], n) for i in range(2) for j in range(3))
    assert inference.chi2_statistics(df, "a", "b").first()["statistic"] == pytest.approx(float(exact), rel=1e-12)
    gap = spark.createDataFrame([(0, 0)] * 5 + [(1, 1)] * 7 + [(2, 1)] * 2 + [(2, 2)] * 3, "a int, b int")
    cells, n = {(0, 0): 5, (1, 1): 7, (2, 1): 2, (2, 2): 3}, 17
    row, col = {0: 5, 1: 7, 2: 5}, {0: 5, 1: 9, 2: 3}
    exact = sum((cells.get((i, j), 0) - Fraction(row[i] * col[j], n)) ** 2 / Fraction(row[i] * col[j], n) for i in row for j in col)
    assert inference.chi2_statistics(gap, "a", "b").first()["statistic"] == pytest.approx(float(exact), rel=1e-12)


def test_t_with_many_degrees_of_freedom():
    from plumbline.functions.tails import t_two_sided

    assert t_two_sided(1.959963984540054, 1e14) == pytest.approx(0.05, rel=1e-9)
    assert t_two_sided(1.959963984540054, 9e7) == pytest.approx(0.05, rel=1e-4)
