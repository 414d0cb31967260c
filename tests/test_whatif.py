import math

import numpy as np
import pandas as pd
import pytest

from plumbline import fixed_values as fixed
from plumbline.operators import whatif
from plumbline.sources.tables import load_table
from tests.goldens.scenarios import CHANGES_PCT, SPECS, TOTALS


@pytest.fixture(scope="module")
def processed(spark):
    return load_table(spark, "tests/goldens/processed_sales.csv").cache()


def test_baseline_golden(processed):
    rows = {r["figure"]: r["value"] for r in whatif.baseline(processed).collect()}
    expected = {"平均价格": 4066.92, "平均销量": 129.45, "平均成本": 2360.38, "平均利润": 169804.51,
                "总销售额": 21338939.0, "总利润": 8999639.0, "产品类别数": 4, "地区数": 3}
    assert list(rows) == list(expected)
    assert all(math.isclose(rows[k], v, abs_tol=0.005) for k, v in expected.items())


def test_all_published_rows(processed):
    rows = whatif.what_if(processed, SPECS, "reference").collect()
    assert len(rows) == 36
    for r, total, pct in zip(rows, TOTALS, CHANGES_PCT):
        assert r["current_total"] == 21338939.0
        assert math.isclose(r["scenario_total"], total, abs_tol=0.00501), r
        assert math.isclose(r["change_pct"], pct, abs_tol=0.00501), r


def test_comparable_totals(processed):
    rows = {r["parameter"]: r for r in whatif.what_if(
        processed,
        [{"parameters": {"price_change_range": 0, "note": "n/a"}}, {"recommended": False, "parameters": {"x": 1}}],
    ).collect()}
    assert set(rows) == {"price_change_range", "note"}
    assert all(abs(r["change"]) < 1e-6 for r in rows.values()) and rows["note"]["value"] is None
    assert rows["note"]["scenario_type"] == "scenario_1" and rows["note"]["title"] == "场景1"
    with pytest.raises(ValueError):
        whatif.what_if(processed, [], "other")
    assert whatif.what_if(processed, []).count() == 0


def test_same_type_is_kept_twice(processed):
    spec = {"scenario_type": "s", "parameters": {"sales_multiplier": [2, 3]}}
    assert whatif.what_if(processed, [spec, spec]).count() == 4


@pytest.mark.parametrize(
    "name, value, effect",
    [
        ("price_range", 10, ("scale", 1.1)), ("cost_threshold", 3, ("lift_below", 3)), ("profit_target", 10, ("scale", 1.1)),
        ("profit_shift", 10, ("shift", 0.1)), ("cost_increase", 10, ("scale", 0.9)), ("growth", 10, ("scale", 1.1)),
        ("a_multiplier", 2, ("scale", 2)), ("other", 10, ("scale", 1.1)),
    ],
)
def test_adjustment_rules(name, value, effect):
    kind, amount = whatif.adjustment(name, value)
    assert kind == effect[0] and math.isclose(amount, effect[1])


def test_touched_columns():
    numeric = ["价格", "成本", "销售额", "利润", "利润率"]
    assert whatif.touched_columns("price_change_range", numeric) == ["价格"]
    assert whatif.touched_columns("reduce_waste", numeric) == ["成本"]
    assert whatif.touched_columns("anything", numeric) == ["销售额", "利润", "利润率"]
    assert whatif.touched_columns("unit_price", ["unit_price", "sum"]) == ["unit_price"]
    assert whatif.touched_columns("anything", ["Revenue", "my_profit"]) == ["my_profit"]


def test_business_scenarios(spark):
    df = spark.createDataFrame([(10.0, 2.0, 6.0), (5.0, 4.0, 1.0)], "price double, quantity double, cost double")
    rows = {(r["scenario"], r["value"]): r for r in whatif.business_scenarios(df).collect()}
    assert len(rows) == 9
    up = rows["price_change", 5.0]
    assert math.isclose(up["revenue"], 42.0) and math.isclose(up["profit"], 26.0)
    assert math.isclose(rows["sales_increase", 10.0]["profit_change_pct"], 10.0)
    assert math.isclose(rows["cost_reduction", 10.0]["profit"], 40 - 16 * 0.9)
    assert rows["price_change", 0.0]["profit_change"] == 0.0


def test_many_thresholds_in_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"profit": rng.normal(size=500).round(1), "revenue": rng.integers(-3, 9, 500).astype(float), "note": "x"})
    pdf.loc[::9, "profit"] = None
    limits = [float(x) for x in rng.integers(-30, 90, 300) / 10] + [-1e9, 1e9, 3.0, 3.0]
    specs = [{"title": "t", "parameters": {"promotion_profit_margin_threshold": limits, "profit_shift": [5], "price_change_range": ["n/a"]}}]
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "profit double, revenue double, note string").repartition(3)
    calls = []
    monkeypatch.setattr(whatif, "_column_sums", lambda *a, real=whatif._column_sums: calls.append(1) or real(*a))
    rows = whatif.what_if(df, specs).collect()
    whole, lift = pdf["profit"].sum() + pdf["revenue"].sum(), fixed.THRESHOLD_FACTOR - 1
    assert len(calls) == 1 and len(rows) == len(limits) + 2
    for row, limit in zip(rows, limits):
        below = sum(pdf[c][pdf[c] < limit].sum() for c in ("profit", "revenue"))
        assert row["value"] == limit and np.isclose(row["scenario_total"], whole + lift * below) and np.isclose(row["current_total"], whole)
    assert np.isclose(rows[-2]["change"], 0.05 * pdf["profit"].notna().sum()) and (rows[-1]["value"], rows[-1]["change"]) == (None, 0.0)
    empty = whatif.what_if(df.limit(0), specs).collect()
    assert len(empty) == len(rows) and {r["scenario_total"] for r in empty} == {0.0}
