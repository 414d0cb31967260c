import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import lookup
from plumbline.operators import derive
from plumbline.sources.tables import load_table


@pytest.fixture(scope="module")
def raw(spark):
    return load_table(spark, "tests/goldens/raw_sales.csv").cache()


def test_processed_table_is_rebuilt(raw):
    specs = [
        {"column_name": "销售额", "calculation": "`价格` * `销量`"},
        {"column_name": "利润", "calculation": "(`价格` - `成本`) * `销量`"},
        {"column_name": "利润率", "calculation": "try_divide(`价格` - `成本`, `价格`)"},
        {"column_name": "坏", "calculation": "`没有` + 1"},
        {"column_name": "语法", "calculation": "1 +"},
        {"column_name": "双倍", "calculation": "`利润` * 2"},
    ]
    df, skipped = derive.add_derived_columns(raw, specs)
    assert [s["column_name"] for s in skipped] == ["坏", "语法"]
    assert "双倍" in df.columns
    df = derive.add_conditional(df, "促销利润率", F.col("促销活动") == "是", "利润率")
    df = derive.add_group_means(df, [("地区", "客户评分", "地区平均评分"), ("产品类别", "销量", "类别平均销量")])
    df = derive.add_ratio(df, "销量与类别平均比", "销量", "类别平均销量")
    df = derive.add_calendar_columns(df, ["销售日期"])
    golden = pd.read_csv("tests/goldens/processed_sales.csv").sort_values(["销售日期", "产品名称", "地区", "销量"])
    mine = df.toPandas().sort_values(["销售日期", "产品名称", "地区", "销量"])
    for c in ["销售额", "利润", "利润率", "促销利润率", "地区平均评分", "类别平均销量", "销量与类别平均比",
              "销售日期_年份", "销售日期_月份", "销售日期_日", "销售日期_星期", "销售日期_星期名称"]:
        if golden[c].dtype.kind in "if":
            assert ((mine[c].to_numpy(float) - golden[c].to_numpy(float)) ** 2 > 1e-18).sum() == 0, c
            assert mine[c].isna().sum() == golden[c].isna().sum()
        else:
            assert list(mine[c]) == list(golden[c])
    assert df.agg(F.sum("销售额"), F.sum("利润")).first()[:] == (21338939, 8999639)


def test_sales_measures_zero_price(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0), (4.0, 3.0, 1.0)], "p double, q double, c double")
    rows = derive.add_sales_measures(df, "p", "q", "c").collect()
    assert rows[0]["margin"] is None and (rows[1]["revenue"], rows[1]["profit"], rows[1]["margin"]) == (12.0, 9.0, 0.75)


def test_calendar_features(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-05-11 09:00:00' AS d UNION ALL SELECT timestamp_ntz'2024-12-31 00:00:00'")
    rows = derive.add_calendar_features(df).orderBy("d").collect()
    assert tuple(rows[0])[1:] == (2, 1, "May", "2024-05", 0, 1, 0)
    assert tuple(rows[1])[1:] == (4, 0, "December", "2024-12", 0, 0, 1)


@pytest.mark.parametrize("max_rows", [50_000, 5])
def test_group_means_with_and_without_broadcast(spark, max_rows, monkeypatch):
    # One key holds a third of the rows; a NULL key gets no mean.
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None).otherwise((F.col("id") % 40).cast("string")).alias("g"),
        F.col("id").cast("double").alias("v"),
    )
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", max_rows)
    monkeypatch.setattr(lookup.attach, "__defaults__", (max_rows,))
    monkeypatch.setattr(lookup, "HOT_SHARE", 0.1)
    out = derive.add_group_means(df, [("g", "v", "m")]).toPandas()
    assert len(out) == 3000
    expected = out.groupby("g")["v"].transform("mean")
    assert all(math.isclose(a, b) for a, b in zip(out["m"].dropna(), expected.dropna()))
    assert out.loc[out["g"].isna(), "m"].isna().all()
