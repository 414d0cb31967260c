import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.quantiles import column_quantiles, grouped_quantiles, order_statistics

PROBS = (0.0, 0.25, 0.5, 0.9, 1.0)


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one group, a third of them one value, plus nulls."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.when(F.col("id") % 3 == 0, 42.0)
        .when(F.col("id") % 50 == 1, None)
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0)
        .alias("v"),
        (F.pmod(F.xxhash64("id"), F.lit(10**15)) + 2**60).alias("big"),
    )
    return df, df.toPandas()


@pytest.mark.parametrize("limit", [200_000, 64])
def test_column_quantiles_match_numpy(skewed, limit):
    df, pdf = skewed
    found, row = column_quantiles(df, ["v"], PROBS, [F.count("*").alias("rows")], map_limit=limit)
    assert np.allclose(found["v"], pdf["v"].quantile(list(PROBS)), rtol=0, atol=1e-9)
    assert row["rows"] == len(pdf)


def test_order_statistics_keep_long_precision(skewed):
    df, pdf = skewed
    values = np.sort(pdf["big"].to_numpy())
    ranks = [(0, 0), (1234, 1235), (19_999, 19_999)]
    found = order_statistics(df, {"big": ranks}, map_limit=64)
    for pair in ranks:
        for r in pair:
            assert found["big", r] == values[r]


@pytest.mark.parametrize("limit", [2_000_000, 64, 3000])
def test_grouped_quantiles_match_numpy(skewed, limit):
    df, pdf = skewed
    rows = {r["g"]: r for r in grouped_quantiles(df, "g", "v", PROBS, map_limit=limit).collect()}
    for g, part in pdf.groupby("g"):
        assert rows[g]["n"] == part["v"].count()
        assert np.allclose(rows[g]["q"], part["v"].quantile(list(PROBS)), rtol=0, atol=1e-9)
    assert len(rows) == pdf["g"].nunique()


def test_edges(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    found, _ = column_quantiles(df, ["a", "b"], (0.25, 0.5))
    assert found == {"a": [None, None], "b": [1.0, 1.0]}
    empty, _ = column_quantiles(df.filter("false"), ["b"], (0.5,))
    assert empty == {"b": [None]}
    approx, _ = column_quantiles(spark.range(1001), ["id"], (0.5,), accuracy=1000)
    assert math.isclose(approx["id"][0], 500, abs_tol=2)
