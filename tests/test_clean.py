import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, profile


@pytest.fixture(scope="module")
def holed(spark):
    return spark.createDataFrame(
        [(1, None, "b", "z", None), (None, None, "a", "z", 3.0), (4, 1.0, None, None, 5.0), (7, 2.0, "b", "y", None), (None, 1.0, "a", "y", 4.0)],
        "i int, x double, s string, t string, h double",
    )


def test_sparse_columns_strictly_above(spark):
    df = spark.range(10).select(
        F.when(F.col("id") >= 3, 1).alias("three_tenths"), F.when(F.col("id") >= 4, 1).alias("four_tenths"), "id"
    )
    assert clean.drop_sparse_columns(df, 0.3).columns == ["three_tenths", "id"]


def test_fills(holed):
    out = clean.fill_means(holed, ["i", "x"])
    assert dict(out.dtypes)["i"] == "double"
    assert [r["i"] for r in out.collect()] == [1.0, 4.0, 4.0, 7.0, 4.0]
    # ties take the smallest value
    out = clean.fill_modes(holed)
    assert [r["s"] for r in out.collect()] == ["b", "a", "a", "b", "a"]
    assert [r["t"] for r in out.collect()] == ["z", "z", "y", "y", "y"]
    assert clean.handle_missing(holed, 0.3).columns == ["s", "t"]


def test_all_null_column(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "x double, s string")
    assert clean.fill_modes(clean.fill_means(df)).collect() == df.collect()


def test_outliers(spark):
    df = spark.range(1, 101).select(
        F.when(F.col("id") == 100, 10_000.0).otherwise(F.col("id").cast("double")).alias("v"),
        F.when(F.col("id") == 5, -900.0).otherwise(0.5 * F.col("id")).alias("w"),
        F.lit(0.1).alias("flat"),
    )
    rows = {r["column"]: r for r in clean.detect_outliers(df).collect()}
    assert (rows["v"]["n_outliers"], rows["v"]["pct_outliers"]) == (1, 1.0)
    assert rows["flat"]["n_outliers"] == 0
    assert [tuple(r) for r in clean.outlier_values(df).orderBy("column").collect()] == [("v", 10000.0), ("w", -900.0)]
    assert clean.remove_outliers(df).count() == 98
    assert clean.remove_outliers(df, snapshot=True).count() == 98
    assert clean.remove_outliers(df, map_limit=10).count() == 98
    # a constant column does not empty the table
    assert clean.remove_outliers(df, "zscore", 3.0).count() == 98
    z = {r["column"]: r["n_outliers"] for r in clean.detect_outliers(df, "zscore", 3.0).collect()}
    assert z == {"v": 1, "w": 1, "flat": 0}
    for call in (clean.detect_outliers, clean.remove_outliers, clean.outlier_values):
        with pytest.raises(ValueError):
            call(df, "median")


def test_removal_is_sequential(spark):
    # The row with the outlying a also has the largest b; b's bounds are those of the remaining rows.
    rows = [(float(i), float(i)) for i in range(10)] + [(1000.0, 30.0), (5.0, 16.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    pdf = df.toPandas()
    for c in ("a", "b"):
        q1, q3 = pdf[c].quantile(0.25), pdf[c].quantile(0.75)
        pdf = pdf[(pdf[c] >= q1 - 1.5 * (q3 - q1)) & (pdf[c] <= q3 + 1.5 * (q3 - q1))]
    assert clean.remove_outliers(df).count() == len(pdf)


def test_null_drops_row(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double")
    assert clean.remove_outliers(df).count() == 2


def test_coercion(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "2024-01-01", "2024-01-05 10:00:00", "short"), ("2024-02-01", "not-a-date", None, "20240101")],
        "Date string, `时间` string, noted string, s string",
    )
    types = dict(clean.coerce_datetimes(df).dtypes)
    assert types == {"Date": "timestamp_ntz", "时间": "string", "noted": "timestamp_ntz", "s": "string"}
    types = dict(clean.coerce_datetimes(df, by_content=False).dtypes)
    assert types["noted"] == "string" and types["Date"] == "timestamp_ntz"
    loose = dict(clean.coerce_datetimes(df.withColumnRenamed("noted", "time_noted"), by_content=False, name_parts=["time"]).dtypes)
    assert loose["time_noted"] == "timestamp_ntz" and loose["Date"] == "string"


def test_nominal(spark):
    df = spark.range(100).select(
        (F.col("id") % 3).cast("string").alias("few"),
        F.when(F.col("id") > 0, (F.col("id") % 9).cast("string")).alias("ten_with_null"),
        F.col("id").cast("string").alias("many"),
    )
    rows = {r["column"]: (r["n_distinct"], r["is_categorical"]) for r in clean.nominal_report(df).collect()}
    assert rows == {"few": (3, True), "ten_with_null": (10, False), "many": (100, False)}
    tagged = clean.tag_nominal(df)
    assert [clean.is_nominal(tagged, c) for c in df.columns] == [True, False, False]


def test_a_text_is_parsed_by_formats_of_its_shape_only(spark):
    formats = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd"]
    texts = ["2024-02-29", "2023-02-29", "12/31/2024", "31/12/2024", "2024-01-02T03:04:05", "20240102", " 2024-01-02 ", "2024/01/02", "n/a", "", None, "0000-00-00", "２０２４-01-02"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    show = lambda f: [None if r[0] is None else str(r[0]) for r in df.select(profile.parsed_datetime("t", f)).collect()]
    day = lambda d, t="00:00:00": f"{d} {t}"
    wanted = [day("2024-02-29"), None, day("2024-12-31"), day("2024-12-31"), day("2024-01-02", "03:04:05"), day("2024-01-02"), day("2024-01-02")] + [None] * 6
    assert show(formats) == wanted
    assert show([*formats, "d MMM yyyy"]) == wanted  # next to a pattern that has no single shape
