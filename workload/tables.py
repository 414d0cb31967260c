"""Input tables of the registered queries, with the same definitions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.sources.tables import load_table

SALES_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SALES_NUMBERS = ["price", "quantity", "cost", "revenue", "profit"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; none of them holds NaN, so filters may reach the scan."""
    return load_table(spark, f"{folder}/{name}.parquet", normalise_nan=False)


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Sales lines with price, quantity, cost, revenue, profit, promotion, category, product, region, date."""
    get = lambda name: table(spark, folder, name)
    joined = (
        get("lineitem")
        .join(get("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(get("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(get("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(get("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    price, quantity = F.col("p_retailprice"), F.col("l_quantity")
    cost = F.lit(0.6) * price
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        price.alias("price"), quantity.alias("quantity"), cost.alias("cost"),
        (price * quantity).alias("revenue"), ((price - cost) * quantity).alias("profit"),
        (F.col("l_discount") >= 0.05).alias("promotion"), F.col("l_discount").alias("discount"),
        F.col("p_type").alias("category"), F.col("p_name").alias("product"), F.col("r_name").alias("region"),
        F.col("l_shipdate").alias("sale_date"),
    )


SALES_SQL = """sales AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_retailprice AS price, l_quantity AS quantity,
         CAST(0.6 AS DOUBLE) * p_retailprice AS cost, p_retailprice * l_quantity AS revenue,
         (p_retailprice - CAST(0.6 AS DOUBLE) * p_retailprice) * l_quantity AS profit,
         l_discount >= 0.05 AS promotion, l_discount AS discount, p_type AS category, p_name AS product,
         r_name AS region, l_shipdate AS sale_date
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def holed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with missing numbers, a sparse column, missing categories and a ratio at the limit."""
    when = lambda condition, c: F.expr(f"CASE WHEN {condition} THEN NULL ELSE {c} END")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        when("o_orderkey % 7 = 0", "o_totalprice").alias("total"),
        when("o_orderkey % 5 < 2", "o_orderpriority").alias("sparse"),
        when("o_orderkey % 10 < 3", "o_orderpriority").alias("at_limit"),
        when("o_orderkey % 11 = 0", "o_orderstatus").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.expr("CASE WHEN o_orderkey = 5 THEN 'not-a-date' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END").alias("time"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("noted"),
    )


HOLED_SQL = """holed AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS total,
         CASE WHEN o_orderkey % 5 < 2 THEN NULL ELSE o_orderpriority END AS sparse,
         CASE WHEN o_orderkey % 10 < 3 THEN NULL ELSE o_orderpriority END AS at_limit,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status,
         strftime(o_orderdate, '%Y-%m-%d') AS "date",
         CASE WHEN o_orderkey = 5 THEN 'not-a-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "time",
         strftime(o_orderdate, '%Y-%m-%d') AS noted
  FROM orders)"""


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Double columns rounded for comparison across engines."""
    cols = cols or tuple(n for n, t in df.dtypes if t == "double")
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])
