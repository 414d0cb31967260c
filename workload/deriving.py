"""Queries for derived, group-relative and calendar columns."""

from pyspark.sql import functions as F

from plumbline.operators import derive
from workload.tables import SALES_KEYS, SALES_SQL, rounded, sales, table

QUERIES, SQL = {}, {}
_KEYS = ", ".join(SALES_KEYS)

_SPECS = [
    {"column_name": "unit_profit", "calculation": "price - cost", "description": "profit of one piece"},
    {"column_name": "broken", "calculation": "no_such_column + 1", "description": "skipped"},
    {"column_name": "margin", "calculation": "try_divide(unit_profit, price)", "description": "uses the first"},
    {"column_name": "big", "calculation": "CASE WHEN quantity > 25 THEN 'yes' ELSE 'no' END", "description": "conditional"},
]
QUERIES["add_derived_columns"] = lambda s, d: rounded(
    derive.add_derived_columns(sales(s, d), _SPECS)[0].select(*SALES_KEYS, "unit_profit", "margin", "big"), 6, "unit_profit", "margin"
)
SQL["add_derived_columns"] = f"""WITH {SALES_SQL} SELECT {_KEYS}, round(price - cost, 6) AS unit_profit,
  round((price - cost) / nullif(price, 0), 6) AS margin, CASE WHEN quantity > 25 THEN 'yes' ELSE 'no' END AS big FROM sales"""

QUERIES["sales_measures"] = lambda s, d: rounded(
    derive.add_sales_measures(sales(s, d), "price", "quantity", "cost").select(*SALES_KEYS, "revenue", "profit", "margin"),
    4, "revenue", "profit", "margin",
)
SQL["sales_measures"] = f"""WITH {SALES_SQL} SELECT {_KEYS}, round(price * quantity, 4) AS revenue,
  round((price - cost) * quantity, 4) AS profit, round((price - cost) / nullif(price, 0), 4) AS margin FROM sales"""

QUERIES["conditional_column"] = lambda s, d: rounded(
    derive.add_conditional(sales(s, d), "promoted_profit", F.col("promotion"), "profit").select(*SALES_KEYS, "promoted_profit"), 4, "promoted_profit"
)
SQL["conditional_column"] = f"WITH {SALES_SQL} SELECT {_KEYS}, round(CASE WHEN promotion THEN profit END, 4) AS promoted_profit FROM sales"


def _relative(s, d):
    df = derive.add_group_means(sales(s, d), [("region", "profit", "region_profit"), ("category", "quantity", "category_quantity")])
    df = derive.add_ratio(df, "relative", "quantity", "category_quantity")
    return rounded(df.select(*SALES_KEYS, "region_profit", "category_quantity", "relative"), 5, "region_profit", "category_quantity", "relative")


QUERIES["group_means_and_ratio"] = _relative
SQL["group_means_and_ratio"] = f"""WITH {SALES_SQL} SELECT {_KEYS}, round(avg(profit) OVER (PARTITION BY region), 5) AS region_profit,
  round(avg(quantity) OVER (PARTITION BY category), 5) AS category_quantity,
  round(quantity / avg(quantity) OVER (PARTITION BY category), 5) AS relative FROM sales"""

QUERIES["calendar_columns"] = lambda s, d: derive.add_calendar_columns(sales(s, d).select(*SALES_KEYS, "sale_date"))
SQL["calendar_columns"] = f"""WITH {SALES_SQL} SELECT {_KEYS}, sale_date, CAST(year(sale_date) AS INTEGER) AS "sale_date_年份",
  CAST(month(sale_date) AS INTEGER) AS "sale_date_月份", CAST(day(sale_date) AS INTEGER) AS "sale_date_日",
  CAST(isodow(sale_date) - 1 AS INTEGER) AS "sale_date_星期", dayname(sale_date) AS "sale_date_星期名称" FROM sales"""

QUERIES["calendar_features"] = lambda s, d: derive.add_calendar_features(sales(s, d).select(*SALES_KEYS, "sale_date"))
SQL["calendar_features"] = f"""WITH {SALES_SQL} SELECT {_KEYS}, sale_date, CAST(quarter(sale_date) AS INTEGER) AS "sale_date_季度",
  CAST(isodow(sale_date) >= 6 AS INTEGER) AS "sale_date_是否周末", monthname(sale_date) AS "sale_date_月份名称",
  strftime(sale_date, '%Y-%m') AS "sale_date_年月", CAST(day(sale_date) <= 10 AS INTEGER) AS "sale_date_月初",
  CAST(day(sale_date) BETWEEN 11 AND 20 AS INTEGER) AS "sale_date_月中", CAST(day(sale_date) > 20 AS INTEGER) AS "sale_date_月末" FROM sales"""


def _zero_divisor(s, d):
    specs = [
        {"column_name": "odd_price", "calculation": "o_totalprice / (o_orderkey % 2)"},
        {"column_name": "rest", "calculation": "o_custkey % (o_orderkey % 3)"},
        {"column_name": "number", "calculation": "cast(o_orderstatus as int)"},
    ]
    df, _ = derive.add_derived_columns(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus"), specs)
    return rounded(df, 4, "odd_price").select("o_orderkey", "odd_price", F.col("rest").cast("bigint").alias("rest"), "number")


QUERIES["derived_zero_divisor"] = _zero_divisor
SQL["derived_zero_divisor"] = """SELECT o_orderkey, round(o_totalprice / nullif(o_orderkey % 2, 0), 4) AS odd_price,
  CAST(o_custkey % nullif(o_orderkey % 3, 0) AS BIGINT) AS rest, try_cast(o_orderstatus AS INTEGER) AS number FROM orders"""

# A third of all rows has no key.
_HOLED = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END"


def _null_group(s, d):
    df = table(s, d, "events").selectExpr("event_id", f"{_HOLED} AS user_id", "value")
    return rounded(derive.add_group_means(df, [("user_id", "value", "mean")]), 6, "mean").select("event_id", "mean")


QUERIES["group_means_null_key"] = _null_group
SQL["group_means_null_key"] = f"""WITH e AS (SELECT event_id, {_HOLED} AS u, value FROM events)
  SELECT event_id, CASE WHEN u IS NOT NULL THEN round(avg(value) OVER (PARTITION BY u), 6) END AS mean FROM e"""
