"""Queries for baselines and what-if grids."""

from pyspark.sql import functions as F

from plumbline.operators import whatif
from workload.tables import SALES_NUMBERS, SALES_SQL, rounded, sales

QUERIES, SQL = {}, {}

QUERIES["baseline"] = lambda s, d: rounded(whatif.baseline(sales(s, d)), 4)
SQL["baseline"] = f"WITH {SALES_SQL} " + " UNION ALL ".join(
    f"""SELECT '{label.format(c)}' AS figure, '{c}' AS "column", '{kind}' AS statistic, round(CAST({call} AS DOUBLE), 4) AS value FROM sales"""
    for label, c, kind, call in [
        ("平均{}", "price", "mean", "avg(price)"), ("平均{}", "quantity", "mean", "avg(quantity)"), ("平均{}", "cost", "mean", "avg(cost)"),
        ("平均{}", "profit", "mean", "avg(profit)"), ("总{}", "revenue", "sum", "sum(revenue)"), ("总{}", "profit", "sum", "sum(profit)"),
        ("{}数", "product", "distinct", "count(DISTINCT product)"), ("{}数", "region", "distinct", "count(DISTINCT region)"),
    ]
)

_SPECS = [
    {"scenario_type": "pricing", "title": "prices", "parameters": {"price_change_range": [-10, 10], "promotion_profit_margin_threshold": 5000}},
    {"scenario_type": "costs", "title": "costs", "parameters": {"cost_reduction_targets": [5], "cost_increase_scenarios": [5, 10], "note": "n/a"}},
    {"scenario_type": "unused", "title": "unused", "recommended": False, "parameters": {"price_change_range": [1]}},
    {"scenario_type": "growth", "title": "growth", "parameters": {"sales_growth": [10], "quantity_multiplier": [2], "profit_shift": [5]}},
]
_LIFT = "0.05 * coalesce(sum({0}) FILTER ({0} < 5000), 0)"
# (position, type, title, parameter, value, change of the total)
_ROWS = [
    (1, "pricing", "prices", "price_change_range", -10, "-0.1 * sum(price)"),
    (1, "pricing", "prices", "price_change_range", 10, "0.1 * sum(price)"),
    (1, "pricing", "prices", "promotion_profit_margin_threshold", 5000, f"{_LIFT.format('revenue')} + {_LIFT.format('profit')}"),
    (2, "costs", "costs", "cost_reduction_targets", 5, "0.05 * sum(cost)"),
    (2, "costs", "costs", "cost_increase_scenarios", 5, "-0.05 * sum(cost)"),
    (2, "costs", "costs", "cost_increase_scenarios", 10, "-0.1 * sum(cost)"),
    (2, "costs", "costs", "note", "NULL", "0.0"),
    (4, "growth", "growth", "sales_growth", 10, "0.1 * (sum(revenue) + sum(profit))"),
    (4, "growth", "growth", "quantity_multiplier", 2, "sum(quantity)"),
    (4, "growth", "growth", "profit_shift", 5, "0.05 * count(*)"),
]


def _grid_sql(source, total, current):
    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{kind}' AS scenario_type, '{title}' AS title, '{p}' AS parameter, CAST({v} AS DOUBLE) AS value,
        round({current}, 2) AS current_total, round({total} + {delta}, 2) AS scenario_total,
        round({total} + {delta} - {current}, 2) AS change, round(({total} + {delta} - {current}) / nullif({current}, 0) * 100, 5) AS change_pct FROM {source}"""
        for i, kind, title, p, v, delta in _ROWS
    )


_ALL = " + ".join(f"sum({c})" for c in SALES_NUMBERS)


def _grid(df, mode):
    out = whatif.what_if(df, _SPECS, mode)
    return rounded(rounded(out, 2, "current_total", "scenario_total", "change"), 5, "change_pct")


QUERIES["what_if"] = lambda s, d: _grid(sales(s, d).select(*SALES_NUMBERS), "comparable")
SQL["what_if"] = f"WITH {SALES_SQL} {_grid_sql('sales', f'({_ALL})', f'({_ALL})')}"


# Ten thousand thresholds at once, on both columns that they touch.
_LIMITS = [round(i * 7.5, 1) for i in range(10_000)]


def _many_limits(s, d):
    specs = [{"scenario_type": "limits", "title": "limits", "parameters": {"promotion_profit_margin_threshold": _LIMITS}}]
    off_halves = {c: F.col(c) + 0.0001 for c in ("scenario_total", "change")}  # a twentieth of cents is often half a cent
    return rounded(whatif.what_if(sales(s, d).select(*SALES_NUMBERS), specs).select("value", *off_halves).withColumns(off_halves), 2, *off_halves)


QUERIES["what_if_thresholds"] = _many_limits
SQL["what_if_thresholds"] = f"""WITH {SALES_SQL}, g AS (SELECT CAST(unnest(range(10000)) * 7.5 AS DOUBLE) AS value),
  x AS (SELECT revenue AS v FROM sales UNION ALL SELECT profit FROM sales),
  b AS (SELECT floor(v / 7.5) AS i, sum(v) AS s FROM x WHERE v < 74992.5 GROUP BY 1),
  k AS (SELECT value, sum(coalesce(s, 0)) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM g LEFT JOIN b ON i = value / 7.5),
  t AS (SELECT {_ALL} AS total FROM sales)
  SELECT value, round(total + 0.05 * coalesce(below, 0) + 0.0001, 2) AS scenario_total, round(0.05 * coalesce(below, 0) + 0.0001, 2) AS change FROM k, t"""


def _reference(s, d):
    df = sales(s, d).select(F.col("revenue").alias("销售额"), F.col("profit").alias("利润"), F.col("price").alias("价格"))
    specs = [{"scenario_type": "risk", "title": "risk", "parameters": {
        "worst_case_scenario_drop": [-20], "region_performance_gap_threshold": [4000], "price_change_range": [5]}}]
    out = whatif.what_if(df, specs, "reference")
    return rounded(rounded(out, 2, "current_total", "scenario_total", "change"), 5, "change_pct")


QUERIES["what_if_reference"] = _reference
SQL["what_if_reference"] = f"""WITH {SALES_SQL}, m AS (SELECT sum(revenue) AS r, sum(profit) AS p,
    sum(revenue) FILTER (revenue < 4000) AS lr, sum(profit) FILTER (profit < 4000) AS lp FROM sales),
  t AS (SELECT 'worst_case_scenario_drop' AS parameter, CAST(-20 AS DOUBLE) AS value, r, r * 0.8 + p AS after FROM m
    UNION ALL SELECT 'region_performance_gap_threshold', 4000, r, r + 0.05 * lr + p + 0.05 * lp FROM m
    UNION ALL SELECT 'price_change_range', 5, r, r + p FROM m)
  SELECT 1 AS position, 'risk' AS scenario_type, 'risk' AS title, parameter, value, round(r, 2) AS current_total,
  round(after, 2) AS scenario_total, round(after - r, 2) AS change, round((after - r) / r * 100, 5) AS change_pct FROM t"""

QUERIES["business_scenarios"] = lambda s, d: rounded(rounded(whatif.business_scenarios(sales(s, d)), 2, "revenue", "profit", "profit_change"), 5, "profit_change_pct")
SQL["business_scenarios"] = f"""WITH {SALES_SQL}, m AS (SELECT sum(price * quantity) AS pq, sum(cost * quantity) AS cq FROM sales),
  g AS (SELECT 'sales_increase' AS scenario, CAST(v AS DOUBLE) AS value, pq * (1 + v / 100) AS r, (pq - cq) * (1 + v / 100) AS p, pq, cq FROM m, (VALUES (10), (20), (30)) t(v)
    UNION ALL SELECT 'price_change', v, pq * (1 + v / 100), pq * (1 + v / 100) - cq, pq, cq FROM m, (VALUES (-5), (0), (5)) t(v)
    UNION ALL SELECT 'cost_reduction', v, pq, pq - cq * (1 - v / 100), pq, cq FROM m, (VALUES (5), (10), (15)) t(v))
  SELECT scenario, value, round(r, 2) AS revenue, round(p, 2) AS profit, round(p - (pq - cq), 2) AS profit_change,
  round((p - (pq - cq)) / (pq - cq) * 100, 5) AS profit_change_pct FROM g"""
