"""Queries for whole stages and the full flow."""

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.plans import flows
from plumbline.session import materialise
from workload.modelling import SMALL
from workload.tables import HOLED_SQL, SALES_KEYS, SALES_NUMBERS, SALES_SQL, holed_orders, rounded, sales

QUERIES, SQL = {}, {}

_DERIVED = [{"column_name": "doubled", "calculation": "total * 2"}, {"column_name": "broken", "calculation": "nothing + 1"}]


def _preprocess(s, d):
    df, _ = flows.preprocess(holed_orders(s, d), derived=_DERIVED, keys=["o_orderkey"])
    return rounded(df, 4)


QUERIES["preprocess"] = _preprocess
_MODE = """coalesce({c}, (SELECT {c} FROM holed WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"""
SQL["preprocess"] = f"""WITH {HOLED_SQL}, filled AS (SELECT o_orderkey, coalesce(total, (SELECT avg(total) FROM holed)) AS total,
    {_MODE.format(c='at_limit')}, {_MODE.format(c='status')}, strptime("date", '%Y-%m-%d') AS "date", "time", strptime(noted, '%Y-%m-%d') AS noted FROM holed),
  b AS (SELECT quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3 FROM filled)
  SELECT o_orderkey, round(total, 4) AS total, at_limit, status, "date", "time", noted, round(total * 2, 4) AS doubled, """ + ", ".join(
    f"""CAST(year("{c}") AS INTEGER) AS "{c}_年份", CAST(month("{c}") AS INTEGER) AS "{c}_月份", CAST(day("{c}") AS INTEGER) AS "{c}_日",
    CAST(isodow("{c}") - 1 AS INTEGER) AS "{c}_星期", dayname("{c}") AS "{c}_星期名称" """ for c in ("date", "noted")
) + """FROM filled, b WHERE total BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"""

_FAST = replace(SMALL, selection="selectkbest", forest_trees=3, boosting_stages=3, folds=3)


def _features(s, d):
    df = sales(s, d).select(*SALES_KEYS, "quantity", "price", "profit", "discount", "category", "region")
    made = flows.build_features(df, _FAST, target="profit", keys=SALES_KEYS, select=False)
    return rounded(made.table, 6, *made.names, "profit")


QUERIES["build_features"] = _features
_ONE = [("category", v) for v in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")]
_ONE += [("region", v) for v in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]
_Z = "round(({0} - avg({0}) OVER ()) / stddev_pop({0}) OVER (), 6) AS {0}"
SQL["build_features"] = f"WITH {SALES_SQL} SELECT {', '.join(SALES_KEYS)}, {_Z.format('quantity')}, {_Z.format('price')}, {_Z.format('discount')}, " + ", ".join(
    f"""CAST({c} = '{v}' AS DOUBLE) AS "{c}_{v}" """ for c, v in _ONE
) + f", {_Z.format('profit')} FROM sales"


def _analysis(s, d):
    df = materialise(sales(s, d).select(*SALES_KEYS, "quantity", "price", "profit", "discount", "category", "region"), "sales")
    made = flows.build_features(df, _FAST, target="profit", keys=SALES_KEYS)
    results, _ = flows.analyse(df, made, _FAST, model_names=["linear", "ridge"])
    return results["leaderboard"]


QUERIES["analyse"] = _analysis

_SCENARIOS = [{"scenario_type": "pricing", "title": "prices", "parameters": {"price_change_range": [-5, 5]}}]
QUERIES["what_if_stage"] = lambda s, d: rounded(flows.what_if(sales(s, d).select(*SALES_NUMBERS), _SCENARIOS)["scenarios"], 2).select(
    "parameter", "value", "scenario_total"
)
_ALL = " + ".join(f"sum({c})" for c in SALES_NUMBERS)
SQL["what_if_stage"] = f"WITH {SALES_SQL} " + " UNION ALL ".join(
    f"SELECT 'price_change_range' AS parameter, CAST({v} AS DOUBLE) AS value, round({_ALL} + {v} / 100.0 * sum(price), 2) AS scenario_total FROM sales"
    for v in (-5, 5)
)

# The same totals on a table with row keys, which count in none of them.
QUERIES["what_if_stage_keys"] = lambda s, d: rounded(
    flows.what_if(sales(s, d).select(*SALES_KEYS, *SALES_NUMBERS), _SCENARIOS, keys=SALES_KEYS)["scenarios"], 2
).select("parameter", "value", "scenario_total")
SQL["what_if_stage_keys"] = SQL["what_if_stage"]


def _scaled_by_rule(s, d):
    """A number named after a categorical column is not scaled; listed categorical columns are left out."""
    df = sales(s, d).select(*SALES_KEYS, "price", F.col("discount").alias("region_discount"), "region", F.col("product").alias("产品名称"))
    made = flows.build_features(df, keys=SALES_KEYS, select=False)
    return rounded(made.table, 6, *made.names, "price")


QUERIES["scale_by_rule"] = _scaled_by_rule
SQL["scale_by_rule"] = f"WITH {SALES_SQL} SELECT {', '.join(SALES_KEYS)}, round(discount, 6) AS region_discount, {_Z.format('price')}, " + ", ".join(
    f"""CAST({c} = '{v}' AS DOUBLE) AS "{c}_{v}" """ for c, v in _ONE if c == "region"
) + " FROM sales"


def _scaled_on_train(s, d):
    df = sales(s, d).select(*SALES_KEYS, "price", "discount", "profit")
    made = flows.build_features(df, replace(_FAST, target="profit"), keys=SALES_KEYS, fit_on="train", select=False)
    return rounded(made.table, 6, *made.names, "profit")


QUERIES["scale_fit_on_train"] = _scaled_on_train
_TRAIN = "CAST('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, '42')), 1, 8) AS BIGINT) % 1000 >= 200"
_Y = "round(({0} - (SELECT avg({0}) FROM sales WHERE " + _TRAIN + ")) / (SELECT stddev_pop({0}) FROM sales WHERE " + _TRAIN + "), 6) AS {0}"
SQL["scale_fit_on_train"] = f"WITH {SALES_SQL} SELECT {', '.join(SALES_KEYS)}, " + ", ".join(_Y.format(c) for c in ("price", "discount", "profit")) + " FROM sales"


def _half_null(s, d):
    """Features of a table with a derived column that is NULL on half of its rows."""
    df = sales(s, d).select(*SALES_KEYS, "price", "profit", "promotion")
    df = df.withColumn("promoted_price", F.when(F.col("promotion"), F.col("price"))).drop("promotion")
    made = flows.build_features(df, _FAST, target="profit", keys=SALES_KEYS, select=False)
    return rounded(made.table, 6, *made.names, "profit")


QUERIES["build_features_half_null"] = _half_null
SQL["build_features_half_null"] = f"""WITH {SALES_SQL}, h AS (SELECT *, CASE WHEN promotion THEN price END AS promoted_price FROM sales),
  z AS (SELECT {', '.join(SALES_KEYS)}, {_Z.format('price')}, {_Z.format('profit')}, {_Z.format('promoted_price')} FROM h)
  SELECT * REPLACE (coalesce(promoted_price, 0.0) AS promoted_price) FROM z"""


def _everything(s, d):
    # The stages read their input many times, so the join is done once.
    df = materialise(sales(s, d).select(*SALES_KEYS, "quantity", "price", "cost", "discount", "category", "region", "sale_date"), "sales")
    derived = [
        {"column_name": "revenue", "calculation": "price * quantity"},
        {"column_name": "profit", "calculation": "(price - cost) * quantity"},
    ]
    charts = [{"chart_type": "bar", "title": "profit by region", "x_axis": "region", "y_axis": "profit"}]
    results, _ = flows.run_all(
        df, _FAST, derived, charts, scenarios=_SCENARIOS, keys=SALES_KEYS, target="profit", model_names=["linear", "ridge"],
    )
    baseline = results["baseline"].select(F.lit("baseline").alias("part"), F.col("figure").alias("name"), "value")
    scenarios = results["scenarios"].select(F.lit("scenario"), F.concat_ws(" ", "parameter", "value"), "scenario_total")
    bars = results["chart: profit by region"].select(F.lit("chart"), F.col("x"), "value")
    board = results["leaderboard"].select(F.lit("model"), "model", "test_r2")
    return baseline.union(scenarios).union(bars).union(board)


QUERIES["run_all"] = _everything
