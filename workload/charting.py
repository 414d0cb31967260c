"""Queries for the data behind charts."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import charts
from workload.tables import SALES_KEYS, SALES_SQL, rounded, sales, table

QUERIES, SQL = {}, {}


def _histogram_sql(source, c):
    return f"""b AS (SELECT min({c}) AS lo, (max({c}) - min({c})) / 20 AS w FROM {source}),
      e AS (SELECT i, lo + i * w AS a, lo + (i + 1) * w AS z FROM b, range(20) t(i))
      SELECT CAST(i AS INTEGER) AS bin, round(a, 6) AS low, round(z, 6) AS high,
      count({c}) AS n FROM e LEFT JOIN {source} ON {c} >= a AND ({c} < z OR i = 19) GROUP BY ALL"""


QUERIES["histogram"] = lambda s, d: rounded(charts.histogram(sales(s, d), "revenue"), 6)
SQL["histogram"] = f"WITH {SALES_SQL}, {_histogram_sql('sales', 'revenue')}"
QUERIES["histogram_skewed"] = lambda s, d: rounded(charts.histogram(table(s, d, "documents"), "n_chars"), 6)
SQL["histogram_skewed"] = f"WITH {_histogram_sql('documents', 'n_chars')}"

QUERIES["density"] = lambda s, d: rounded(charts.density(table(s, d, "events"), "value"), 8)
SQL["density"] = """WITH m AS (SELECT count(*) AS n, min(value) AS lo, (max(value) - min(value)) / 199 AS w,
    stddev_samp(value) * pow(count(*), -0.2) AS h FROM events),
  c AS (SELECT value AS v, count(*) AS k FROM events GROUP BY 1)
  SELECT CAST(i AS INTEGER) AS point, round(lo + i * w, 8) AS x,
  round(sum(k * exp(-0.5 * pow((lo + i * w - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 8) AS density
  FROM m, range(200) t(i), c GROUP BY ALL"""

QUERIES["scatter_points"] = lambda s, d: rounded(charts.scatter_points(sales(s, d), "quantity", "profit"), 4)
SQL["scatter_points"] = f"WITH {SALES_SQL} SELECT quantity AS x, round(profit, 4) AS y FROM sales"
QUERIES["scatter_grid"] = lambda s, d: charts.scatter_grid(table(s, d, "events"), "user_id", "value", 10)
SQL["scatter_grid"] = """WITH m AS (SELECT min(user_id) AS ux, (max(user_id) - min(user_id)) / 10 AS uw, min(value) AS vx, (max(value) - min(value)) / 10 AS vw FROM events)
  SELECT CAST(least(floor((user_id - ux) / uw), 9) AS INTEGER) AS x_bin, CAST(least(floor((value - vx) / vw), 9) AS INTEGER) AS y_bin, count(*) AS n
  FROM events, m GROUP BY 1, 2"""

_BOX = """q AS (SELECT event_type AS x, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
    quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
  f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM q)"""
_BOX_SQL = f"""WITH {_BOX} SELECT x, n, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
  round(min(value) FILTER (value BETWEEN lf AND hf), 6) AS low_whisker, round(max(value) FILTER (value BETWEEN lf AND hf), 6) AS high_whisker,
  count(*) FILTER (value < lf OR value > hf) AS n_outliers FROM f JOIN events ON event_type = x GROUP BY ALL"""
QUERIES["box_stats"] = lambda s, d: rounded(charts.box_stats(table(s, d, "events"), "event_type", "value"), 6)
SQL["box_stats"] = _BOX_SQL
# The way of groups too large for one task.
QUERIES["box_stats_narrowed"] = lambda s, d: rounded(charts.box_stats(table(s, d, "events"), "event_type", "value", map_limit=100), 6)
SQL["box_stats_narrowed"] = _BOX_SQL
QUERIES["box_outliers"] = lambda s, d: charts.box_outliers(table(s, d, "events"), "event_type", "value")
SQL["box_outliers"] = f"WITH {_BOX} SELECT x, value AS y FROM f JOIN events ON event_type = x WHERE value < lf OR value > hf"


def _bars_sql(x, y, form, reach):
    return f"""WITH {SALES_SQL} SELECT {x} AS x, count(*) AS n, round({form}, 4) AS value,
      round({form} - 1.959963984540054 * {reach}, 4) AS low, round({form} + 1.959963984540054 * {reach}, 4) AS high FROM sales GROUP BY 1"""


QUERIES["bars_mean"] = lambda s, d: rounded(charts.bars(sales(s, d), "category", "profit"), 4)
SQL["bars_mean"] = _bars_sql("category", "profit", "avg(profit)", "stddev_samp(profit) / sqrt(count(*))")
QUERIES["bars_sum"] = lambda s, d: rounded(charts.bars(sales(s, d), "region", "quantity", "sum"), 4)
SQL["bars_sum"] = _bars_sql("region", "quantity", "sum(quantity)", "stddev_samp(quantity) * sqrt(count(*))")
QUERIES["lines"] = lambda s, d: rounded(charts.lines(sales(s, d), "sale_date", "profit"), 4)
SQL["lines"] = _bars_sql("sale_date", "profit", "avg(profit)", "stddev_samp(profit) / sqrt(count(*))")

_WEIGHT = " + ".join(f"CAST(u >= {bound!r} AS INTEGER)" for bound in charts.poisson_bounds())


def _bootstrap_sql(x, y, value="mean"):
    """The same blocks and weights, from the same hashes."""
    hashed = lambda text: f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"
    drawn, form = ("sum(w * s) / nullif(sum(w * c), 0)", "sum(s) / sum(c)") if value == "mean" else ("sum(w * s)", "sum(s)")
    return f"""WITH {SALES_SQL}, b AS (SELECT {x} AS x, {hashed("concat_ws('|', " + ", ".join(SALES_KEYS) + ", '42')")} % 1024 AS block, count(*) AS c, sum({y}) AS s FROM sales GROUP BY ALL),
  w AS (SELECT block, draw, {_WEIGHT} AS w FROM (SELECT block, draw, {hashed("block || '|' || draw || '|42'")} / 4294967296.0 AS u
    FROM (SELECT unnest(range(1024)) AS block), (SELECT unnest(range(1000)) AS draw))),
  m AS (SELECT x, draw, {drawn} AS m FROM b JOIN w USING (block) GROUP BY x, draw),
  q AS (SELECT x, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY x)
  SELECT x, CAST(sum(c) AS BIGINT) AS n, round({form} + 1e-7, 4) AS {value}, round(any_value(low) + 1e-7, 4) AS low, round(any_value(high) + 1e-7, 4) AS high FROM b JOIN q USING (x) GROUP BY x"""


def _bootstrapped(x, y, estimator="mean"):
    """Off the halves, which means of few amounts often are and which rounding sends either way."""
    return lambda s, d: rounded(charts.bootstrap_intervals(sales(s, d), x, y, SALES_KEYS, estimator=estimator).withColumns({c: F.col(c) + 1e-7 for c in (estimator, "low", "high")}), 4)


QUERIES["bootstrap_intervals"] = _bootstrapped("category", "profit")
SQL["bootstrap_intervals"] = _bootstrap_sql("category", "profit")
QUERIES["bootstrap_sums"] = _bootstrapped("region", "quantity", "sum")
SQL["bootstrap_sums"] = _bootstrap_sql("region", "quantity", "sum")
QUERIES["bootstrap_lines"] = _bootstrapped("sale_date", "profit")
SQL["bootstrap_lines"] = _bootstrap_sql("sale_date", "profit")

_SPECS = [
    {"chart_type": "histogram", "title": "quantities", "x_axis": "quantity", "y_axis": "frequency"},
    {"chart_type": "bar", "title": "profit by region", "x_axis": "region", "y_axis": "profit"},
    {"chart_type": "bar", "title": "twice", "x_axis": "region", "y_axis": "profit"},
    {"chart_type": "line", "title": "missing", "x_axis": "nothing", "y_axis": "profit"},
    {"chart_type": "bar", "title": "bands", "x_axis": "category", "y_axis": "profit", "interval": "bootstrap"},
]


def _specs(s, d):
    drawn, _ = charts.chart_data(sales(s, d), _SPECS)
    parts = [
        df.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_marks")).select(F.lit(spec["title"]).alias("title"), "n_rows", "n_marks")
        for spec, df in drawn
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES["chart_specs"] = _specs
SQL["chart_specs"] = f"""WITH {SALES_SQL} SELECT 'quantities' AS title, count(*) AS n_rows, CAST(20 AS BIGINT) AS n_marks FROM sales
  UNION ALL SELECT 'profit by region', count(*), count(DISTINCT region) FROM sales
  UNION ALL SELECT 'bands', count(*), count(DISTINCT category) FROM sales"""
