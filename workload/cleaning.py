"""Queries for cleaning."""

from pyspark.sql import functions as F

from plumbline.operators import clean
from workload.tables import HOLED_SQL, holed_orders, rounded, table

QUERIES, SQL = {}, {}

QUERIES["drop_sparse_columns"] = lambda s, d: clean.drop_sparse_columns(holed_orders(s, d))
SQL["drop_sparse_columns"] = f"""WITH {HOLED_SQL} SELECT o_orderkey, total, at_limit, status, "date", "time", noted FROM holed"""

QUERIES["fill_means"] = lambda s, d: rounded(clean.fill_means(holed_orders(s, d).select("o_orderkey", "total")), 5)
SQL["fill_means"] = f"""WITH {HOLED_SQL}
  SELECT o_orderkey, round(coalesce(total, (SELECT avg(total) FROM holed)), 5) AS total FROM holed"""

_MODE = """coalesce({c}, (SELECT {c} FROM holed WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}"""
QUERIES["fill_modes"] = lambda s, d: clean.fill_modes(holed_orders(s, d).select("o_orderkey", "at_limit", "status", "noted"))
SQL["fill_modes"] = f"WITH {HOLED_SQL} SELECT o_orderkey, {_MODE.format(c='at_limit')}, {_MODE.format(c='status')}, noted FROM holed"

QUERIES["handle_missing"] = lambda s, d: rounded(clean.handle_missing(holed_orders(s, d)), 5)
SQL["handle_missing"] = f"""WITH {HOLED_SQL}
  SELECT o_orderkey, round(coalesce(total, (SELECT avg(total) FROM holed)), 5) AS total,
         {_MODE.format(c='at_limit')}, {_MODE.format(c='status')}, "date", "time", noted FROM holed"""


def _iqr(source, c):
    return f"""SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM
      (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source})"""


def _z(source, c, t):
    return f"""SELECT m - {t} * s AS low, m + {t} * s AS high FROM
      (SELECT avg(CAST({c} AS DOUBLE)) AS m, stddev_samp(CAST({c} AS DOUBLE)) AS s FROM {source})"""


def _detect_sql(source, columns, bounds):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < low OR {c} > high) AS n_outliers,
        round(100.0 * count(*) FILTER ({c} < low OR {c} > high) / count(*), 5) AS pct_outliers,
        round(any_value(low), 5) AS low, round(any_value(high), 5) AS high FROM {source}, ({bounds(source, c)}) b"""
        for c in columns
    )


_EVENT = ["value", "user_id"]
QUERIES["detect_outliers_iqr"] = lambda s, d: rounded(
    clean.detect_outliers(table(s, d, "events"), cols=_EVENT).unionByName(clean.detect_outliers(table(s, d, "documents"), cols=["n_chars"])), 5
)
SQL["detect_outliers_iqr"] = _detect_sql("events", _EVENT, _iqr) + " UNION ALL " + _detect_sql("documents", ["n_chars"], _iqr)

QUERIES["detect_outliers_zscore"] = lambda s, d: rounded(clean.detect_outliers(table(s, d, "events"), "zscore", 2.0, _EVENT), 5)
SQL["detect_outliers_zscore"] = _detect_sql("events", _EVENT, lambda t, c: _z(t, c, 2.0))

QUERIES["outlier_values"] = lambda s, d: clean.outlier_values(table(s, d, "events"), cols=_EVENT)
SQL["outlier_values"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value FROM events, ({_iqr('events', c)}) b WHERE {c} < low OR {c} > high"""
    for c in _EVENT
)


def _pairs(s, d):
    """Two related measures with outliers, so that the order of removal matters."""
    return table(s, d, "events").select("event_id", "value", (F.col("value") * F.col("value") / 10 + F.col("user_id")).alias("mixed"))


_PAIRS_SQL = "pairs AS (SELECT event_id, value, value * value / 10 + user_id AS mixed FROM events)"


def _remove_sql(bounds):
    return f"""WITH {_PAIRS_SQL}, b1 AS ({bounds('pairs', 'value')}),
      first AS (SELECT pairs.* FROM pairs, b1 WHERE value BETWEEN low AND high), b2 AS ({bounds('first', 'mixed')})
      SELECT event_id, value, round(mixed, 6) AS mixed FROM first, b2 WHERE mixed BETWEEN low AND high"""


_MEASURES = ["value", "mixed"]
QUERIES["remove_outliers_iqr"] = lambda s, d: rounded(clean.remove_outliers(_pairs(s, d), cols=_MEASURES), 6)
SQL["remove_outliers_iqr"] = _remove_sql(_iqr)
QUERIES["remove_outliers_zscore"] = lambda s, d: rounded(clean.remove_outliers(_pairs(s, d), "zscore", 2.0, _MEASURES), 6)
SQL["remove_outliers_zscore"] = _remove_sql(lambda t, c: _z(t, c, 2.0))
QUERIES["remove_outliers_snapshot"] = lambda s, d: rounded(clean.remove_outliers(_pairs(s, d), cols=_MEASURES, snapshot=True), 6)
SQL["remove_outliers_snapshot"] = f"""WITH {_PAIRS_SQL}, b1 AS ({_iqr('pairs', 'value')}), b2 AS ({_iqr('pairs', 'mixed')})
  SELECT event_id, value, round(mixed, 6) AS mixed FROM pairs, b1, b2
  WHERE value BETWEEN b1.low AND b1.high AND mixed BETWEEN b2.low AND b2.high"""

_DATES = ["o_orderkey", "date", "time", "noted"]
QUERIES["coerce_datetimes_by_name"] = lambda s, d: clean.coerce_datetimes(holed_orders(s, d).select(*_DATES), by_content=False)
SQL["coerce_datetimes_by_name"] = f"""WITH {HOLED_SQL} SELECT o_orderkey, strptime("date", '%Y-%m-%d') AS "date", "time", noted FROM holed"""
QUERIES["coerce_datetimes_by_content"] = lambda s, d: clean.coerce_datetimes(holed_orders(s, d).select(*_DATES))
SQL["coerce_datetimes_by_content"] = f"""WITH {HOLED_SQL}
  SELECT o_orderkey, strptime("date", '%Y-%m-%d') AS "date", "time", strptime(noted, '%Y-%m-%d') AS noted FROM holed"""

_TEXT = ["p_name", "p_brand", "p_type"]
QUERIES["nominal_report"] = lambda s, d: rounded(clean.nominal_report(table(s, d, "part"), cols=_TEXT), 6)
SQL["nominal_report"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS INTEGER) AS n_distinct,
    round(count(DISTINCT {c}) / count(*), 6) AS ratio, count(DISTINCT {c}) < 50 AND count(DISTINCT {c}) / count(*) < 0.1 AS is_categorical FROM part"""
    for c in _TEXT
)
