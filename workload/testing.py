"""Queries for hypothesis tests."""

from pyspark.sql import functions as F

from plumbline.operators import inference
from plumbline.plans.roles import default_tests
from workload.tables import SALES_SQL, rounded, sales, table

QUERIES, SQL = {}, {}

_SIDES = """sides AS (SELECT promotion AS g, count(*) AS n, avg(quantity) AS m, var_samp(quantity) AS v FROM sales GROUP BY 1),
  two AS (SELECT a.n AS na, a.m AS ma, a.v AS va, b.n AS nb, b.m AS mb, b.v AS vb FROM sides a, sides b WHERE NOT a.g AND b.g)"""
QUERIES["t_test_pooled"] = lambda s, d: rounded(inference.t_statistics(sales(s, d), "promotion", "quantity", pooled=True), 6)
SQL["t_test_pooled"] = f"""WITH {SALES_SQL}, {_SIDES} SELECT
  round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 6) AS statistic,
  CAST(na + nb - 2 AS DOUBLE) AS df FROM two"""
QUERIES["t_test_welch"] = lambda s, d: rounded(inference.t_statistics(sales(s, d), "promotion", "quantity"), 5)
SQL["t_test_welch"] = f"""WITH {SALES_SQL}, {_SIDES} SELECT round((ma - mb) / sqrt(va / na + vb / nb), 5) AS statistic,
  round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 5) AS df FROM two"""


def _anova_sql(group, value):
    return f"""SELECT round((sum(n * (m - a) * (m - a)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 5) AS statistic,
      CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2 FROM
      (SELECT count(*) AS n, avg({value}) AS m, var_pop({value}) * count(*) AS w, any_value(a) AS a
       FROM sales, (SELECT avg({value}) AS a FROM sales) t GROUP BY {group})"""


QUERIES["anova"] = lambda s, d: rounded(inference.anova_statistics(sales(s, d), "category", "profit"), 5)
SQL["anova"] = f"WITH {SALES_SQL} {_anova_sql('category', 'profit')}"

QUERIES["pearson_test"] = lambda s, d: rounded(inference.pearson_statistics(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"), 6)
SQL["pearson_test"] = """SELECT round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS statistic, CAST(n - 2 AS DOUBLE) AS df
  FROM (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem)"""


def _chi_sql(b):
    return f"""cells AS (SELECT promotion AS a, {b} AS b, count(*) AS o FROM sales GROUP BY 1, 2),
      filled AS (SELECT ra.a, cb.b, coalesce(o, 0) AS o, ra.t * cb.t / (SELECT sum(o) FROM cells) AS e
        FROM (SELECT a, CAST(sum(o) AS DOUBLE) AS t FROM cells GROUP BY 1) ra CROSS JOIN (SELECT b, CAST(sum(o) AS DOUBLE) AS t FROM cells GROUP BY 1) cb
        LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b)"""


QUERIES["chi_square"] = lambda s, d: rounded(inference.chi2_statistics(sales(s, d), "promotion", "category"), 5)
SQL["chi_square"] = f"""WITH {SALES_SQL}, {_chi_sql('category')}
  SELECT round(sum((o - e) * (o - e) / e), 5) AS statistic,
  CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS DOUBLE) AS df FROM filled"""
QUERIES["chi_square_2x2"] = lambda s, d: rounded(
    inference.chi2_statistics(sales(s, d).withColumn("bulk", F.col("quantity") > 25), "promotion", "bulk"), 5
)
SQL["chi_square_2x2"] = f"""WITH {SALES_SQL}, {_chi_sql('quantity > 25')}
  SELECT round(sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e), 5) AS statistic, CAST(1 AS DOUBLE) AS df FROM filled"""


def _decisions(s, d):
    df = sales(s, d).withColumnRenamed("quantity", "sales")
    specs = [*default_tests(df, "profit"), {"test_name": "price_profit", "kind": "pearson", "columns": ["price", "profit"]}]
    return rounded(inference.run_tests(df, specs).select("test_name", "test_type", "statistic", "df1", "reject"), 4)


QUERIES["test_decisions"] = _decisions
# 5 % critical values of the chi-square limit: t 1.96; F with 5 and 4 numerator degrees 2.2141 and 2.3719.
SQL["test_decisions"] = f"""WITH {SALES_SQL}, {_SIDES},
  pooled AS (SELECT (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) AS t, na + nb - 2 AS df FROM two),
  cat AS ({_anova_sql('category', 'profit')}), reg AS ({_anova_sql('region', 'profit')})
  SELECT 'promotion_impact' AS test_name, 't_pooled' AS test_type, round(t, 4) AS statistic, CAST(df AS DOUBLE) AS df1, abs(t) > 1.96 AS reject FROM pooled
  UNION ALL SELECT 'category_impact', 'anova', round(statistic, 4), df1, statistic > 2.2141 FROM cat
  UNION ALL SELECT 'region_impact', 'anova', round(statistic, 4), df1, statistic > 2.3719 FROM reg
  UNION ALL SELECT 'price_profit', 'pearson', round(corr(price, profit), 4), CAST(count(*) - 2 AS DOUBLE),
    abs(corr(price, profit)) * sqrt((count(*) - 2) / (1 - pow(corr(price, profit), 2))) > 1.96 FROM sales"""
