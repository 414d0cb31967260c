"""Queries for loading and profiling."""

import uuid

from pyspark.sql import functions as F

from plumbline.operators import profile
from plumbline.plans import roles
from plumbline.session import shared_folder
from plumbline.sources.tables import document_files, document_status, load_documents, load_table, save_results, save_table, unread_documents
from workload.tables import HOLED_SQL, SALES_NUMBERS, SALES_SQL, holed_orders, rounded, sales, table

QUERIES, SQL = {}, {}

QUERIES["load_table"] = lambda s, d: load_table(s, f"{d}/customer.parquet")
SQL["load_table"] = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"

def _folder(s, name):
    return f"{shared_folder(s)}/workload-{name}-{uuid.uuid4().hex}"


def _document_files(s, d):
    """Files of documents, one per task that wrote, read whole again and compared line by line."""
    path = _folder(s, "documents")
    table(s, d, "documents").select("text").filter("text IS NOT NULL").write.text(path)
    lines = load_documents(s, path).select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy(F.md5("line").alias("line")).agg(F.count("*").alias("n"))


QUERIES["load_document_files"] = _document_files
SQL["load_document_files"] = """SELECT md5(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL) GROUP BY 1"""


def _document_metadata(s, d):
    """Documents in files by language, whose category comes from a list of files: lines by category."""
    path = _folder(s, "documents")
    table(s, d, "documents").select("lang", "text").filter("text IS NOT NULL").write.partitionBy("lang").text(path)
    manifest = document_files(s, path).select(F.col("doc_id").alias("file_name"), F.regexp_extract("doc_id", "lang=([^/]+)", 1).alias("category"), F.lit("corpus").alias("api_name"))
    lines = load_documents(s, path, manifest).select("category", "api_name", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return lines.groupBy("category", "api_name").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_letters"), F.count_distinct(F.md5("line")).alias("n_distinct"))


QUERIES["load_documents"] = _document_metadata
SQL["load_documents"] = """SELECT category, 'corpus' AS api_name, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_letters, count(DISTINCT md5(line)) AS n_distinct
  FROM (SELECT lang AS category, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1"""


def _monthly_files(s, d):
    """One file of orders a month; a seventh of the files hold bytes that are no text. Also a list that names each of them and some that do not exist."""
    path = _folder(s, "orders")
    orders = table(s, d, "orders").select(F.date_format("o_orderdate", "yyyyMM").alias("month"), F.col("o_orderkey").cast("string").alias("line"))
    broken = orders.select("month").distinct().filter("CAST(month AS INT) % 7 = 0").select("month", F.expr("CAST(unhex('C328') AS STRING)").alias("line"))
    orders.unionByName(broken).repartition("month").write.partitionBy("month").text(path)
    present = document_files(s, path).select(F.col("doc_id").alias("file_name"), F.regexp_extract("doc_id", "month=([^/]+)", 1).alias("category"))
    ghosts = orders.select("month").distinct().filter("CAST(month AS INT) % 5 = 0").select(F.concat(F.lit("orders "), "month").alias("file_name"), F.col("month").alias("category"))
    named = present.filter("CAST(category AS INT) % 3 > 0").unionByName(ghosts)
    return path, named.withColumn("api_name", F.lit("orders"))


def _statuses(s, d):
    path, named = _monthly_files(s, d)
    lines = F.when(F.col("status") == "read", F.size(F.split("text", "\n")) - 1)
    return document_status(s, path, named).groupBy("status", "reason").agg(F.count("*").alias("n_files"), F.sum(lines).alias("n_lines"), F.count("category").alias("n_labelled"))


_MONTHS = "m AS (SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT n, CAST(month AS INTEGER) AS i FROM m)"
QUERIES["document_status"] = _statuses
SQL["document_status"] = f"""WITH {_MONTHS}
  SELECT 'read' AS status, NULL AS reason, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_lines, count(*) AS n_labelled FROM k WHERE i % 3 > 0 AND i % 7 > 0
  UNION ALL SELECT 'unreadable', 'not UTF-8', count(*), NULL, count(*) FROM k WHERE i % 3 > 0 AND i % 7 = 0
  UNION ALL SELECT 'unnamed', NULL, count(*), NULL, 0 FROM k WHERE i % 3 = 0
  UNION ALL SELECT 'missing', 'no such file, or an empty one', count(*), NULL, count(*) FROM k WHERE i % 5 = 0"""


def _unread_files(s, d):
    path, named = _monthly_files(s, d)
    return unread_documents(s, path, named).groupBy("status").agg(F.count("*").alias("n_unread"))


QUERIES["unread_documents"] = _unread_files
SQL["unread_documents"] = f"""WITH {_MONTHS} SELECT 'missing' AS status, count(*) AS n_unread FROM k WHERE i % 5 = 0
  UNION ALL SELECT 'unreadable', count(*) FROM k WHERE i % 3 > 0 AND i % 7 = 0"""


def _saved(fmt):
    def run(s, d):
        df = table(s, d, "customer")
        return load_table(s, save_table(df, _folder(s, "table"), fmt), fmt, schema=df.schema)

    return run


QUERIES["save_table_csv"] = _saved("csv")
QUERIES["save_table_parquet"] = _saved("parquet")
SQL["save_table_csv"] = SQL["save_table_parquet"] = SQL["load_table"]


def _saved_results(s, d):
    orders = table(s, d, "orders")
    counts = {c: orders.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")) for c in ("o_orderstatus", "o_orderpriority")}
    paths = save_results(counts, _folder(s, "results"))
    kind = "value string, n bigint"
    parts = [load_table(s, path, "csv", kind).select(F.lit(name).alias("part"), "value", "n") for name, path in paths.items()]
    return parts[0].unionByName(parts[1])


QUERIES["save_results"] = _saved_results
SQL["save_results"] = " UNION ALL ".join(
    f"SELECT '{c}' AS part, {c} AS value, count(*) AS n FROM orders GROUP BY 2" for c in ("o_orderstatus", "o_orderpriority")
)


def _default_targets(s, d):
    """The targets that both stages take from the names of the columns."""
    df = sales(s, d).select("l_orderkey", "quantity", "discount", "price", "profit")
    columns = {"feature stage": roles.feature_target(df), "analysis stage": roles.analysis_target(df)}
    mean = df.agg(*[F.avg(c).alias(c) for c in set(columns.values())])
    rows = [F.struct(F.lit(stage).alias("stage"), F.lit(c).alias("target"), F.col(c).alias("mean")) for stage, c in columns.items()]
    return rounded(mean.select(F.inline(F.array(*rows))), 6)


def _column_classes(s, d):
    """Each column with its class and how many rows have a value."""
    df = sales(s, d).drop("promotion")
    classes = {"numeric": roles.numeric_columns(df), "categorical": roles.categorical_columns(df), "datetime": roles.datetime_columns(df)}
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("class"), F.col(c).alias("n")) for kind, cols in classes.items() for c in cols])))


QUERIES["column_classes"] = _column_classes
SQL["column_classes"] = f"WITH {SALES_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS class, count({c}) AS n FROM sales" for kind, cols in {
        "numeric": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "quantity", "cost", "revenue", "profit", "discount"],
        "categorical": ["category", "product", "region"], "datetime": ["sale_date"],
    }.items() for c in cols
)

QUERIES["default_targets"] = _default_targets
SQL["default_targets"] = f"""WITH {SALES_SQL} SELECT 'feature stage' AS stage, 'l_orderkey' AS target, round(avg(l_orderkey), 6) AS mean FROM sales
  UNION ALL SELECT 'analysis stage', 'price', round(avg(price), 6) FROM sales"""

QUERIES["dataset_profile"] = lambda s, d: profile.dataset_profile(holed_orders(s, d)).drop("data_type")
_PROFILE = [
    ("o_orderkey", "numeric", "false", "true"),
    ("total", "numeric", "false", "true"),
    ("sparse", "categorical", "false", "false"),
    ("at_limit", "categorical", "false", "false"),
    ("status", "categorical", "false", "false"),
    ("date", "categorical", "parsed", "false"),
    ("time", "categorical", "parsed", "false"),
    ("noted", "categorical", "false", "false"),
]
SQL["dataset_profile"] = f"WITH {HOLED_SQL} " + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS "class", count(*) AS n_rows,
        count(*) - count("{c}") AS n_null,
        {'count(*) FILTER ("' + c + '" IS NOT NULL AND try_strptime("' + c + '", ' + "'%Y-%m-%d') IS NULL) = 0"
          if dated == "parsed" else dated} AS is_datetime,
        {target if c != "o_orderkey" else "true"} AS is_possible_target FROM holed"""
    for i, (c, kind, dated, target) in enumerate(_PROFILE)
)

QUERIES["null_profile"] = lambda s, d: profile.null_profile(holed_orders(s, d))
SQL["null_profile"] = f"WITH {HOLED_SQL}, counts AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS n_null,
        round(100.0 * (count(*) - count("{c}")) / count(*), 1) AS pct_null FROM holed"""
    for c, *_ in _PROFILE
) + """) SELECT "column", n_null, CAST(pct_null AS DOUBLE) AS pct_null FROM counts WHERE n_null > 0"""


def _categories(k, count_null):
    def run(s, d):
        df = holed_orders(s, d).select("sparse", "at_limit", "status")
        out = profile.category_profile(df, k=k, count_null=count_null)
        return out.withColumn("sample", F.concat_ws("|", F.transform("sample", lambda v: F.coalesce(v, F.lit("NULL")))))

    return run


def _categories_sql(k, count_null):
    keep = "" if count_null else "WHERE v IS NOT NULL"
    one = " UNION ALL ".join(f"""SELECT DISTINCT '{c}' AS "column", "{c}" AS v FROM holed""" for c in ("sparse", "at_limit", "status"))
    return f"""WITH {HOLED_SQL}, vals AS ({one}), kept AS (SELECT * FROM vals {keep}),
      placed AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY v NULLS LAST) AS p,
                 count(*) OVER (PARTITION BY "column") AS n_distinct FROM kept)
      SELECT "column", n_distinct, string_agg(coalesce(v, 'NULL'), '|' ORDER BY p) AS sample, n_distinct > {k} AS truncated
      FROM placed WHERE p <= {k} GROUP BY "column", n_distinct"""


for _k, _nulls in ((5, True), (3, False), (10, True)):
    QUERIES[f"category_profile_{_k}"] = _categories(_k, _nulls)
    SQL[f"category_profile_{_k}"] = _categories_sql(_k, _nulls)


def _describe_sql(source, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count("{c}") AS "count", round(avg("{c}"), 5) AS mean, round(stddev_samp("{c}"), 5) AS std,
        round(min(CAST("{c}" AS DOUBLE)), 5) AS "min", round(quantile_cont(CAST("{c}" AS DOUBLE), 0.25), 5) AS q25,
        round(quantile_cont(CAST("{c}" AS DOUBLE), 0.5), 5) AS q50, round(quantile_cont(CAST("{c}" AS DOUBLE), 0.75), 5) AS q75,
        round(max(CAST("{c}" AS DOUBLE)), 5) AS "max" FROM {source}"""
        for c in columns
    )


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES["describe_lineitem"] = lambda s, d: rounded(profile.describe(table(s, d, "lineitem"), _LINE), 5)
SQL["describe_lineitem"] = _describe_sql("lineitem", _LINE)
QUERIES["describe_sales"] = lambda s, d: rounded(profile.describe(sales(s, d), SALES_NUMBERS), 5)
SQL["describe_sales"] = f"WITH {SALES_SQL} " + _describe_sql("sales", SALES_NUMBERS)

# Narrowing instead of value counting, as a column too wide for one task's memory would be handled.
QUERIES["describe_narrowed"] = lambda s, d: rounded(
    profile.describe(table(s, d, "lineitem"), ["l_extendedprice", "l_quantity"], map_limit=2_000), 5
)
SQL["describe_narrowed"] = _describe_sql("lineitem", ["l_extendedprice", "l_quantity"])


def _describe_turned(s, d):
    return rounded(profile.describe_by_statistic(profile.describe(table(s, d, "events"), ["value", "user_id"])), 5)


QUERIES["describe_by_statistic"] = _describe_turned
SQL["describe_by_statistic"] = " UNION ALL ".join(
    f"""SELECT '{name}' AS statistic, round({call.format("value")}, 5) AS value, round({call.format("CAST(user_id AS DOUBLE)")}, 5) AS user_id FROM events"""
    for name, call in [
        ("count", "CAST(count({}) AS DOUBLE)"), ("mean", "avg({})"), ("std", "stddev_samp({})"), ("min", "min({})"),
        ("q25", "quantile_cont({}, 0.25)"), ("q50", "quantile_cont({}, 0.5)"), ("q75", "quantile_cont({}, 0.75)"), ("max", "max({})"),
    ]
)


def _gapped_sales(s, d):
    gap = F.when(F.col("l_orderkey") % 3 > 0, F.col("discount")).alias("gap")
    return sales(s, d).select("price", "quantity", "profit", gap, F.lit(2024.0).alias("fixed"))


_CORR = ["price", "quantity", "profit", "gap", "fixed"]
_CORR_SQL = f"""WITH {SALES_SQL}, gapped AS (SELECT price, quantity, profit,
    CASE WHEN l_orderkey % 3 > 0 THEN discount END AS gap, CAST(2024.0 AS DOUBLE) AS fixed FROM sales), m AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {'NULL' if 'fixed' in (a, b) else '1.0'} AS r"
    if "fixed" in (a, b) or a == b
    else f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM gapped"
    for a in _CORR for b in _CORR
) + ")"
QUERIES["correlations"] = lambda s, d: rounded(profile.correlations(_gapped_sales(s, d)), 6)
SQL["correlations"] = f"{_CORR_SQL} SELECT a, b, CAST(r AS DOUBLE) AS r FROM m"
# Forty columns, each with gaps of its own: 780 pairs.
_WIDE = [(f"x{i}", f"{'price quantity cost revenue profit'.split()[i % 5]} * {i % 7 + 1} + {'discount quantity price'.split()[i % 3]} * {i * i % 11}", i % 4 + 2, i) for i in range(40)]


def _wide_sales(s, d):
    columns = [F.expr(f"CASE WHEN (l_orderkey + l_linenumber * {i}) % {gap} > 0 THEN {value} END").alias(c) for c, value, gap, i in _WIDE]
    return sales(s, d).select(*columns)


QUERIES["correlations_wide"] = lambda s, d: rounded(profile.correlations(_wide_sales(s, d)), 6)
SQL["correlations_wide"] = f"""WITH {SALES_SQL}, w AS (SELECT {", ".join(f"CASE WHEN (l_orderkey + l_linenumber * {i}) % {gap} > 0 THEN {value} END AS {c}" for c, value, gap, i in _WIDE)} FROM sales),
  m AS (SELECT {", ".join(f"corr({a[0]}, {b[0]}) AS {a[0]}_{b[0]}" for k, a in enumerate(_WIDE) for b in _WIDE[k + 1:])} FROM w),
  u AS (UNPIVOT m ON * INTO NAME pair VALUE r), p AS (SELECT split_part(pair, '_', 1) AS a, split_part(pair, '_', 2) AS b, round(r, 6) AS r FROM u)
  SELECT a, b, r FROM p UNION ALL SELECT b, a, r FROM p UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest({[c for c, *_ in _WIDE]}) AS c)"""

QUERIES["target_correlations"] = lambda s, d: rounded(
    profile.target_correlations(profile.correlations(_gapped_sales(s, d)), "profit"), 6
)
SQL["target_correlations"] = f"""{_CORR_SQL} SELECT b AS "column", CAST(r AS DOUBLE) AS r FROM m WHERE a = 'profit'"""
