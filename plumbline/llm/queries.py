"""The registered queries of the text operators, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm import (
    byte_pairs, centroid_clusters, exact_copies, inner_product, language, licences, near_copies, packing, periodic_runs, pii, sharding, url_lists, word_pairs,
)
from plumbline.sources.tables import load_table

QUERIES, SQL = {}, {}

# The key of the surrogates. A deployment passes its own secret; this one makes results repeatable.
SURROGATE_KEY = b"repeatable surrogates"


def table(spark, folder: str, name: str) -> DataFrame:
    return load_table(spark, f"{folder}/{name}.parquet", normalise_nan=False)


def tokenizers():
    import public_tokenizers

    return public_tokenizers


def _byte_pairs(s, d):
    public = tokenizers()
    docs = table(s, d, "documents").select("doc_id", "text")
    made = byte_pairs.round_trip(docs, public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES["op1_byte_pairs"] = _byte_pairs

QUERIES["op2_exact_copies"] = lambda s, d: exact_copies.exact_copies(table(s, d, "documents"), digest_all=True)
SQL["op2_exact_copies"] = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

QUERIES["op3_near_copies"] = lambda s, d: near_copies.near_copies(table(s, d, "documents"), size=4)

QUERIES["op4_hash_tree_shards"] = lambda s, d: sharding.shard_rows(table(s, d, "documents").select("doc_id", "text"), sharding.even_tree())


def _licences(s, d):
    found = licences.scan_licences(table(s, d, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


QUERIES["op5_licences"] = _licences


def _captures(s, d):
    """Pages with a fetch day, and dated list entries for the hosts that occur among them."""
    pages = table(s, d, "pages").select("page_id", "url")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.withColumn("fetched", F.date_add(start, F.pmod("page_id", F.lit(365)).cast("int")))
    number = lambda name, salt: F.conv(F.substring(F.md5(F.concat(name, F.lit(salt)).cast("binary")), 1, 6), 16, 10).cast("int")
    hosts = pages.select(F.regexp_replace(url_lists.host_of(F.col("url")), r"^(www|m|blog)\.", "").alias("host"), url_lists.first_segment(F.col("url")).alias("path"))
    hosts = hosts.filter("host IS NOT NULL").distinct()
    on = lambda salt, first, days: F.date_add(start, F.pmod(number("host", salt), F.lit(days)) + first)
    entry = lambda rows, pattern, action, dated: rows.select(pattern.alias("pattern"), F.lit(action).alias("action"), dated.alias("dated"))
    kind = F.pmod(number("host", "kind"), F.lit(4))
    names = hosts.select("host").distinct()
    entries = [
        entry(names.filter(kind > 0), F.col("host"), "block", on("a", 0, 90)),
        entry(names.filter(kind > 1), F.col("host"), "withdraw", on("b", 100, 90)),
        entry(names.filter(kind > 2), F.col("host"), "block", on("c", 200, 90)),
        entry(hosts.filter(F.pmod(number(F.concat("host", "path"), "allow"), F.lit(5)) == 0).filter("path <> ''"), F.concat("host", "path"), "allow", on("d", 0, 300)),
    ]
    listed = entries[0]
    for more in entries[1:]:
        listed = listed.unionByName(more)
    return captures, listed


def _url_lists(s, d):
    captures, entries = _captures(s, d)
    return url_lists.judge(captures, entries)


QUERIES["op6_url_lists"] = _url_lists
_N = "CAST('0x' || substr(md5({0} || '{1}'), 1, 6) AS INTEGER)"
_DAY = "DATE '2024-01-01' + CAST({1} + " + _N.format("host", "{0}") + " % {2} AS INTEGER)"
SQL["op6_url_lists"] = f"""WITH p AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS t,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1) AS path FROM pages),
  h AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\\.', '') AS host, path FROM p), n AS (SELECT DISTINCT host FROM h),
  e AS (SELECT host AS pattern, 'block' AS action, {_DAY.format('a', 0, 90)} AS since FROM n WHERE {_N.format('host', 'kind')} % 4 > 0
    UNION SELECT host, 'withdraw', {_DAY.format('b', 100, 90)} FROM n WHERE {_N.format('host', 'kind')} % 4 > 1
    UNION SELECT host, 'block', {_DAY.format('c', 200, 90)} FROM n WHERE {_N.format('host', 'kind')} % 4 > 2
    UNION SELECT host || path, 'allow', {_DAY.format('d', 0, 300)} FROM h WHERE path <> '' AND {_N.format('host || path', 'allow')} % 5 = 0),
  x AS (SELECT p.page_id, e.*, row_number() OVER (PARTITION BY page_id, pattern ORDER BY since DESC) AS last FROM p JOIN e ON e.since <= p.t
    AND (p.host = pattern OR ends_with(p.host, '.' || pattern) OR (p.path <> '' AND (p.host || p.path = pattern OR ends_with(p.host || p.path, '.' || pattern))))),
  y AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(string_split(pattern, '/')[1], '.')) DESC, contains(pattern, '/') DESC) AS r
    FROM x WHERE last = 1 AND action <> 'withdraw')
  SELECT p.page_id, CASE action WHEN 'block' THEN 'blocked' WHEN 'allow' THEN 'allowed' ELSE 'unlisted' END AS verdict, pattern, since
  FROM p LEFT JOIN y ON p.page_id = y.page_id AND r = 1"""


def _inner_products(s, d):
    base = inner_product.scaled(table(s, d, "embeddings"))
    return inner_product.top_inner_products(base, base.filter(F.pmod("_id", F.lit(20)) == 0), 20)


QUERIES["op7_inner_products"] = _inner_products
SQL["op7_inner_products"] = """WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings),
  p AS (SELECT q.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS BIGINT) AS score
        FROM v q JOIN v b ON q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


def _surrogates(s, d):
    made = pii.replace_distinctly(table(s, d, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return made.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds"))


QUERIES["op8_surrogates"] = _surrogates


def _packing(s, d):
    public = tokenizers()
    docs = table(s, d, "documents").select("doc_id", "text")
    special = packing.special_tokens(public.path("byte_bpe_50k.json"))
    return packing.pack(packing.encoded_pieces(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, special=special))


QUERIES["op9_best_fit_packing"] = _packing


def _language(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", "lang")
    learned = language.training_row(F.col("doc_id"))
    model = language.learn(docs.filter(learned))
    return language.identify(docs.select("doc_id", "text", (~learned).alias("held_out")), model, keep_text=False)


QUERIES["op10_language"] = _language


def planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in documents whose hash ends in zero, the words from a place on repeat with a period; both follow from the hash and the number of words."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.floor(hashed / 10).alias("_g"), F.when(hashed % 10 == 0, split).alias("_words"))
    start = F.pmod("_g", F.size("_words"))
    docs = docs.select("doc_id", "text", "_g", "_words", F.when(F.size("_words") > 0, start).alias("_a"))
    period = 1 + F.floor((F.size("_words") - F.col("_a")) / (3 + F.col("_g") % 8))
    docs = docs.select("doc_id", "text", "_words", "_a", period.alias("_p"))
    word = lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return docs.select("doc_id", F.when(F.col("_a").isNotNull(), F.concat_ws(" ", F.transform("_words", word))).otherwise(F.col("text")).alias("text"))


def _runs(s, d):
    found = periodic_runs.periodic_runs(planted_runs(table(s, d, "documents").select("doc_id", "text")))
    # Runs come by start and period, so the first of those that repeat most often is the one that ties go to.
    more = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), more)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select(
        "doc_id", "n_words", "n_runs", *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES["op11_periodic_runs"] = _runs


def _word_pairs(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    made = word_pairs.round_trip(docs, tokenizers().path("word_bpe_49k.json"), packed=True)
    return made.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES["op12_word_pairs"] = _word_pairs


def _clusters(s, d):
    found, centroids = centroid_clusters.cluster(table(s, d, "embeddings").select("vec_id", "embedding"))
    centroids = centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))
    # At most 16 rows, one per centroid.
    total = centroids.agg((F.count("cluster_inertia") == F.count("*")).alias("_all"), F.sum(F.col("cluster_inertia").cast("decimal(38,0)")).alias("_sum"))
    total = total.select(F.when(F.col("_all") & (F.col("_sum") <= 2**63 - 1), F.col("_sum").cast("long")).alias("inertia"))
    return found.join(F.broadcast(centroids.crossJoin(total)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES["op13_centroid_clusters"] = _clusters


def _cluster_sql(k=16, rounds=3):
    apart = "list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v, c)])::BIGINT"
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
  c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(distance := {apart}, cluster := cluster)) AS m
    FROM (SELECT row_number() OVER () AS r, * FROM v) CROSS JOIN c{i} GROUP BY r, vec_id)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT cluster, j, sum(x) AS s, count(*) AS n FROM (SELECT m.cluster AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY cluster, j),
  c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{i} GROUP BY cluster) n USING (cluster))""")
    last = f"""SELECT vec_id, m.cluster AS cluster, m.distance AS distance, CAST(sum(m.distance) OVER (PARTITION BY m.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = m.cluster"""
    return "WITH " + ",\n  ".join(steps) + "\n" + last


SQL["op13_centroid_clusters"] = _cluster_sql()
