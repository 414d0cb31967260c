"""Queries for chunking, vector search and result formatting."""

from pyspark.sql import functions as F

from plumbline import fixed_values as fixed
from plumbline.operators import neighbours, retrieval
from workload.tables import rounded, table

QUERIES, SQL = {}, {}

QUERIES["chunk_windows"] = lambda s, d: retrieval.chunk_windows(table(s, d, "documents"))
SQL["chunk_windows"] = """SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substring(text, CAST(i * 225 + 1 AS BIGINT), 250) AS chunk
  FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 26) // 225 + 1)) AS i FROM documents WHERE length(text) > 0)"""

QUERIES["chunk_recursive"] = lambda s, d: retrieval.chunk_recursive(table(s, d, "documents"))


def _centroids(s, d):
    """One query vector per label: the mean of its vectors."""
    long = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("label", F.col("v.x").alias("embedding"))


_SEARCH = """WITH l AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
  c AS (SELECT label, i, avg(x) AS x FROM l GROUP BY 1, 2), q AS (SELECT label, list(x ORDER BY i) AS e FROM c GROUP BY 1),
  p AS (SELECT q.label AS query_id, vec_id AS id, list_distance(e, CAST(embedding AS DOUBLE[])) AS dist FROM q CROSS JOIN embeddings),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM p)"""


def _search(s, d):
    return neighbours.search(table(s, d, "embeddings"), _centroids(s, d), 200, "vec_id", "label")


QUERIES["vector_search"] = lambda s, d: rounded(_search(s, d), 6)
SQL["vector_search"] = f"{_SEARCH} SELECT query_id, id, round(dist, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 200"

# The way of more queries than can be sent to every task.
QUERIES["vector_search_many"] = lambda s, d: rounded(
    neighbours.knn_join(table(s, d, "embeddings"), table(s, d, "embeddings"), 3, "vec_id", "vec_id", block_rows=100), 6
)
SQL["vector_search_many"] = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_distance(a.v, b.v) AS dist FROM e a CROSS JOIN e b),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM p)
  SELECT query_id, id, round(dist, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


def _formatted(s, d):
    hits = table(s, d, "documents").select("doc_id", "text", F.nullif("lang", F.lit("en")).alias("category"), F.col("source").alias("api_name"))
    return retrieval.format_results(hits, "text", keep=["doc_id"])


QUERIES["format_results"] = _formatted
SQL["format_results"] = """SELECT doc_id, '- API: ' || coalesce(source, '未知') || ' (分类: ' || coalesce(nullif(lang, 'en'), '未知') || ')' || chr(10) ||
  '  描述: ' || text AS formatted FROM documents"""


def _deep_search(s, d):
    """More hits than Spark trims by itself, asked by every hundredth vector, a third of which are missing."""
    vectors = table(s, d, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").withColumn("embedding", F.expr("CASE WHEN vec_id % 300 <> 200 THEN embedding END"))
    return rounded(neighbours.search(vectors, asked, 1500, "vec_id", "vec_id"), 6)


QUERIES["vector_search_deep"] = _deep_search
SQL["vector_search_deep"] = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id % 300 <> 200),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM p)
  SELECT query_id, id, round(dist, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 1500"""


def _retrieved(s, d):
    """All chunks of the documents, each under its document's vector, asked by the mean vector of each label; chunks of one document tie in their order."""
    docs = table(s, d, "documents").select("doc_id", "text", F.col("lang").alias("category"), F.col("source").alias("api_name"))
    chunks = retrieval.chunk_windows(docs, keep=["doc_id", "category", "api_name"])
    chunks = chunks.withColumn("chunk_id", F.shiftleft(F.col("doc_id").cast("long"), 20) + F.col("chunk_no"))
    vectors = table(s, d, "embeddings").select("vec_id", "embedding")
    return retrieval.retrieve(chunks.join(vectors, F.col("vec_id") == F.col("doc_id")), _centroids(s, d), 20, "chunk_id", "label")


QUERIES["retrieve"] = _retrieved
SQL["retrieve"] = f"""{_SEARCH.split("p AS (SELECT")[0].rstrip().rstrip(",")},
  chunks AS ({SQL["chunk_windows"]}),
  p AS (SELECT q.label AS query_id, doc_id, chunk_no, chunk, list_distance(e, CAST(embedding AS DOUBLE[])) AS dist FROM q CROSS JOIN embeddings JOIN chunks ON vec_id = doc_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id, chunk_no) AS rank FROM p)
  SELECT query_id, CAST(rank AS INTEGER) AS rank, '- API: ' || coalesce(source, '未知') || ' (分类: ' || coalesce(lang, '未知') || ')' || chr(10) ||
  '  描述: ' || chunk AS formatted FROM r JOIN documents USING (doc_id) WHERE rank <= 20"""


def _chunk_facts(s, d):
    """Per document, of its chunks in order: how many do not stand where they say, are too long, reach too far back into the one before,
    or leave letters out between two; and the letters before the first and after the last."""
    docs = table(s, d, "documents").select("doc_id", "text")
    size, overlap = fixed.CHUNK_SIZE, fixed.CHUNK_OVERLAP
    chunks = retrieval.chunk_recursive(docs).withColumn("stop", F.col("start") + F.length("chunk"))
    listed = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "start", "stop", "chunk"))).alias("c"))  # one document's chunks
    between = lambda a, b: F.expr("text").substr((a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    solid = lambda text: F.length(F.regexp_replace(text, r"\s+", ""))
    steps = F.transform(F.sequence(F.lit(2), F.size("c")), lambda i: F.struct(F.element_at("c", i - 1).alias("a"), F.element_at("c", i).alias("b")))
    steps = F.when(F.size("c") > 1, steps).otherwise(F.array().cast("array<struct<a: struct<chunk_no: int, start: bigint, stop: bigint, chunk: string>, b: struct<chunk_no: int, start: bigint, stop: bigint, chunk: string>>>"))
    count = lambda values, test: F.size(F.filter(values, test)).cast("bigint")
    return listed.join(docs, "doc_id").select(
        "doc_id", count(F.col("c"), lambda x: between(x["start"], x["stop"]) != x["chunk"]).alias("n_foreign"),
        count(F.col("c"), lambda x: F.length(x["chunk"]) > size).alias("n_long"),
        count(steps, lambda x: (x["a"]["stop"] - x["b"]["start"] > overlap) | (x["b"]["start"] <= x["a"]["start"])).alias("n_far_back"),
        F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, x: n + solid(between(x["a"]["stop"], x["b"]["start"]))).alias("n_lost"),
        (solid(between(F.lit(0), F.element_at("c", 1)["start"])) + solid(between(F.element_at("c", -1)["stop"], F.length("text")))).cast("bigint").alias("n_outside"),
        (F.size("c") > 1).alias("cut"),
    )


QUERIES["chunk_recursive_facts"] = _chunk_facts
SQL["chunk_recursive_facts"] = r"""SELECT doc_id, CAST(0 AS BIGINT) AS n_foreign, CAST(0 AS BIGINT) AS n_long, CAST(0 AS BIGINT) AS n_far_back, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_outside,
  length(text) > 250 AS cut FROM documents WHERE regexp_matches(text, '\S')"""
