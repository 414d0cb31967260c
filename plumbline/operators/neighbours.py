"""Exact nearest neighbours under Euclidean distance, for a few query vectors and for many."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.functions.memory import give_back
from plumbline.functions.ranks import first_rows
from plumbline.operators import pivots
from plumbline.plans.roles import quoted

# Query vectors sent to every task: bounded in number and bytes.
QUERY_ROWS = 10_000
QUERY_BYTES = 64 << 20
# Rows of one side that meet in one task of the join.
BLOCK_ROWS = 20_000
# Leaves that a table of any size is parted into at least; beyond that, leaves grow up to BLOCK_ROWS before there are more of them.
MOST_LEAVES = 16
# Hits (queries times k) that a task keeps at most.
KEPT_HITS = 1_000_000
_CHUNK_CELLS = 1_000_000
# Candidates whose distances are taken at a time.
_CHUNK_PAIRS = 10_000


def closest(queries: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, base position, distance) of each query's k nearest rows, ties to the smaller id.

    A matrix product finds candidates; their distances are then taken directly, so results do not
    depend on how rows were batched. The k-th of a part of the rows bounds what the others are worth.
    """
    if not len(base) or not len(queries):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    norms = np.einsum("ij,ij->i", base, base)
    order = np.argsort(ids, kind="stable")
    places = np.empty(len(ids), int)
    places[order] = np.arange(len(ids))  # compared in place of the ids, which may be texts
    turned = np.multiply(base.T, -2.0, order="C")
    part_of = len(base) if len(base) <= 16 * k else max(16 * k, 1_000)
    out_q, out_b, out_d = [], [], []
    step = max(1, min(_CHUNK_CELLS // len(base), _CHUNK_CELLS // (16 * k)))
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        rough = part @ turned
        rough += norms
        slack = 1e-9 * (1.0 + np.einsum("ij,ij->i", part, part) + norms.max())
        if len(base) > k:
            kth = np.partition(rough[:, :part_of], k - 1, axis=1)[:, k - 1]
        else:
            kth = np.full(len(part), np.inf)
        row, near = np.nonzero(rough <= (kth + slack)[:, None])
        del rough
        exact = np.concatenate([
            np.sqrt(((base[near[i : i + _CHUNK_PAIRS]] - part[row[i : i + _CHUNK_PAIRS]]) ** 2).sum(axis=1)) for i in range(0, len(near), _CHUNK_PAIRS)
        ])
        best = np.lexsort((places[near], exact, row))
        first = np.searchsorted(row, np.arange(len(part)))  # a query's candidates stay together
        best = best[np.arange(len(best)) - first[row[best]] < k]
        out_q.append(start + row[best])
        out_b.append(near[best])
        out_d.append(exact[best])
    return np.concatenate(out_q), np.concatenate(out_b), np.concatenate(out_d)


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k smallest distances per query."""
    return first_rows(rows, ["query_id"], ["distance", "id"], k, "rank")


def search(corpus: DataFrame, queries: DataFrame, k: int, corpus_id: str, query_id: str, vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k rows of ``corpus`` nearest to each query, ascending, exact.

    ``queries`` within QUERY_ROWS and QUERY_BYTES go to every task, which scans its part of the corpus
    once and keeps k rows per query. Queries that would have it keep more than KEPT_HITS rows are parted, and every part scans the corpus.
    More queries take the blocked join.
    """
    table = queries.select(F.col(quoted(query_id)).alias("q"), F.col(quoted(vector)).alias("v")).dropna().limit(QUERY_ROWS + 1).toPandas()
    size = sum(len(v) * 8 for v in table["v"])
    if len(table) > QUERY_ROWS or size > QUERY_BYTES:
        return knn_join(corpus, queries, k, corpus_id, query_id, vector)
    kind = {f.name: f.dataType.simpleString() for f in corpus.schema}[corpus_id]
    query_kind = {f.name: f.dataType.simpleString() for f in queries.schema}[query_id]
    schema = f"query_id {query_kind}, id {kind}, distance double"
    if not len(table):
        return corpus.sparkSession.createDataFrame([], schema + ", rank int")
    rows = corpus.select(F.col(quoted(corpus_id)).alias("id"), F.col(quoted(vector)).alias("v")).dropna()
    step = max(1, KEPT_HITS // k)
    parts = [_scanned(rows, pivots.matrix(table["v"][i : i + step]), table["q"].to_numpy()[i : i + step], k, schema) for i in range(0, len(table), step)]
    return _top(reduce(DataFrame.unionByName, parts), k)


def _scanned(rows: DataFrame, wanted: np.ndarray, names: np.ndarray, k: int, schema: str) -> DataFrame:
    """(query_id, id, distance): the k nearest of each task's ``rows`` to every vector of ``wanted``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, ids, d = np.empty(0, int), None, np.empty(0)
        for batch in batches:
            found, b, apart = closest(wanted, pivots.matrix(batch["v"]), batch["id"].to_numpy(), k)
            if ids is None:
                q, ids, d = found, batch["id"].to_numpy()[b], apart
                continue
            q, ids, d = np.concatenate([q, found]), np.concatenate([ids, batch["id"].to_numpy()[b]]), np.concatenate([d, apart])
            best = np.lexsort((ids, d, q))
            first = np.searchsorted(q[best], np.arange(len(wanted)))
            best = best[np.arange(len(best)) - first[q[best]] < k]
            q, ids, d = q[best], ids[best], d[best]
        for i in range(0, len(q), 100_000):
            yield pd.DataFrame({"query_id": names[q[i : i + 100_000]], "id": ids[i : i + 100_000], "distance": d[i : i + 100_000]})

    return rows.mapInPandas(scan, schema)


def knn_join(
    base: DataFrame, probes: DataFrame, k: int, base_id: str, probe_id: str, vector: str = "embedding",
    block_rows: int = BLOCK_ROWS, fan_out: int = pivots.FAN_OUT, leaves: int | None = None,
) -> DataFrame:
    """(query_id, id, distance, rank): each probe's k nearest base rows, exact, both sides of any size.

    A tree of pivots (``pivots.build``) parts the base rows into leaves of at most ``block_rows``, or a share of 1 / MOST_LEAVES of the rows if that is
    more. Probes go down it and keep the leaves that may hold a near enough row, so the rows compared with a probe depend on its surroundings.
    Where vectors are so alike in distance that no leaf can be left out, every probe meets every row. Rows and
    probes of a leaf meet in blocks of at most about BLOCK_ROWS a side. Copies of one vector are thinned to the k that can matter first.
    Blocks keep k rows per probe and never emit all pairs. ``leaves`` bounds the leaves a probe looks into, for speed at some loss.
    """
    id_kind = base.schema[base_id].dataType.simpleString()
    probe_kind = probes.schema[probe_id].dataType.simpleString()
    base = base.select(F.col(quoted(base_id)).alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v")).dropna()
    probes = probes.select(F.col(quoted(probe_id)).alias("query_id"), F.col(quoted(vector)).cast("array<double>").alias("v")).dropna()
    result = f"query_id {probe_kind}, id {id_kind}, distance double"

    # Of the copies of one vector only the k smallest ids can be among the k nearest.
    base = first_rows(base, ["v"], ["id"], k, "copy").drop("copy")
    index = pivots.build(base, block_rows, BLOCK_ROWS, fan_out, None if leaves is not None else MOST_LEAVES)
    routed = pivots.route(index, probes, k, BLOCK_ROWS, leaves)
    left, right = pivots.blocks_of(index.rows, routed, BLOCK_ROWS, probe_rows=max(1, min(BLOCK_ROWS, KEPT_HITS // k)))

    types = to_arrow_type(probes.schema["query_id"].dataType), to_arrow_type(base.schema["id"].dataType)

    def meet(base_block: pa.Table, probe_block: pa.Table) -> pa.Table:
        if not base_block.num_rows or not probe_block.num_rows:
            return pa.table({})
        q, b, d = closest(pivots.dense(probe_block["v"]), pivots.dense(base_block["v"]), base_block["id"].to_numpy(), k)
        give_back()
        return pa.table({"query_id": probe_block["query_id"].take(pa.array(q)).cast(types[0]), "id": base_block["id"].take(pa.array(b)).cast(types[1]), "distance": d})

    block = ["node", "bs", "ps"]
    pairs = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(meet, result)
    return _top(pairs, k)


def knn_classify(
    train: DataFrame, test: DataFrame, label: str, id_column: str, vector: str = "embedding", k: int = 5,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, prediction): majority label of the k nearest training rows, the smallest label on a tie."""
    pairs = knn_join(train, test, k, id_column, id_column, vector, block_rows)
    labels = train.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(label)).alias("label"))
    votes = pairs.select("query_id", "id").join(labels, "id")
    return votes.groupBy("query_id").agg(F.mode("label", True).alias("prediction")).withColumnRenamed("query_id", id_column)
