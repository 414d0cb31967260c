"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Rows are dealt over shards and queries over blocks, both of bounded size; every block meets every shard. A node of a shard's ball
tree cannot hold an inner product above ``q.centre + |q| * radius``. Nodes are taken in the order of that bound,
and a node is left out for the queries whose k-th score so far is above it. Queries first search the shard they
live in; the k-th scores found there are shared, as starting bounds, with all other shards.

Vectors that are null, or hold null, NaN or infinite components, take no part; nor do rows without an id. Rows that repeat an id
count as one, with the smallest of their vectors. Scores of vectors of different length are not taken.
Equal scores are ordered by the smaller id. A query never finds its own id. Empty tables give no rows.

Scores are exact. Doubles hold every score of plain vectors, those whose components are small. The others, finite but of any size, are scored with
unbounded integers against all rows, in blocks. A score that no long can hold takes its place in the order and is given as null.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.session import materialise

SHARD_ROWS = 20_000
BLOCK_ROWS = 5_000
LEAF_ROWS = 256
# Scores of plain vectors stay under this bound, so that doubles hold them exactly.
EXACT = 1 << 52
# Pairs that are scored with unbounded integers at a time.
WIDE_PAIRS = 200_000


def scaled(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", by: float = 64.0) -> DataFrame:
    """``_id, _v, _wide``: usable vectors, one row per id. Plain ones hold ``floor(by * x)``, wide ones their components as they are."""
    sound = F.col(vector).isNotNull() & F.col(key).isNotNull() & (F.size(vector) > 0)
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    limit = F.sqrt(F.lit(EXACT) / F.size(vector)) / by
    plain = F.forall(vector, lambda x: F.abs(x.cast("double")) < limit)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * by).cast("double"))
    kept = vectors.filter(sound & F.coalesce(real, F.lit(False)))
    rows = kept.select(F.col(key).cast("long").alias("_id"), F.struct(F.when(plain, whole).otherwise(F.col(vector).cast("array<double>")).alias("_v"), (~plain).alias("_wide")).alias("_m"))
    return rows.groupBy("_id").agg(F.min("_m").alias("_m")).select("_id", "_m._v", "_m._wide")


class BallTree:
    """Balls around halves of halves of the rows, each cut across its widest axis."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(rows))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        self._grow(rows, 0, len(rows), leaf)

    def _grow(self, rows, start, stop, leaf) -> int:
        own = rows[self.order[start:stop]]
        centre = own.mean(axis=0)
        radius = math.sqrt(((own - centre) ** 2).sum(axis=1).max())
        at = len(self.nodes)
        self.nodes.append(None)
        left = right = -1
        if stop - start > leaf and radius > 0:
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(own[:, axis], half, kind="introselect")]
            left, right = self._grow(rows, start, start + half, leaf), self._grow(rows, start + half, stop, leaf)
        self.nodes[at] = (start, stop, centre, radius, left, right)
        return at


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.float64)
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, dtype=np.int64)

    def bound(self, rows: np.ndarray) -> np.ndarray:
        """A score below this one cannot be among the k best."""
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        worth = (scores >= self.bound(rows)[:, None]).any(axis=1)
        rows, scores = rows[worth], scores[worth]
        if not len(rows):
            return
        all_scores = np.hstack([self.scores[rows], scores])
        all_ids = np.hstack([self.ids[rows], np.broadcast_to(ids, scores.shape)])
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(all_ids, order, axis=1)


def search_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> Best:
    """The k best rows of one shard for each query, leaving out scores under ``floor`` and the query's own id."""
    tree, best = BallTree(rows), Best(len(queries), k, floor)
    norms = np.sqrt((queries**2).sum(axis=1))

    def bounds(node, active):
        # A little above the real bound, so that rounding never drops a tie.
        return (queries[active] @ tree.nodes[node][2] + norms[active] * tree.nodes[node][3]) * 1.0 + 1e-6 * (1 + norms[active])

    everyone = np.arange(len(queries))
    top = bounds(0, everyone)
    heap = [(-float(top.max()), 0, everyone, top)]
    while heap:
        _, node, active, upper = heapq.heappop(heap)
        active = active[upper >= best.bound(active)]
        if not len(active):
            continue
        start, stop, _, _, left, right = tree.nodes[node]
        if left < 0:
            own = tree.order[start:stop]
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                scores = queries[active] @ rows[part].T
                scores[query_ids[active][:, None] == ids[part][None, :]] = -np.inf
                best.offer(active, scores, ids[part])
        else:
            for child in (left, right):
                upper = bounds(child, active)
                heapq.heappush(heap, (-float(upper.max()), child, active, upper))
    return best


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    # Integers well under 2**53, so that products and sums of doubles are exact.
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _searcher(k: int):
    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = [[], [], []]
        if shard.num_rows and block.num_rows:
            asked = block["_q"].to_numpy()
            best = search_shard(shard["_id"].to_numpy(), _matrix(shard["_v"]), asked, _matrix(block["_v"]), block["_floor"].to_numpy(), k)
            rows, places = np.nonzero(np.isfinite(best.scores))
            keep = best.scores[rows, places] >= best.floor[rows]
            rows, places = rows[keep], places[keep]
            out = [asked[rows], best.ids[rows, places], best.scores[rows, places]]
        return pa.table({"_q": pa.array(out[0], pa.int64()), "_id": pa.array(out[1], pa.int64()), "_score": pa.array(out[2], pa.float64())})

    return search


_FOUND = "_q long, _id long, _score double"


def _ranked(found: DataFrame) -> DataFrame:
    return found.withColumn("_rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("_score"), "_id")))


def _wholes(column: pa.Array, wide: np.ndarray, by: float) -> np.ndarray:
    """Vectors as Python's integers; those of wide rows are scaled here."""
    scale = int(by)
    exact = lambda x: math.floor(x * by) if abs(x) < 2.0**53 else int(x) * scale
    return np.array([[exact(x) if w else int(x) for x in row] for row, w in zip(column.to_pylist(), wide.tolist())], dtype=object)


def _exact_searcher(k: int, by: float):
    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        out = [[], [], []]
        if shard.num_rows and block.num_rows:
            ids, asked = shard["_id"].to_numpy(), block["_q"].to_numpy()
            wide, own_wide = (t["_wide"].to_numpy().astype(bool) for t in (shard, block))
            rows, queries = _wholes(shard["_v"], wide, by), _wholes(block["_v"], own_wide, by)
            step = max(1, WIDE_PAIRS // len(rows))
            for a in range(0, len(queries), step):
                scores = queries[a : a + step] @ rows.T
                for q, own, line in zip(asked[a : a + step].tolist(), own_wide[a : a + step], scores):
                    # Pairs of two plain vectors were scored before.
                    best = sorted((-s, i) for s, i, w in zip(line.tolist(), ids.tolist(), wide) if i != q and (own or w))[:k]
                    out[0] += [q] * len(best)
                    out[1] += [i for _, i in best]
                    out[2] += [str(-s) for s, _ in best]
        return pa.table({"_q": pa.array(out[0], pa.int64()), "_id": pa.array(out[1], pa.int64()), "_score": pa.array(out[2], pa.string())})

    return search


def _merged(k: int):
    """The best of a query's rows, whose scores may be longer than any number type: at most k of each pair of blocks."""

    def merge(found: pa.Table) -> pa.Table:
        best = sorted((-int(s), i, q) for q, i, s in zip(found["_q"].to_pylist(), found["_id"].to_pylist(), found["_score"].to_pylist()))[:k]
        fits = lambda s: s if -(1 << 63) <= s < 1 << 63 else None
        return pa.table({
            "query_id": pa.array([q for _, _, q in best], pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
            "vec_id": pa.array([i for _, i, _ in best], pa.int64()), "score": pa.array([fits(-s) for s, _, _ in best], pa.int64()),
        })

    return merge


def top_inner_products(base: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, by: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best of ``base`` for every row of ``queries``, both as ``scaled`` gives them."""
    base, queries = materialise(base, "base"), materialise(queries, "queries")
    best = _plain_best(base.filter("NOT _wide"), queries.filter("NOT _wide"), k, shard_rows, block_rows)
    n_base, n_asked = base.filter("_wide").count(), queries.filter("_wide").count()
    if not n_base + n_asked:
        return best.select(F.col("_q").alias("query_id"), F.col("_rank").cast("int").alias("rank"), F.col("_id").alias("vec_id"), F.col("_score").cast("long").alias("score"))
    # Wide rows meet every query, wide queries meet every row.
    total, asked = base.count(), queries.count()
    cell = lambda name, n, salt: F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dims, shape = F.size("_v").alias("_d"), "_q long, _id long, _score string"
    exact = [best.select("_q", "_id", F.col("_score").cast("decimal(38,0)").cast("string").alias("_score"))]
    for rows, n_rows, ask, n_ask in ((base.filter("_wide"), n_base, queries.filter("NOT _wide"), asked - n_asked), (base, total, queries.filter("_wide"), n_asked)):
        shards, blocks = max(1, math.ceil(n_rows / shard_rows)), max(1, math.ceil(n_ask / block_rows))
        left = rows.select("_id", "_v", "_wide", dims, cell("_id", shards, "wide").alias("_s"), every(blocks, "_b"))
        right = ask.select(F.col("_id").alias("_q"), "_v", "_wide", dims, cell("_id", blocks, "ask").alias("_b"), every(shards, "_s"))
        exact.append(left.groupBy("_d", "_s", "_b").cogroup(right.groupBy("_d", "_s", "_b")).applyInArrow(_exact_searcher(k, by), shape))
    found = exact[0].unionByName(exact[1]).unionByName(exact[2])
    return found.groupBy("_q").applyInArrow(_merged(k), "query_id long, rank int, vec_id long, score long")


def _plain_best(base: DataFrame, queries: DataFrame, k: int, shard_rows: int, block_rows: int) -> DataFrame:
    """``_q, _id, _score, _rank`` among plain vectors."""
    shards = max(1, math.ceil(base.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / block_rows))
    cell = lambda name, n, salt: F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(n)).cast("int")
    dims = F.size("_v").alias("_d")
    rows = base.select("_id", "_v", dims, cell("_id", shards, "shard").alias("_s"))
    asked = queries.select(F.col("_id").alias("_q"), "_v", dims, cell("_id", shards, "shard").alias("_home"), cell("_id", blocks, "block").alias("_b"))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    search = _searcher(k)

    # Home shards first. A shard's queries are dealt over its blocks; a k-th score there bounds the search elsewhere.
    home = asked.withColumn("_floor", F.lit(float("-inf"))).withColumn("_s", F.col("_home"))
    if shards > 1:
        near = rows.groupBy("_d", "_s").cogroup(home.drop("_home", "_b").groupBy("_d", "_s")).applyInArrow(search, _FOUND)
        near = materialise(near, "near")
        kth = near.groupBy("_q").agg(F.count("*").alias("_n"), F.min("_score").alias("_low")).filter(F.col("_n") >= k)
        asked = asked.join(kth.select(F.col("_q").alias("_of"), "_low"), F.col("_q") == F.col("_of"), "left")
        asked = asked.withColumn("_floor", F.coalesce("_low", F.lit(float("-inf")))).drop("_of", "_low")
        far = asked.select("_q", "_v", "_d", "_b", "_home", "_floor", every(shards, "_s")).filter("_s <> _home").drop("_home")
        spread = rows.select("_id", "_v", "_d", "_s", every(blocks, "_b"))
        rest = spread.groupBy("_d", "_s", "_b").cogroup(far.groupBy("_d", "_s", "_b")).applyInArrow(search, _FOUND)
        found = near.unionByName(rest)
    else:
        spread = rows.select("_id", "_v", "_d", "_s", every(blocks, "_b"))
        found = spread.groupBy("_d", "_s", "_b").cogroup(home.drop("_home").groupBy("_d", "_s", "_b")).applyInArrow(search, _FOUND)
    return _ranked(found).filter(F.col("_rank") <= k)
