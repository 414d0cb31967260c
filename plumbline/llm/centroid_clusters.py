"""Clusters of vectors around centroids; the nearest centroid is found by the threshold algorithm over sorted lists.

For every dimension the centroids stand in a list sorted by their value. From a vector's value the list is walked outward: the
nearest value not yet taken, on either side, is the frontier. A centroid met for the first time gets its exact distance. One that was met in no
dimension is at least as far away as the frontiers' squared distances sum to, so a vector is done as soon as that sum strictly
exceeds its best exact distance; strictly, as a centroid at the same distance may have the smaller number.

Components are whole numbers, ``floor(by * x)``, and everything is exact: vectors with large components (finite, of any size) are handled
with unbounded integers, sums travel as digits. Distances and inertias above the largest long are null; clusters and centroids are not affected.

Vectors that are null, have another number of components, or hold null or non-finite ones take no part. Rows that repeat an id each
count; so do rows without an id, which are taken last as first centroids. Equal hashes go to the smaller vector. With fewer vectors than
centroids there are fewer centroids; an empty table gives none and no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import BROADCAST_KEYS
from plumbline.session import materialise

# A vector is plain when no component is larger; a centroid is near when none of its is larger than the second bound. For up to 2**16
# components, distances between the two fit 64 bits, and a plain vector is further from any other centroid than the third bound.
PLAIN = 1 << 20
NEAR = 1 << 22
FAR = (NEAR - PLAIN) ** 2
MOST_COMPONENTS = 1 << 16
BLOCK_ROWS = 2_048
# Dimensions walked one step before the frontiers are summed anew.
STEP_DIMENSIONS = 8
DIGIT = 40


def usable(vectors: DataFrame, size: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``_id, _v``: the vectors of ``size`` finite components, as doubles."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    kept = vectors.filter(value.isNotNull() & (F.size(value) == size) & finite)
    return kept.select(F.col(key).alias("_id"), value.cast("array<double>").alias("_v"))


def whole(values: np.ndarray, by: int) -> np.ndarray:
    """``floor(by * x)`` for every component of a matrix, in Python's integers."""
    exact = lambda x: math.floor(x * by) if abs(x) < 2.0**53 else int(x) * by
    return np.array([[exact(x) for x in row] for row in values.tolist()], dtype=object).reshape(values.shape)


class Centroids:
    """Finds the nearest of some centroids: plain vectors in 64-bit integers, all others exactly as well, in unbounded ones."""

    def __init__(self, rows: list[list[int]], by: int):
        self.rows, self.by = rows, by
        self.size = len(rows[0])
        self.near = [i for i, row in enumerate(rows) if max(map(abs, row)) <= NEAR]
        self.plain = SortedLists(np.array([rows[i] for i in self.near], dtype=np.int64)) if self.near else None
        self._all = None

    def assign(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of ``(places, whole numbers, clusters, squared distances)`` that together hold every row of ``values`` once."""
        places = np.arange(len(values))
        left = places
        if self.plain is not None:
            places = np.flatnonzero(np.abs(values).max(axis=1) * self.by <= PLAIN)
            rows = np.floor(values[places] * self.by).astype(np.int64)
            clusters, distances = self.plain.nearest(rows)
            sure = distances < FAR
            yield places[sure], rows[sure], np.array(self.near)[clusters[sure]], distances[sure]
            left = np.setdiff1d(left, places[sure])
        if len(left):
            if self._all is None:
                self._all = SortedLists(np.array(self.rows, dtype=object))
            rows = whole(values[left], self.by)
            yield left, rows, *self._all.nearest(rows)


class SortedLists:
    """Centroids in one list per dimension, sorted by value, smaller numbers first."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, ties to the smaller, and the squared distance to it."""
        clusters, distances = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors), dtype=vectors.dtype)
        for a in range(0, len(vectors), BLOCK_ROWS):
            part = slice(a, a + BLOCK_ROWS)
            clusters[part], distances[part] = self._walk(vectors[part])
        return clusters, distances

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, dims = self.centroids.shape
        n, kind = len(vectors), vectors.dtype
        every = np.arange(n)
        low, high = np.empty((n, dims), dtype=np.int64), np.empty((n, dims), dtype=np.int64)
        for d in range(dims):
            high[:, d] = np.searchsorted(self.values[:, d], vectors[:, d])
        low[:] = high - 1
        frontier = np.zeros((n, dims), dtype=kind)  # squared distance of the next centroid outward; the last one's when none is left
        for a in range(0, dims, STEP_DIMENSIONS):
            self._look(vectors, every, np.arange(a, min(a + STEP_DIMENSIONS, dims)), low, high, frontier)
        seen = np.zeros((n, k), dtype=bool)
        best, number = np.zeros(n, dtype=kind), np.full(n, -1, dtype=np.int64)
        on = every
        while len(on):
            for a in range(0, dims, STEP_DIMENSIONS):
                columns = np.arange(a, min(a + STEP_DIMENSIONS, dims))
                met = self._step(vectors, on, columns, low, high, frontier)
                fresh = np.zeros((len(on), k), dtype=bool)
                rows, places = np.nonzero(met >= 0)
                fresh[rows, met[rows, places]] = True
                fresh &= ~seen[on]
                seen[on] |= fresh
                rows, found = np.nonzero(fresh)  # by row, then by number: of equal distances the smaller number comes first
                apart = vectors[on[rows]] - self.centroids[found]
                self._offer(on[rows], found, (apart * apart).sum(axis=1), best, number)
                done = (number[on] >= 0) & (frontier[on].sum(axis=1) > best[on]) | seen[on].all(axis=1)
                on = on[~done]
                if not len(on):
                    break
        return number, best

    @staticmethod
    def _offer(rows, found, distances, best, number) -> None:
        order = np.lexsort((found, distances, rows)) if distances.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], distances[i], found[i])), dtype=np.int64)
        rows, found, distances = rows[order], found[order], distances[order]
        first = np.ones(len(rows), dtype=bool)
        first[1:] = rows[1:] != rows[:-1]
        rows, found, distances = rows[first], found[first], distances[first]
        better = (number[rows] < 0) | (distances < best[rows]) | ((distances == best[rows]) & (found < number[rows]))
        best[rows[better]], number[rows[better]] = distances[better], found[better]

    def _sides(self, vectors, rows, columns, low, high):
        """Distances to the next value on either side, and whether there is one."""
        k = len(self.values)
        at = np.ix_(rows, columns)
        below, above = low[at], high[at]
        value = vectors[at]
        down = value - self.values[np.maximum(below, 0), columns]
        up = self.values[np.minimum(above, k - 1), columns] - value
        return at, below, above, down, up, below >= 0, above < k

    def _look(self, vectors, rows, columns, low, high, frontier) -> None:
        at, _, _, down, up, any_down, any_up = self._sides(vectors, rows, columns, low, high)
        near = np.where(any_down & (~any_up | (down <= up)), down, up)
        frontier[at] = np.where(any_down | any_up, near * near, frontier[at])

    def _step(self, vectors, rows, columns, low, high, frontier) -> np.ndarray:
        """Takes the nearer of both sides in every one of ``columns``; the centroids met, -1 where a list is at its end."""
        at, below, above, down, up, any_down, any_up = self._sides(vectors, rows, columns, low, high)
        go_down = any_down & (~any_up | (down <= up))
        go_up = any_up & ~go_down
        place = np.where(go_down, below, np.where(go_up, above, 0))
        met = np.where(go_down | go_up, self.order[place, columns], -1)
        low[at] -= go_down
        high[at] += go_up
        self._look(vectors, rows, columns, low, high, frontier)
        return met


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def first_centroids(vectors: DataFrame, k: int, seed: int, size: int, by: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of ``seed:id``."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    chosen = vectors.select("_v", mark.alias("_hash")).orderBy(F.asc_nulls_last("_hash"), "_v").limit(k).collect()  # k rows
    return whole(np.array([r["_v"] for r in chosen], dtype=np.float64).reshape(-1, size), by).tolist()


def _digits(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return out


def _moved(vectors: DataFrame, centroids: list[list[int]], by: int) -> list[list[int]]:
    """One round: every centroid that has vectors becomes the floor of their mean.

    Each task hands on its sums, split into digits that cannot overflow when they are added; the driver sees the totals,
    a bounded number of rows for each component of each centroid.
    """
    k, size = len(centroids), len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Centroids(centroids, by)
        sums, counts = np.zeros((k, size), dtype=object), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for _, rows, clusters, _ in nearest.assign(_matrix(batch.column(0), size)):
                counts += np.bincount(clusters, minlength=k)
                for c in np.unique(clusters):
                    sums[c] += rows[clusters == c].sum(axis=0).astype(object)
        out = [(c, -1, p, digit) for c in range(k) for p, digit in enumerate(_digits(int(counts[c])))]
        out += [(c, d, p, digit) for c in range(k) for d in range(size) for p, digit in enumerate(_digits(int(sums[c, d])))]
        columns = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int32(), pa.int32(), pa.int32(), pa.int64()])], ["c", "d", "p", "n"])

    totals = vectors.select("_v").mapInArrow(add, "c int, d int, p int, n long").groupBy("c", "d", "p").agg(F.sum("n").alias("n"))
    sums, counts = [[0] * size for _ in centroids], [0] * k
    for row in totals.collect():
        value = row["n"] << (DIGIT * row["p"])
        if row["d"] < 0:
            counts[row["c"]] += value
        else:
            sums[row["c"]][row["d"]] += value
    return [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids)]


def assigned(vectors: DataFrame, centroids: list[list[int]], by: int) -> DataFrame:
    """``_id, cluster, distance`` of every vector."""
    size = len(centroids[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Centroids(centroids, by)
        for batch in batches:
            chosen, apart = np.zeros(batch.num_rows, dtype=np.int32), np.full(batch.num_rows, -1, dtype=np.int64)
            for places, _, clusters, distances in nearest.assign(_matrix(batch.column(1), size)):
                chosen[places] = clusters
                apart[places] = distances if distances.dtype != object else [int(x) if x < 1 << 63 else -1 for x in distances]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen), pa.array(apart, mask=apart < 0)], ["_id", "cluster", "distance"])

    return vectors.select("_id", "_v").mapInArrow(assign, f"_id {vectors.schema['_id'].dataType.simpleString()}, cluster int, distance long")


def centroid_table(spark: SparkSession, centroids: list[list[int]]) -> DataFrame:
    """``cluster, centroid``: components as decimal integers, which may be longer than any number type."""
    return spark.createDataFrame([(i, [str(x) for x in row]) for i, row in enumerate(centroids)], "cluster int, centroid array<string>")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, by: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """``(key, cluster, distance)`` of every usable vector, and the final centroids as ``(cluster, centroid, n, inertia)``.

    Every round reads the vectors once; only sums per centroid are shuffled. ``k`` centroids of ``size`` components are held by the driver
    and by every task, which bounds both.
    """
    if not 1 <= size <= MOST_COMPONENTS or k < 1 or k * size > 16 * BROADCAST_KEYS:
        raise ValueError("centroids have to fit a task")
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, size, key, vector), "vectors")
    centroids = first_centroids(rows, k, seed, size, by)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(rows, centroids, by)
    if not len(centroids):
        found = rows.select("_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    else:
        found = materialise(assigned(rows, centroids, by), "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    fits = (F.count("distance") == F.count("*")) & (total <= F.lit((1 << 63) - 1))
    sums = found.groupBy("cluster").agg(F.count("*").alias("n"), F.when(fits, total.cast("long")).alias("inertia"))
    table = centroid_table(spark, centroids).join(sums, "cluster", "left").select("cluster", "centroid", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.col("inertia")).alias("inertia"))
    return found.withColumnRenamed("_id", key), table
