"""Centroid clustering with n-simplex projection.

Vectors become whole numbers floor(256 * x). A few pivots span a simplex; a
vector's distances to them, taken once and kept with it, fix its apex: its
place above that simplex (coordinates within it, and a height). For two
vectors with apexes (y, a) and (z, b) the true distance lies between
sqrt(|y - z|^2 + (a - b)^2) and sqrt(|y - z|^2 + (a + b)^2).

Each round computes the apexes of the centroids from their pivot distances.
A centroid whose lower bound exceeds a vector's smallest upper bound cannot be
nearest; the others are compared exactly, in whole numbers (the bounds are
floating point and get ``SLACK``). Pivots are starting centroids, each next
one the highest above the simplex so far, so the simplex is well shaped.

Spark scans the vectors once per round; a task adds up its vectors per
centroid and one row per centroid, component and task is summed. The driver
holds centroids and pivots only.

Nulls, ties, odd input: vectors that are null, hold null or non-finite
components or have another length take no part; rows with the same vec_id are
rows of their own (in the order of their components where they start
centroids), a null vec_id starts none unless no other is left; ties between
centroids go to the smaller number; with fewer vectors than centroids there
are fewer centroids; distances and inertias that need more than 64 bits are
null (clusters stay exact); other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .vectors import SUMS, add_up, group_means, integer_vectors, long_sum, longs, matrix, partial_sums, sha256_of, squared, whole_numbers

SCALE, SIZE = 256, 64
CLUSTERS, ROUNDS = 40, 5
SEED_PREFIX = "2:"
PIVOTS = 20
FLAT = 1e-3         # a pivot must rise by this share of the largest distance above the simplex before it
SLACK = 1e-5        # of the largest squared distance: far above the rounding of the bounds
BLOCK = 2048


class Simplex:
    """The base simplex of some pivots; ``apex`` places vectors above it from pivot distances alone."""

    def __init__(self, candidates: np.ndarray, pivots: int = PIVOTS):
        points = candidates.astype(np.float64)
        with np.errstate(over="ignore"):
            if not np.isfinite((points * points).sum()):
                points = points[:0]     # no bounds in double precision: every centroid is compared
        reach = float(np.sqrt(squared(points, points[0]).max())) if len(points) else 0.0
        chosen, height = [0] if len(points) else [], np.sqrt(squared(points, points[:1])) if len(points) else None
        while len(chosen) < min(pivots, len(points)) and float(height.max()) > FLAT * reach:
            chosen.append(int(height.argmax()))
            self._span(points[chosen])
            height = self.apex(self.distances(points))[:, -1]
        self._span(points[chosen])

    def _span(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.edges = pivots[1:] - pivots[:1]
        gram = self.edges @ self.edges.T
        self.base = np.linalg.cholesky(gram) if len(gram) else gram      # row i: pivot i + 1 within the simplex
        self.lengths = (self.edges * self.edges).sum(axis=1)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots."""
        return squared(vectors.astype(np.float64)[:, None, :], self.pivots[None, :, :])

    def apex(self, to_pivots: np.ndarray) -> np.ndarray:
        """Coordinates within the simplex and the height above it."""
        if not len(self.pivots):
            return np.zeros((len(to_pivots), 1))
        inner = (to_pivots[:, :1] + self.lengths - to_pivots[:, 1:]) / 2
        within = np.linalg.solve(self.base, inner.T).T if len(self.base) else inner
        height = np.sqrt(np.maximum(0.0, to_pivots[:, 0] - (within * within).sum(axis=1)))
        return np.concatenate([within, height[:, None]], axis=1)


def possible(apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Vectors x centroids: which centroids the bounds leave."""
    within = np.zeros((len(apexes), len(centroids)))
    for j in range(apexes.shape[1] - 1):
        within += (apexes[:, j, None] - centroids[None, :, j]) ** 2
    a, b = apexes[:, -1:], centroids[None, :, -1]
    upper = (within + (a + b) ** 2).min(axis=1)
    largest = max(float((apexes * apexes).sum(axis=1).max(initial=0)), float((centroids * centroids).sum(axis=1).max(initial=0)))
    return ~(within + (a - b) ** 2 > (upper + SLACK * largest)[:, None])


def nearest(vectors: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance), exactly, among the centroids that are left; the smaller number on ties."""
    best, dist = np.full(len(vectors), -1), np.zeros(len(vectors), dtype=vectors.dtype)
    for c in range(len(centroids)):
        rows = np.flatnonzero(left[:, c])
        gap = squared(vectors[rows], centroids[c])
        nearer = np.asarray((best[rows] < 0) | (gap < dist[rows]), dtype=bool)
        best[rows[nearer]], dist[rows[nearer]] = c, gap[nearer]
    return best, dist


def with_apexes(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """Written table (vec_id, vec, apex): pivot distances are taken once, for all rounds."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(start, BLOCK)
                apexes = simplex.apex(simplex.distances(matrix(rows.column("vec"), simplex.pivots.shape[1])))
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("vec"), pa.array([a.tobytes() for a in apexes], pa.binary())],
                                                 names=["vec_id", "vec", "apex"])
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return materialize(vectors.select("vec_id", "vec").mapInArrow(run, f"vec_id {kind}, vec binary, apex binary"), "apexes")


def _blocks(batches: Iterable[pa.RecordBatch], centroids: np.ndarray, simplex: Simplex) -> Iterator[tuple]:
    """(rows, vectors, centroid, squared distance) of blocks of vectors."""
    size = centroids.shape[1]
    tops = simplex.apex(simplex.distances(centroids))
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(start, BLOCK)
            vectors, exact = whole_numbers(matrix(rows.column("vec"), size), centroids, width=size)
            apexes = matrix(rows.column("apex"), tops.shape[1])
            left = possible(apexes, tops) if vectors.dtype != object else np.ones((len(vectors), len(exact)), dtype=bool)
            yield rows, vectors, *nearest(vectors, exact, left)


def centroid_means(vectors: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """The centroids after one round over all vectors."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, dtype=object), np.zeros(len(centroids), dtype=np.int64)
        for _, rows, best, _ in _blocks(batches, centroids, simplex):
            add_up(sums, counts, best, rows)
        yield partial_sums(sums, counts)
    return group_means(vectors.select("vec", "apex").mapInArrow(run, SUMS), centroids)


def assign(vectors: DataFrame, centroids: np.ndarray, simplex: Simplex) -> DataFrame:
    """Written table (vec_id, cluster, distance)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, best, dist in _blocks(batches, centroids, simplex):
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(best.astype(np.int32)), longs(dist)], names=["vec_id", "cluster", "distance"])
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return materialize(vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters")


def cluster(embeddings: DataFrame, size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
            seed_prefix: str = SEED_PREFIX, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """Written table (vec_id, cluster, distance) and the final centroids (whole numbers)."""
    vectors = integer_vectors(embeddings, scale, ["vec_id"]).filter(F.col("size") == size)
    key = F.sha2(F.concat(F.lit(seed_prefix), F.col("vec_id").cast("string")), 256)
    first = vectors.select("vec").orderBy(key.asc_nulls_last(), "vec").limit(clusters).collect()
    centroids = matrix(pa.array([bytes(r.vec) for r in first], pa.binary()), size)
    simplex = Simplex(centroids, pivots)
    placed = with_apexes(vectors, simplex)
    if first:
        for _ in range(rounds):
            centroids = centroid_means(placed, centroids, simplex)
    return assign(placed, centroids, simplex), centroids


def op13_centroid_clusters(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """The op13 contract over ``embeddings``."""
    members, centroids = cluster(embeddings)
    inertia = members.groupBy("cluster").agg(long_sum("distance").alias("cluster_inertia")).collect()      # a row per centroid
    total = None if any(r.cluster_inertia is None for r in inertia) else sum(r.cluster_inertia for r in inertia)
    rows = [(r.cluster, r.cluster_inertia, sha256_of(centroids[r.cluster])) for r in inertia]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    out = members.join(F.broadcast(per_cluster), "cluster")     # at most CLUSTERS rows
    out = out.withColumn("inertia", F.lit(total if total is None or total < 2 ** 63 else None).cast("long"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
