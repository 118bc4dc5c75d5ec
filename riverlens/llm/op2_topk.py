"""Exact top-k inner products through a pivot-distance index.

Vectors are x -> floor(1024 * x). With one more component
sqrt(M^2 - |v|^2) (M the largest norm) all vectors have norm M, so a larger
inner product with a query is a smaller Euclidean distance, and the triangle
inequality holds.

* Index: every vector belongs to its nearest pivot; its distance to the pivot
  gives its annulus. Vectors of one (pivot, annulus) are packed into cells of
  bounded size, hot annuli into many.
* Search: for a block of queries, annuli are sorted by the lower bound
  max(0, D - r_max, r_min - D), D being the query's distance to the pivot. The
  nearest are visited first, in rounds of growing size; an annulus is visited
  only while its bound does not exceed the distance of the k-th best so far.
  The last round has no limit, so the result is exact.
* Cells and query blocks meet in a join on (pivot, annulus); a pair gives at
  most k rows per query.

Pivots are k-means centres of a bounded sample (``SAMPLE`` rows by hash); any
pivots give exact results.

Nulls, ties, odd input: vectors that are null or hold null or non-finite
components, and rows without an id, take no part; shorter vectors are padded
with zeros; ties go to the smaller vec_id; equal rows count once; rows that
share an id are all candidates (never of that id's queries); scores beyond
64 bits are compared exactly (to 37 digits) and shown as the largest long; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1024
K = 10
SAMPLE = 8192
MAX_PIVOTS, RINGS = 256, 16
CELL, QUERY_BLOCK = 512, 128
VISITS = (2, 8, None)     # annuli of each round; the last one takes all that the bound allows
EXACT = 2.0 ** 53
LONG = 2 ** 63 - 1
WIDEST = 10 ** 37      # scores beyond count as equal


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of few rows while packed cells travel."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def matrix(blobs, size: int) -> np.ndarray:
    """Rows of float64 vectors, padded with zeros to ``size``."""
    out = np.zeros((len(blobs), size))
    for i, b in enumerate(blobs):
        v = np.frombuffer(b)
        out[i, :len(v)] = v
    return out


def lift(v: np.ndarray, top: float) -> np.ndarray:
    """Vectors with the component that makes their norm ``sqrt(top)``."""
    return np.concatenate([v, np.sqrt(np.maximum(0, top - (v * v).sum(axis=1)))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """Written table (vec_id, vec, norm2, size) of the vectors that take part; vec holds float64 bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, e in zip(batch["vec_id"], batch["embedding"], strict=True):
                v = np.floor(scale * np.asarray(e, dtype=np.float64)) + 0.0   # no negative zero: equal vectors have equal bytes
                if np.isfinite(v).all():
                    rows.append((i, v.tobytes(), float(v @ v), len(v)))
            yield pd.DataFrame(rows, columns=["vec_id", "vec", "norm2", "size"])
    with np.errstate(all="ignore"):
        rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null")
        return materialize(rows.mapInPandas(run, "vec_id long, vec binary, norm2 double, size int").dropDuplicates(["vec_id", "vec"]), "vectors")


def choose_pivots(sample: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """(pivots, ring width) from a sample of lifted vectors by a few k-means rounds."""
    pivots = np.unique(sample, axis=0)
    pivots = pivots[np.linspace(0, len(pivots) - 1, min(n, len(pivots))).astype(int)]
    for _ in range(5):
        near = distances(sample, pivots).argmin(axis=1)
        pivots = np.array([sample[near == j].mean(axis=0) if (near == j).any() else p for j, p in enumerate(pivots)])
    return pivots, max(float(distances(sample, pivots).min(axis=1).max()) / RINGS, 1e-9)


def build_index(vectors: DataFrame, pivots: np.ndarray, width: float, size: int, top: float) -> DataFrame:
    """Written table (vec_id, vec, pivot, ring, dist)."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)   # at most MAX_PIVOTS rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(lift(matrix(batch["vec"], size), top), shared.value)
                near, dist = d.argmin(axis=1), d.min(axis=1)
                ring = np.minimum(np.nan_to_num(dist / width, nan=0.0), 2 * RINGS).astype(np.int32)
                yield pd.DataFrame({"vec_id": batch["vec_id"], "vec": batch["vec"], "pivot": near.astype(np.int32), "ring": ring, "dist": dist})
    return materialize(vectors.select("vec_id", "vec").mapInPandas(run, "vec_id long, vec binary, pivot int, ring int, dist double"), "vector-index")


def _pack(size: int, keys: list[str]):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        return pd.DataFrame([[*key, group["vec_id"].to_numpy(dtype=np.int64).tobytes(), matrix(list(group["vec"]), size).tobytes()]],
                            columns=[*keys, "ids", "vecs"])
    return run


def packed_cells(index: DataFrame, rings: DataFrame, size: int) -> DataFrame:
    """(pivot, ring, sub, ids, vecs): cells of about CELL vectors; an annulus has as many as it needs."""
    dealt = index.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(rings), ["pivot", "ring"])
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / CELL)).cast("int"))
    return materialize(dealt.groupBy("pivot", "ring", "sub").applyInPandas(_pack(size, ["pivot", "ring", "sub"]),
                                                                           "pivot int, ring int, sub int, ids binary, vecs binary"), "vector-cells")


def query_blocks(index: DataFrame, is_query: Column, size: int) -> DataFrame:
    """(qblock, ids, vecs): the queries in blocks of about QUERY_BLOCK."""
    queries = index.filter(is_query).select("vec_id", "vec").withColumn("row", F.monotonically_increasing_id())
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    queries = queries.withColumn("qblock", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return materialize(queries.groupBy("qblock").applyInPandas(_pack(size, ["qblock"]), "qblock int, ids binary, vecs binary"), "query-blocks")


def _plan(rings: np.ndarray, pivots: np.ndarray, size: int, top: float, k: int, skip: int, visits: int | None):
    """Pairs of query blocks and annuli of one round: each query's annuli number skip .. skip + visits by their bounds."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, ids, vecs, best in zip(batch["qblock"], batch["ids"], batch["vecs"], batch["kth"], strict=True):
                ids, q = np.frombuffer(ids, dtype=np.int64), np.frombuffer(vecs).reshape(-1, size)
                limit = np.full(len(q), np.inf)
                for x in best if best is not None else []:
                    if x["n"] >= k:
                        limit[x["qpos"]] = x["score"]
                norm = (q * q).sum(axis=1)
                reach = np.where(np.isinf(limit), np.inf, np.sqrt(np.maximum(0, norm + top - 2 * np.where(np.isinf(limit), 0, limit))))
                d = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots)[:, rings[:, 0].astype(int)]
                bound = np.nan_to_num(np.maximum(0, np.maximum(d - rings[:, 2], rings[:, 3] - d)), nan=0.0, posinf=np.inf)
                turn = bound.argsort(axis=1, kind="stable").argsort(axis=1)
                # a margin for rounding; bounds that are not finite stop nothing
                wanted = (bound <= np.nan_to_num(reach, nan=np.inf, posinf=np.inf)[:, None] * (1 + 1e-9) + 1e-3 + 1e-9 * top ** 0.5) & (turn >= skip)
                wanted &= turn < skip + visits if visits else True
                rows = []
                for r in np.flatnonzero(wanted.any(axis=0)):
                    need = np.flatnonzero(wanted[:, r])
                    rows.append((block, int(rings[r, 0]), int(rings[r, 1]), need.astype(np.int32).tobytes(), ids[need].tobytes(), q[need].tobytes(),
                                 limit[need].tobytes()))
                yield pd.DataFrame(rows, columns=["qblock", "pivot", "ring", "need", "qids", "qvecs", "floor"])
    return run


def _visit(size: int, top: float, k: int):
    """Best k of every pair of a query block and a cell that can still enter the queries' results."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                need, qids = np.frombuffer(row.need, dtype=np.int32), np.frombuffer(row.qids, dtype=np.int64)
                q, x = np.frombuffer(row.qvecs).reshape(-1, size), np.frombuffer(row.vecs).reshape(-1, size)
                ids, floor = np.frombuffer(row.ids, dtype=np.int64), np.frombuffer(row.floor)
                out = []
                if top < EXACT:
                    scores = q @ x.T
                else:      # whole numbers of any size
                    whole = lambda m: np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape)
                    scores = whole(q) @ whole(x).T
                for j in range(len(q)):
                    s = scores[j]
                    at = np.flatnonzero(ids != qids[j])
                    if np.isfinite(floor[j]) and top < EXACT:
                        at = at[s[at] >= floor[j]]
                    if len(at) > 4 * k and top < EXACT:
                        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                    out += [(row.qblock, int(need[j]), int(qids[j]), int(ids[i]), float(s[i]), str(max(-WIDEST, min(WIDEST, int(s[i])))))
                            for i in sorted(at, key=lambda i: (-s[i], ids[i]))[:k]]
                yield pd.DataFrame(out, columns=["qblock", "qpos", "query_id", "vec_id", "score", "exact"])
    return run


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query among all other vectors."""
    spark = embeddings.sparkSession
    vectors = quantised(embeddings, scale)
    size, top, n = vectors.agg(F.max("size"), F.max("norm2"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = vectors.orderBy(F.xxhash64("vec_id", "vec"), "vec_id", "vec").limit(SAMPLE).select("vec").collect()
    pivots, width = choose_pivots(lift(matrix([bytes(r.vec) for r in sample], size), top), min(MAX_PIVOTS, max(1, int(n ** 0.5 / 4))))
    index = build_index(vectors, pivots, width, size, top)
    # at most pivots * (2 * RINGS + 1) rows
    stats = index.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("pivot", "ring").collect()
    rings = np.array([[r.pivot, r.ring, r.high, r.low] for r in stats])
    cells = packed_cells(index, spark.createDataFrame([(r.pivot, r.ring, r.n) for r in stats], "pivot int, ring int, n long"), size)
    blocks = query_blocks(index, is_query, size)
    order = Window.partitionBy("qblock", "qpos").orderBy(F.col("exact").cast("decimal(38,0)").desc(), "vec_id")
    best, skip = None, 0
    for visits in VISITS:
        kth = blocks.withColumn("kth", F.lit(None).cast("array<struct<qpos:int,score:double,n:long>>")) if best is None else blocks.join(
            best.groupBy("qblock", "qpos").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n"))
                .groupBy("qblock").agg(F.collect_list(F.struct("qpos", "score", "n")).alias("kth")), "qblock", "left")
        with small_batches(spark, 64):
            pairs = materialize(kth.mapInPandas(_plan(rings, pivots, size, top, k, skip, visits),
                                                "qblock int, pivot int, ring int, need binary, qids binary, qvecs binary, floor binary"), "query-pairs")
            found = pairs.join(cells.select("pivot", "ring", "ids", "vecs"), ["pivot", "ring"]).mapInPandas(
                _visit(size, top, k), "qblock int, qpos int, query_id long, vec_id long, score double, exact string")
            merged = found if best is None else best.unionByName(found)
            best = materialize(merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank"), "query-best")
        skip += visits or 0
    score = F.col("exact").cast("decimal(38,0)")
    return best.select("query_id", F.row_number().over(order).cast("int").alias("rank"), "vec_id",
                       F.least(F.greatest(score, F.lit(-LONG)), F.lit(LONG)).cast("long").alias("score"))


def op2_topk(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """The op2 contract over ``embeddings``."""
    return top_k(embeddings, F.col("vec_id") % 100 == 0)
