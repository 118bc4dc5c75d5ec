"""Vector code compression: product codebooks searched by Orchard's method.

Vectors become whole numbers floor(256 * x) and are cut into equal parts; a
codebook per part position starts from the parts of the smallest ids. Rounds
assign each part to its nearest entry and replace entries by the floored means
of their parts; then parts are assigned once more.

Search (Orchard): every entry has the list of the other entries of its
codebook, sorted by distance. A part starts at some entry, walks down that
entry's list and compares what it meets; on a better entry it jumps to that
entry's list. Entries that were met are marked and not compared again. The
walk stops where the list's distance exceeds twice the part's distance to its
entry: by the triangle inequality nothing beyond can be nearer, or as near.
All parts of a batch walk side by side.

Spark scans the vectors once per round; a task adds up its parts per entry and
one row per entry, component and task is summed. The driver holds codebooks
only (parts x entries x components).

Nulls, ties, odd input: vectors that are null or hold null or non-finite
components take no part, nor do vectors of another length than the most
frequent one that the number of parts divides (the longer on ties); rows with
the same vec_id are rows of their own (entries start from them in the order of
their components), a null vec_id comes last; ties between entries go to the
lower index; with fewer vectors than entries there are fewer entries; null
labels are one label; errors that need more than 64 bits are null (codes stay
exact); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .vectors import SUMS, add_up, group_means, integer_vectors, long_sum, longs, matrix, partial_sums, sha256_of, squared, whole_numbers

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK = 4096    # vectors that walk side by side


def neighbour_lists(books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per part position and entry: the entries of the codebook by distance (itself first) and those squared distances."""
    gaps = squared(books[:, :, None, :], books[:, None, :, :])
    at = np.arange(books.shape[1])
    gaps[:, at, at] = -1
    order = np.argsort(gaps, axis=2, kind="stable")
    return order, np.take_along_axis(gaps, order, axis=2)


def orchard(parts: np.ndarray, books: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry, squared distance, comparisons) of ``parts`` (vectors x positions x components)."""
    n, positions, width = parts.shape
    size = books.shape[1]
    order, gaps = (t.reshape(-1) for t in lists)
    entries = books.reshape(-1, width)
    x = parts.reshape(-1, width)
    base = np.tile(np.arange(positions) * size, n)          # a part's codebook in ``entries``
    best = np.zeros(len(x), dtype=np.int64)
    for p in range(positions):      # start: the entry whose first component is nearest
        heads = np.argsort(books[p, :, 0], kind="stable")
        ranked = books[p, heads, 0].astype(np.float64)
        best[p::positions] = heads[np.searchsorted((ranked[1:] + ranked[:-1]) / 2, parts[:, p, 0].astype(np.float64))]
    dist = squared(x, entries[base + best])
    met = np.zeros(len(x) * size, dtype=bool)
    met[np.arange(len(x)) * size + best] = True
    place = np.ones(len(x), dtype=np.int64)                 # next in the entry's list; place 0 is the entry itself
    live, compared = np.arange(len(x)) if size > 1 else np.arange(0), len(x)
    while len(live):
        at = (base[live] + best[live]) * size + place[live]
        within = np.asarray(gaps[at] <= 4 * dist[live], dtype=bool)
        live, at = live[within], at[within]
        entry = order[at]
        place[live] += 1
        new = ~met[live * size + entry]
        rows, entry = live[new], entry[new]
        met[rows * size + entry] = True
        compared += len(rows)
        gap = squared(x[rows], entries[base[rows] + entry])
        nearer = np.asarray((gap < dist[rows]) | ((gap == dist[rows]) & (entry < best[rows])), dtype=bool)
        rows, entry = rows[nearer], entry[nearer]
        best[rows], dist[rows], place[rows] = entry, gap[nearer], 1
        live = live[place[live] < size]
    return best.reshape(n, positions), dist.reshape(n, positions), compared


def _blocks(batches: Iterable[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple]:
    """(rows, parts, codes, squared distances) of blocks of vectors."""
    positions, _, width = books.shape
    ready = {}
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(start, BLOCK)
            parts, exact = whole_numbers(matrix(rows.column("vec"), positions * width), books, width=width)
            lists = ready.setdefault(exact.dtype, neighbour_lists(exact))
            parts = parts.reshape(-1, positions, width)
            codes, dist, _ = orchard(parts, exact, lists)
            yield rows, parts, codes, dist


def entry_means(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all vectors."""
    positions, size, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((positions * size, width), dtype=object), np.zeros(positions * size, dtype=np.int64)
        for _, parts, codes, _ in _blocks(batches, books):
            add_up(sums, counts, (codes + np.arange(positions) * size).ravel(), parts.reshape(-1, width))
        yield partial_sums(sums, counts)

    return group_means(vectors.select("vec").mapInArrow(run, SUMS), books.reshape(-1, width)).reshape(books.shape)


def assign_codes(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Written table (vec_id, label, code, error)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, codes, dist in _blocks(batches, books):
            digits, n = codes.astype(np.uint8).tobytes().hex(), 2 * codes.shape[1]
            code = [digits[i:i + n] for i in range(0, len(digits), n)]
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"), pa.array(code, pa.string()), longs(dist.sum(axis=1))],
                                             names=["vec_id", "label", "code", "error"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return materialize(vectors.select("vec_id", "label", "vec").mapInArrow(
        run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Written table (vec_id, label, code, error) and the codebooks (parts x entries x components, whole numbers)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    vectors = materialize(integer_vectors(embeddings, scale, ["vec_id", "label"]), "vectors")
    common = vectors.filter((F.col("size") > 0) & (F.col("size") % parts == 0)).groupBy("size").count() \
        .orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else parts
    vectors = vectors.filter(F.col("size") == size)
    first = vectors.select("vec_id", "vec").orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    books = matrix(pa.array([bytes(r.vec) for r in first], pa.binary()), size).reshape(-1, parts, size // parts).transpose(1, 0, 2)
    if first:
        for _ in range(rounds):
            books = entry_means(vectors, books)
    return assign_codes(vectors, books), books


def op12_vector_codes(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """The op12 contract over ``embeddings``."""
    codes, books = compress(embeddings)
    per_label = codes.groupBy(F.col("label").alias("__label")).agg(long_sum("error").alias("label_error"))
    out = codes.join(per_label, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(sha256_of(books.ravel())))
