"""Integer vectors for the operators on vector codes and centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 1 << 40      # sums travel as digits of this base: a long holds 2^22 partial sums of one digit
LONG = 2 ** 63 - 1


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in double precision, which is exact for a power of two."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.floor(values.astype(np.float64) * scale) + 0.0


def integer_vectors(embeddings: DataFrame, scale: int, columns: list[str]) -> DataFrame:
    """(columns..., size, vec) of the vectors without a null or non-finite component.

    ``vec`` holds floor(scale * x) as float64 bytes (whole numbers of any size
    a double can hold; a component whose product overflows counts as non-finite).
    """
    names = [f"c{i}" for i in range(len(columns))]
    kinds = [embeddings.schema[c].dataType.simpleString() for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            whole = floors(pc.cast(pc.list_flatten(lists), pa.float64()).to_numpy(zero_copy_only=False), scale)   # null components are NaN here
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(whole))])[ends]
            keep = np.flatnonzero((bad[1:] == bad[:-1]) & lists.is_valid().to_numpy(zero_copy_only=False))
            vec = pa.array([whole[ends[i]:ends[i + 1]].tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(keep)) for n in names),
                                              pa.array(lengths[keep].astype(np.int32)), vec], names=[*names, "size", "vec"])

    rows = embeddings.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], "embedding")
    fields = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    out = rows.mapInArrow(run, f"{fields}, size int, vec binary")
    return out.withColumnsRenamed(dict(zip(names, columns, strict=True)))


def matrix(blobs: pa.Array, width: int) -> np.ndarray:
    """Rows of float64 vectors."""
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype=np.float64).reshape(-1, width)


def whole_numbers(*tables: np.ndarray, width: int) -> list[np.ndarray]:
    """The tables as int64 where four times a squared distance over ``width`` components fits, else as Python's integers."""
    top = max((float(np.abs(t.astype(np.float64)).max()) for t in tables if t.size), default=0.0)
    if 16.0 * max(width, 1) * top * top < 2.0 ** 62:
        return [t.astype(np.int64) for t in tables]
    return [np.array([int(x) for x in t.ravel()], dtype=object).reshape(t.shape) for t in tables]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(axis=-1)


def longs(values: np.ndarray) -> pa.Array:
    """Longs; null beyond 64 bits."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if v <= LONG else None for v in values], pa.int64())


# ------------------------------------------------------------------- group sums
SUMS = "slot int, dim int, digit int, value long"


def add_up(sums: np.ndarray, counts: np.ndarray, slots: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to its slot's sums (Python's integers) and counts."""
    n, width = sums.shape
    counts += np.bincount(slots, minlength=n)
    for j in range(width):
        column = rows[:, j]
        if rows.dtype != object and len(rows) * float(np.abs(column).max(initial=0)) < 2.0 ** 53:
            part = np.bincount(slots, weights=column, minlength=n).astype(np.int64)     # exact: below 2^53
            used = np.flatnonzero(part)
            sums[used, j] += part[used].astype(object)
        else:
            np.add.at(sums[:, j], slots, column.astype(object))


def partial_sums(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One task's sums as rows of ``SUMS``: dim -1 holds the count, large sums several digits."""
    out = []
    for s in np.flatnonzero(counts):
        out.append((int(s), -1, 0, int(counts[s])))
        for j, value in enumerate(sums[s]):
            value, digit = int(value), 0
            while not -LIMB < value < LIMB:
                value, low = divmod(value, LIMB)
                out.append((int(s), j, digit, low))
                digit += 1
            out.append((int(s), j, digit, value))
    columns = list(zip(*out)) if out else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                                      names=["slot", "dim", "digit", "value"])


def group_means(partial: DataFrame, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) per slot, exactly; slots without rows stay as they are. One row per slot, component and digit comes back."""
    sums: dict[tuple[int, int], int] = {}
    for r in partial.groupBy("slot", "dim", "digit").agg(F.sum("value").alias("value")).collect():
        sums[r.slot, r.dim] = sums.get((r.slot, r.dim), 0) + r.value * LIMB ** r.digit
    after = before.astype(object).copy()
    for (slot, dim), value in sums.items():
        if dim >= 0:
            after[slot, dim] = value // sums[slot, -1]
    return after


def long_sum(column: str) -> Column:
    """Sum of longs as a long; null where it does not fit or where a value is null."""
    return F.when(F.count(column) == F.count(F.lit(1)), F.sum(F.col(column).cast("decimal(20,0)"))).try_cast("long")


def sha256_of(numbers: Iterable) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in numbers).encode()).hexdigest()

