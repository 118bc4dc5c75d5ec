"""Gradient boosted trees for many fits at once.

A study fits the same models on many subsets of the same rows (folds, time
spans, fractions). Here all its fits grow together:

* ``bin_rows`` turns the features into at most 256 bins per column once, and
  packs rows with their labels and *memberships* (which fits train on a row)
  into written blocks of at most ``LARGE_BLOCK`` rows, dealt so that every core
  has some.
* ``grow`` builds the trees of all fits in lockstep: one job per level. Each
  task adds up gradient histograms of its blocks for every (fit, class, node),
  keyed by feature and bin; tasks' histograms meet by key, the best split of
  each node comes back to the driver, and the next job routes rows through it.
  Margins of each fit's own rows are written every ``KEEP`` rounds, as adding up
  the rounds since is repeated on every level. The driver holds trees, never rows.
* Up to ``BLOCK_ROWS`` rows in all, waiting for a job per level would cost more
  than the sums: each fit's rows then meet in one task, which grows it to the
  end; of two sister nodes it sums the smaller and subtracts. Both ways share
  the functions below, and gradients are whole multiples of a quantum, so sums
  are exact in any order and both give the same trees.

Two learners: ``newton`` takes second-order steps (gain and leaves from sums
of gradients and curvatures, an l2 penalty of 1, at least a curvature of 1 per
leaf) and draws columns per tree; ``residual`` fits residuals (improvement by
difference of means, leaves by one line search step). Classes share one
softmax, so probabilities sum to 1; a number is fitted by squared error.

Rows are drawn per round by a hash of the row key and the round, columns by
the round and class: neither depends on partitions or on other fits.

Nulls and ties: a null or NaN feature sorts after all values; splits with
equal gain go to the earlier column, then the smaller bin; rows without a key,
a label or a membership do not train; a class that a fit never sees keeps a
vanishing probability; a fit without rows is an error.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize
from .quality import guard_names

BLOCK_ROWS = 3 << 18    # rows that one task may hold: 61 bytes each, and about 150 while it grows a fit
LARGE_BLOCK = 1 << 18
SMALL_BLOCK = 1 << 12   # rows; smaller ones cost more calls than sums
BLOCKS_A_CORE = 4
STEP = 1 << 15          # rows summed at a time: their places and weights stay in the processor's cache
BINS = 64
PAIR_ROWS = 4           # rows a cell from which columns are summed in pairs
KEEP = 2                # rounds between two written states of the margins
QUANTUM = 2.0 ** -26    # of a gradient unit: a block's sums are exact in a double, those of 2^36 rows in 64 bits
TINY = 1e-16


@dataclass(frozen=True)
class Learner:
    """How trees are grown; ``rows`` and ``columns`` are the shares drawn per round and per tree."""

    rounds: int
    depth: int
    rate: float
    rows: float = 1.0
    columns: float = 1.0
    newton: bool = True
    l2: float = 1.0
    min_weight: float = 1.0
    seed: int = 42


# Hyper-parameters that must match.
LEARNERS = {
    "boosted": Learner(rounds=200, depth=5, rate=0.05, rows=0.8, columns=0.8, newton=True),
    "gradient_boosting": Learner(rounds=150, depth=4, rate=0.05, rows=0.8, newton=False),
}


@dataclass(frozen=True)
class Fit:
    """One model to fit: its learner, the place of its rows in ``members``, classes (0: a number), start and unit."""

    name: str
    learner: Learner
    member: int
    classes: int = 0
    start: tuple[float, ...] = ()
    unit: float = 1.0
    rows: int = 0

    @property
    def outputs(self) -> int:
        return max(self.classes, 1)

    @property
    def cost(self) -> float:
        return self.rows * self.learner.rows * self.learner.rounds * self.learner.depth * self.learner.columns * self.outputs


@dataclass
class Trees:
    """Trees of one fit by (round, output, node); node i has the children 2i+1 and 2i+2, feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    first: int = 0      # the round that comes first here

    @classmethod
    def empty(cls, fit: Fit) -> Trees:
        shape = (fit.learner.rounds, fit.outputs, 2 ** (fit.learner.depth + 1) - 1)
        return cls(np.full(shape, -1, dtype=np.int16), np.zeros(shape, dtype=np.uint8), np.zeros(shape))

    def rounds(self, first: int, end: int) -> Trees:
        """The trees of some rounds only."""
        return Trees(self.feature[first:end], self.bin[first:end], self.value[first:end], first)

    def route(self, bins: np.ndarray, r: int, k: int, rows: np.ndarray, levels: int) -> np.ndarray:
        """Nodes that ``rows`` of ``bins`` (a column's values side by side) reach from the root after ``levels`` steps."""
        r -= self.first
        feature, cut = self.feature[r, k], self.bin[r, k].astype(np.int16)
        leaf = feature < 0
        if leaf[0] or not levels:
            return np.zeros(len(rows), dtype=np.int64)
        column = np.where(leaf, 0, feature).astype(np.int64) * len(bins)
        left = np.where(leaf, np.arange(len(leaf)), 2 * np.arange(len(leaf)) + 1)       # a leaf leads to itself
        cut[leaf] = 256
        values = bins.ravel(order="F")      # no copy
        node = left[0] + (values[column[0] + rows] > cut[0])
        for _ in range(levels - 1):
            node = left[node] + (values[column[node] + rows] > cut[node])
        return node

    def add(self, margins: np.ndarray, bins: np.ndarray, fit: Fit, rounds: Iterable[int], rows: np.ndarray | None = None) -> np.ndarray:
        """Margins of ``rows`` (all, if not given) with those rounds added."""
        rows = np.arange(len(bins)) if rows is None else rows
        for r in rounds:
            for k in range(fit.outputs):
                leaf = self.route(bins, r, k, rows, fit.learner.depth)
                margins[:, k] += self.value[r - self.first, k][leaf]
        return margins


# ------------------------------------------------------------------ one block
def uniform(keys: np.ndarray, seed: int, r: int) -> np.ndarray:
    """A number in [0, 1) per key and round, by mixing bits."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + r + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


def columns_of(learner: Learner, width: int, r: int, k: int) -> np.ndarray:
    """The columns that a tree may split on."""
    n = max(1, int(learner.columns * width))
    return np.arange(width) if n == width else np.sort(np.random.default_rng([learner.seed, r, k]).permutation(width)[:n])


def expected(fit: Fit, margins: np.ndarray) -> np.ndarray:
    """What the margins say of every output: class probabilities, or the number."""
    if not fit.classes:
        return margins
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def channels(fit: Fit, y: np.ndarray, said: np.ndarray, k: int) -> np.ndarray:
    """Rows' gradient, weight (and, for residual classes, curvature) of output k, as whole numbers of quanta."""
    if fit.classes:
        p = said[:, k]
        g = p - (y == k)
        out = [g, np.maximum(2 * p * (1 - p), TINY)] if fit.learner.newton else [g, np.ones(len(y)), np.abs(g) * (1 - np.abs(g))]
    else:
        out = [(said[:, 0] - y) / fit.unit, np.ones(len(y))]
    return np.rint(np.stack(out) / QUANTUM)


def histogram(bins: np.ndarray, rows: np.ndarray | None, columns: np.ndarray, slot: np.ndarray, slots: int, weights: np.ndarray) -> np.ndarray:
    """Sums (channel, slot, column, bin) of the quanta of ``rows`` (all, if not given); exact, as a task's sums stay below 2^53.

    Where rows outnumber the cells of two columns, both are summed at once and their sums read off the table's margins.
    """
    out = np.zeros((len(weights), slots, len(columns), BINS), dtype=np.int64)
    same = [int(w[0]) if len(w) and (w == w[0]).all() else None for w in weights]       # a channel of one value is counted

    def summed(at: np.ndarray, c: int, part: slice, cells: int) -> np.ndarray:
        return np.bincount(at, weights[c][part], cells) if same[c] is None else np.bincount(at, None, cells) * same[c]

    paired = len(columns) // 2 * 2 if len(slot) >= PAIR_ROWS * slots * BINS ** 2 else 0
    step = max(STEP, 4 * slots * BINS ** 2)
    for start in range(0, len(slot), step) if paired else ():
        part = slice(start, start + step)
        base, some = slot[part] * BINS ** 2 if slots > 1 else None, part if rows is None else rows[part]
        for j in range(0, paired, 2):
            at = bins[:, columns[j]][some].astype(np.uint16)
            at *= BINS
            at += bins[:, columns[j + 1]][some]
            at = at.astype(np.int64) if base is None else base + at
            for c in range(len(weights)):
                both = summed(at, c, part, slots * BINS ** 2).reshape(slots, BINS, BINS)
                out[c, :, j] += both.sum(axis=2).astype(np.int64)
                out[c, :, j + 1] += both.sum(axis=1).astype(np.int64)
    for start in range(0, len(slot), STEP) if paired < len(columns) else ():
        part = slice(start, start + STEP)
        base, some = slot[part] * BINS, part if rows is None else rows[part]
        for j in range(paired, len(columns)):       # one column at a time stays in the processor's cache
            at = base + bins[:, columns[j]][some]
            for c in range(len(weights)):
                out[c, :, j] += summed(at, c, part, slots * BINS).reshape(slots, BINS).astype(np.int64)
    return out


def leaf_values(fit: Fit, sums: np.ndarray) -> np.ndarray:
    """Value of a leaf from its sums (channel first), learning rate and unit applied."""
    real = sums * QUANTUM
    if fit.learner.newton:
        step = -real[0] / (real[1] + fit.learner.l2)
    else:
        weight = real[-1]       # rows for a number, curvature for a class
        step = np.where(weight > 1e-12, -real[0] / np.where(weight > 1e-12, weight, 1.0), 0.0)
        step = step * (fit.classes - 1) / fit.classes if fit.classes else step
    return step * fit.learner.rate * fit.unit


def best_splits(fit: Fit, sums: np.ndarray) -> list[tuple | None]:
    """Per slot (place of the column, bin, left sums, right sums), or None where no split gains."""
    left = sums.cumsum(axis=3)[..., :-1]
    total = sums[:, :, 0, :].sum(axis=2)
    right = total[:, :, None, None] - left
    (gl, wl), (gr, wr), (g, w) = ((t[0] * QUANTUM, t[1] * QUANTUM) for t in (left, right, total))
    if fit.learner.newton:
        l2 = fit.learner.l2
        gain = gl * gl / (wl + l2) + gr * gr / (wr + l2) - (g * g / (w + l2))[:, None, None]
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = wl * wr / (wl + wr) * (gl / wl - gr / wr) ** 2
    fits = (wl >= fit.learner.min_weight) & (wr >= fit.learner.min_weight)
    gain = np.where(fits, gain, -np.inf).reshape(len(gain), -1)
    out = []
    for s, top in enumerate(gain.argmax(axis=1)):
        column, cut = divmod(int(top), BINS - 1)
        out.append((column, cut, left[:, s, column, cut], right[:, s, column, cut]) if gain[s, top] > 1e-9 else None)
    return out


def apply_splits(fit: Fit, trees: Trees, r: int, k: int, nodes: list[int], columns: np.ndarray, splits: list[tuple | None]) -> list[int]:
    """Enter the splits of ``nodes``; returns the children."""
    below = []
    for node, split in zip(nodes, splits, strict=True):
        if split is None:
            continue
        column, cut, *sides = split
        trees.feature[r, k, node], trees.bin[r, k, node] = columns[column], cut
        for child, sums in zip((2 * node + 1, 2 * node + 2), sides, strict=True):
            trees.value[r, k, child] = float(leaf_values(fit, np.asarray(sums)))
            below.append(child)
    return below


class Block:
    """Packed rows: keys, bins (rows x columns), labels and memberships (rows x fits)."""

    def __init__(self, row: dict, width: int):
        self.keys = np.frombuffer(row["key"], dtype=np.int64)
        self.bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(width, -1).T
        self.y = np.frombuffer(row["y"])
        self.members = np.frombuffer(row["members"], dtype=bool).reshape(len(self.keys), -1)

    def own(self, fit: Fit) -> np.ndarray:
        """Rows that a fit trains on."""
        return np.flatnonzero(self.members[:, fit.member])

    def drawn(self, fit: Fit, r: int, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that take part in a round of a fit, and what their margins (given for the fit's own rows) say."""
        own = self.own(fit)
        if fit.learner.rows >= 1:
            return own, expected(fit, margins)
        picked = np.flatnonzero(uniform(self.keys[own], fit.learner.seed, r) < fit.learner.rows)
        return own[picked], expected(fit, margins[picked])

    def sums(self, fit: Fit, trees: Trees, rows: np.ndarray, said: np.ndarray, r: int, k: int, nodes: list[int], level: int) -> np.ndarray:
        """Histogram of the rows that stand in ``nodes`` after ``level`` steps."""
        columns = columns_of(fit.learner, self.bins.shape[1], r, k)
        at = trees.route(self.bins, r, k, rows, level)
        place = np.full(2 ** (level + 1) - 1, -1)
        place[nodes] = np.arange(len(nodes))
        slot, weights = place[at], channels(fit, self.y[rows], said, k)
        here = np.flatnonzero(slot >= 0)
        if len(here) < len(slot):
            rows, slot, weights = rows[here], slot[here], np.take(weights, here, axis=1)
        return histogram(self.bins, rows, columns, slot, len(nodes), weights)


def first_margins(fit: Fit, n: int) -> np.ndarray:
    return np.tile(np.array(fit.start, dtype=float), (n, 1))


def grow_alone(fit: Fit, keys: np.ndarray, bins: np.ndarray, y: np.ndarray) -> Trees:
    """All trees of a fit from all its rows; ``bins`` holds a row per column."""
    trees, margins = Trees.empty(fit), first_margins(fit, len(keys))
    for r in range(fit.learner.rounds):
        drawn = slice(None) if fit.learner.rows >= 1 else np.flatnonzero(uniform(keys, fit.learner.seed, r) < fit.learner.rows)
        part, labels, said = bins if fit.learner.rows >= 1 else np.take(bins, drawn, axis=1), y[drawn], expected(fit, margins[drawn])     # a column's values stay side by side
        for k in range(fit.outputs):
            _grow_tree(fit, trees, r, k, part, channels(fit, labels, said, k))
        trees.add(margins, bins.T, fit, [r])
    return trees


def _grow_tree(fit: Fit, trees: Trees, r: int, k: int, bins: np.ndarray, weights: np.ndarray) -> None:
    """One tree from the drawn rows' bins (a row per column) and quanta.

    Splits need gradients and weights only. A third channel, which leaves need, is summed by node and not by column and bin.
    """
    columns, (width, n) = columns_of(fit.learner, len(bins), r, k), bins.shape
    values, rows, at = bins.ravel(), np.arange(n), np.zeros(n, dtype=np.int64)
    more, split_by = len(weights) > 2, weights[:2]
    sums, nodes = histogram(bins.T, None, columns, at, 1, split_by), [0]
    trees.value[r, k, 0] = float(leaf_values(fit, weights.sum(axis=1)))
    for level in range(fit.learner.depth):
        splits = best_splits(fit, sums)
        nodes = apply_splits(fit, trees, r, k, nodes, columns, splits)
        last = level + 1 == fit.learner.depth
        if not nodes or last and not more:
            return
        feature, own = trees.feature[r, k], np.arange(trees.feature.shape[2])
        leaf = feature < 0
        column, cut = np.where(leaf, 0, feature).astype(np.int64) * n, np.where(leaf, 256, trees.bin[r, k].astype(np.int16))
        at = np.where(leaf, own, 2 * own + 1)[at] + (values[column[at] + rows] > cut[at])
        if more:
            totals = np.stack([np.bincount(at, w, len(own)) for w in weights])
            for node in nodes:
                trees.value[r, k, node] = float(leaf_values(fit, totals[:, node]))
        if last:
            return
        # of two sisters the smaller is summed, the larger is what is left of their parent
        pairs = np.array(nodes).reshape(-1, 2)
        count = np.bincount(at, minlength=len(own))[pairs]
        lesser = (count[:, 1] < count[:, 0]).astype(int)
        place = np.full(len(own), -1)
        place[pairs[np.arange(len(pairs)), lesser]] = np.arange(len(pairs))
        slot = place[at]
        here = np.flatnonzero(slot >= 0)
        found = histogram(bins.T, here, columns, slot[here], len(pairs), np.take(split_by, here, axis=1))
        rest = sums[:, [s for s, split in enumerate(splits) if split is not None]] - found
        sums = np.empty((len(found), len(nodes), *found.shape[2:]), dtype=np.int64)
        sums[:, 2 * np.arange(len(pairs)) + lesser], sums[:, 2 * np.arange(len(pairs)) + 1 - lesser] = found, rest


# ------------------------------------------------------------------ tables
class Cuts:
    """Cut points per column; a value's bin is the number of cut points below it."""

    def __init__(self, features: list[str], points: list[list[float]]):
        self.features, self.points = features, [np.array(p) for p in points]

    def bins(self, table: pd.DataFrame) -> np.ndarray:
        out = np.empty((len(table), len(self.features)), dtype=np.uint8, order="F")
        for j, (name, points) in enumerate(zip(self.features, self.points, strict=True)):
            out[:, j] = np.searchsorted(points, table[name].to_numpy(dtype=float, na_value=np.nan), side="left")
        return out


def find_cuts(df: DataFrame, features: list[str], bins: int = BINS) -> Cuts:
    """Approximate quantiles of every column (a mergeable sketch per task; the error is an eighth of a bin)."""
    probabilities = [i / bins for i in range(1, bins)]
    quantiles = df.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(features, probabilities, 1 / (8 * bins))
    return Cuts(features, [sorted(set(q)) for q in quantiles])


BLOCK_SCHEMA = "block string, n int, key binary, bins binary, y binary, members binary"


def bin_rows(df: DataFrame, cuts: Cuts, key: str, label: Column, members: list[Column], block_rows: int | None = None) -> DataFrame:
    """Written blocks of the rows that train in some fit; ``members`` are boolean columns, one per fit."""
    rows = df.select(F.col(key).cast("long").alias("__key"), label.cast("double").alias("__y"),
                     F.array(*[F.coalesce(m, F.lit(False)) for m in members]).alias("__members"),
                     *[F.col(f).cast("double").alias(f) for f in cuts.features])
    rows = rows.filter("__key is not null and __y is not null and exists(__members, m -> m)")
    n, cores = rows.count(), df.sparkSession.sparkContext.defaultParallelism
    if not block_rows:      # some for every core
        block_rows = min(LARGE_BLOCK, BLOCK_ROWS, max(SMALL_BLOCK, math.ceil(n / (BLOCKS_A_CORE * cores))))
    parts = max(1, math.ceil(n / block_rows))

    def packed(table: pd.DataFrame) -> pd.DataFrame:
        members = np.stack(table["__members"].to_numpy()).astype(bool)
        return pd.DataFrame({"block": [uuid.uuid4().hex], "n": [len(table)], "key": [table["__key"].to_numpy(np.int64).tobytes()],
                             "bins": [cuts.bins(table).tobytes(order="F")], "y": [table["__y"].to_numpy(float).tobytes()], "members": [members.tobytes()]})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, size = [], 0
        for batch in batches:
            for start in range(0, len(batch), block_rows):
                part = batch.iloc[start:start + block_rows]
                if size + len(part) > block_rows:
                    yield packed(pd.concat(waiting))
                    waiting, size = [], 0
                if len(part):
                    waiting.append(part)
                    size += len(part)
        if waiting:
            yield packed(pd.concat(waiting))

    # fewer partitions without a shuffle: tasks read several of the input's
    blocks = rows.coalesce(parts).mapInPandas(run, BLOCK_SCHEMA)
    # the input may have fewer partitions than there are cores, or uneven ones: with a file per block, readers share them out by size
    return materialize(blocks, "blocks", 1)


def prepared(blocks: DataFrame, fits: list[Fit], width: int) -> list[Fit]:
    """The fits with their start margins and gradient unit, from one pass of counts and sums per membership."""
    wanted = sorted({(f.member, f.classes) for f in fits})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = Block(row, width)
                out = []
                for member, classes in wanted:
                    y = block.y[block.members[:, member]]
                    if classes:
                        out += [(member, k, float(n), 0.0, 0.0) for k, n in enumerate(np.bincount(y.astype(int), minlength=classes)[:classes])]
                    elif len(y):
                        out.append((member, -1, float(len(y)), float(y.min()), float(y.max())))
                        out.append((member, -2, math.fsum(y), 0.0, 0.0))
                yield pd.DataFrame(out, columns=["member", "kind", "total", "low", "high"])

    found = blocks.mapInPandas(run, "member int, kind int, total double, low double, high double") \
        .groupBy("member", "kind").agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    stats = {(r.member, r.kind): r for r in found}
    out = []
    for fit in fits:
        if fit.classes:
            counts = np.array([stats[fit.member, k].total if (fit.member, k) in stats else 0.0 for k in range(fit.classes)])
            n = counts.sum()
            start = np.zeros(fit.classes) if fit.learner.newton else np.log(np.maximum(counts, 1e-9) / max(n, 1))
            unit = 1.0
        else:
            n = stats[fit.member, -1].total if (fit.member, -1) in stats else 0.0
            mean = stats[fit.member, -2].total / n if n else 0.0
            reach = max(stats[fit.member, -1].high - mean, mean - stats[fit.member, -1].low) if n else 0.0
            unit = 2.0 ** math.ceil(math.log2(reach)) if reach > 0 else 1.0
            start = np.array([round(mean / unit * 2 ** 20) * unit / 2 ** 20])      # the same for sums in any order
        if not n:
            raise ValueError(f"{fit.name}: no row to train on")
        out.append(replace(fit, start=tuple(float(s) for s in start), unit=unit, rows=int(n)))
    return out


class Ensemble:
    """Fitted trees of a study with the cut points that they refer to; sized by rounds, classes and depth, never by rows."""

    def __init__(self, fits: list[Fit], trees: list[Trees], cuts: Cuts):
        self.fits, self.trees, self.cuts = fits, trees, cuts

    def predict(self, df: DataFrame, keep: list[str], names: list[str] | None = None) -> DataFrame:
        """``keep`` columns with (fit, output): the number, or the class probabilities, per row and fit."""
        sc = df.sparkSession.sparkContext
        chosen = [i for i, f in enumerate(self.fits) if names is None or f.name in names]
        shared = sc.broadcast(([self.fits[i] for i in chosen], [self.trees[i] for i in chosen], self.cuts))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fits, trees, cuts = shared.value
            for batch in batches:
                bins = cuts.bins(batch.select(cuts.features).to_pandas())
                for fit, t in zip(fits, trees, strict=True):
                    out = t.add(first_margins(fit, len(bins)), bins, fit, range(fit.learner.rounds))
                    if fit.classes:
                        out = np.exp(out - out.max(axis=1, keepdims=True))
                        out /= out.sum(axis=1, keepdims=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * fit.outputs), pa.array(out.ravel()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(f"__k{i}") for i in range(len(keep))), pa.array([fit.name] * len(out)), lists],
                                                     names=[*keep, "fit", "output"])

        fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
        rows = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], *[F.col(f).cast("double").alias(f) for f in self.cuts.features])
        return rows.mapInArrow(run, f"{fields}, fit string, output array<double>")


# ------------------------------------------------------------------ growing
def grow(spark: SparkSession, blocks: DataFrame, fits: list[Fit], cuts: Cuts, alone: int) -> Ensemble:
    """All fits, in lockstep over the blocks or, up to ``alone`` rows in all, each by its own task."""
    fits, width = prepared(blocks, fits, len(cuts.features)), len(cuts.features)
    few = blocks.agg(F.sum("n")).first()[0] <= alone
    return Ensemble(fits, _each_alone(spark, blocks, fits, width) if few else _in_lockstep(spark, blocks, fits, width), cuts)


def _each_alone(spark: SparkSession, blocks: DataFrame, fits: list[Fit], width: int) -> list[Trees]:
    order = sorted(range(len(fits)), key=lambda i: -fits[i].cost)       # the costliest fits first, one to a task

    def own(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                block = Block(row, width)
                for place, i in enumerate(order):
                    rows = block.own(fits[i])
                    if len(rows):
                        yield pd.DataFrame({"place": [place], "key": [block.keys[rows].tobytes()], "bins": [block.bins[rows].tobytes(order="F")],
                                            "y": [block.y[rows].tobytes()]})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = pd.concat(batches)
        if len(parts):
            i = order[parts["place"].iloc[0]]
            bins = np.concatenate([np.frombuffer(b, dtype=np.uint8).reshape(width, -1) for b in parts["bins"]], axis=1)
            t = grow_alone(fits[i], np.frombuffer(b"".join(parts["key"]), dtype=np.int64), bins, np.frombuffer(b"".join(parts["y"])))
            yield pd.DataFrame({"at": [i], "feature": [t.feature.tobytes()], "bin": [t.bin.tobytes()], "value": [t.value.tobytes()]})

    rows = blocks.mapInPandas(own, "place int, key binary, bins binary, y binary").repartitionById(len(fits), F.col("place"))
    out = {r["at"]: r for r in materialize(rows.mapInPandas(run, "at int, feature binary, bin binary, value binary"), "trees").collect()}    # one row per fit
    trees = []
    for i, fit in enumerate(fits):
        shape = Trees.empty(fit).feature.shape
        trees.append(Trees(np.frombuffer(out[i].feature, dtype=np.int16).reshape(shape), np.frombuffer(out[i].bin, dtype=np.uint8).reshape(shape),
                           np.frombuffer(out[i].value).reshape(shape)))
    return trees


HISTOGRAMS = "fit int, cls int, node int, sums binary"
SPLITS = "fit int, cls int, node int, place int, cut int, total array<long>, left array<long>, right array<long>"


def _histograms(blocks: DataFrame, shared: Broadcast, width: int, since: int, r: int, level: int) -> DataFrame:
    """One row per task, fit, class and node: the task's sums. ``shared`` holds the fits, their trees since the written margins, and the open nodes."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits, trees, nodes = shared.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                block = Block(row, width)
                margins = _margins(row, block, fits, trees, since, r)
                drawn = {}
                for (i, k), at in nodes.items():
                    if i not in drawn:
                        drawn[i] = block.drawn(fits[i], r, margins[i])
                    part = block.sums(fits[i], trees[i], *drawn[i], r, k, at, level)
                    sums[i, k] = sums[i, k] + part if (i, k) in sums else part
        for (i, k), total in sums.items():
            at = nodes[i, k]
            yield pd.DataFrame({"fit": i, "cls": k, "node": at, "sums": [total[:, s].tobytes() for s in range(len(at))]})

    return blocks.mapInPandas(run, HISTOGRAMS)


def _margins(row: dict, block: Block, fits: list[Fit], trees: list[Trees], since: int, r: int) -> list[np.ndarray]:
    """Each fit's margins of its own rows before round r: the written ones and the rounds since."""
    out, at = [], 0
    written = np.frombuffer(row["margins"]) if row.get("margins") else None
    for fit, t in zip(fits, trees, strict=True):
        own = block.own(fit)
        size = len(own) * fit.outputs
        margins = first_margins(fit, len(own)) if written is None else written[at:at + size].reshape(-1, fit.outputs).copy()
        at += size
        out.append(t.add(margins, block.bins, fit, range(since, min(r, fit.learner.rounds)), own))
    return out


def _choose(histograms: DataFrame, fits: list[Fit], width: int, r: int) -> DataFrame:
    """Add up tasks' sums by (fit, class, node) and split each node; a task holds one sum per key."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for i, k, node, blob in zip(batch["fit"], batch["cls"], batch["node"], batch["sums"], strict=True):
                part = np.frombuffer(blob, dtype=np.int64)
                sums[i, k, node] = sums[i, k, node] + part if (i, k, node) in sums else part
        out = []
        for (i, k, node), total in sums.items():
            table = total.reshape(-1, 1, len(columns_of(fits[i].learner, width, r, k)), BINS)
            split = best_splits(fits[i], table)[0]
            place, cut, left, right = split or (-1, -1, [], [])
            out.append((i, k, node, place, cut, table[:, 0, 0].sum(axis=1).tolist(), list(map(int, left)), list(map(int, right))))
        yield pd.DataFrame(out, columns=["fit", "cls", "node", "place", "cut", "total", "left", "right"])

    return histograms.repartition("fit", "cls", "node").mapInPandas(run, SPLITS)


def _in_lockstep(spark: SparkSession, blocks: DataFrame, fits: list[Fit], width: int) -> list[Trees]:
    trees = [Trees.empty(f) for f in fits]
    state, since = blocks, 0
    for r in range(max(f.learner.rounds for f in fits)):
        if r and r % KEEP == 0:
            state, since = _written(state, fits, trees, width, since, r), r
        nodes = {(i, k): [0] for i, f in enumerate(fits) if r < f.learner.rounds for k in range(f.outputs)}
        for level in range(max(fits[i].learner.depth for i, _ in nodes)):
            nodes = {(i, k): at for (i, k), at in nodes.items() if at and level < fits[i].learner.depth}
            if not nodes:
                break
            shared = spark.sparkContext.broadcast((fits, [t.rounds(since, r + 1) for t in trees], nodes))
            rows = _choose(_histograms(state, shared, width, since, r, level), fits, width, r).collect()     # a row per node
            shared.destroy()
            found = {(s.fit, s.cls, s.node): s for s in rows}
            for (i, k), at in nodes.items():
                splits = []
                for node in at:
                    s = found[i, k, node]
                    if node == 0:
                        trees[i].value[r, k, 0] = float(leaf_values(fits[i], np.array(s.total)))
                    splits.append((s.place, s.cut, np.array(s.left), np.array(s.right)) if s.place >= 0 else None)
                nodes[i, k] = apply_splits(fits[i], trees[i], r, k, at, columns_of(fits[i].learner, width, r, k), splits)
    return trees


def _written(state: DataFrame, fits: list[Fit], trees: list[Trees], width: int, since: int, r: int) -> DataFrame:
    """Blocks with the margins before round r, written; the state before is deleted (its rounds are in the new one)."""
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast((fits, [t.rounds(since, r) for t in trees]))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits, trees = shared.value
        for batch in batches:
            for row in batch.to_dict("records"):
                margins = _margins(row, Block(row, width), fits, trees, since, r)
                yield pd.DataFrame([{**row, "margins": b"".join(m.tobytes() for m in margins)}])

    folder = f"{ensure_checkpoint_dir(spark)}/tables/margins-{uuid.uuid4().hex[:12]}"
    state.mapInPandas(run, BLOCK_SCHEMA + ", margins binary").write.option("maxRecordsPerFile", 1).parquet(folder)
    shared.destroy()
    if "margins" in state.columns:
        old = spark._jvm.org.apache.hadoop.fs.Path(state.inputFiles()[0]).getParent()
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.parquet(folder)


def fit_many(df: DataFrame, features: list[str], label: Column, fits: dict[str, tuple[Learner, Column]], classes: int = 0,
             key: str = "reading_id", block_rows: int | None = None, cuts: Cuts | None = None) -> Ensemble:
    """Fit every named (learner, rows to train on); ``label`` is a class number (``classes`` of them) or, with none, a number."""
    guard_names(features)
    cuts = cuts or find_cuts(df, features)
    seen: dict[str, int] = {}
    members, out = [], []
    for name, (learner, rows) in fits.items():
        place = seen.setdefault(str(rows), len(members))
        if place == len(members):
            members.append(rows)
        out.append(Fit(name, learner, place, classes))
    return grow(df.sparkSession, bin_rows(df, cuts, key, label, members, block_rows), out, cuts, block_rows or BLOCK_ROWS)
