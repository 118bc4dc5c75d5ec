"""Survey statistics V1-V33: descriptives, all-pairs association, reliability, factors.

Row-level work (unpivots, pair explosion, rank lookup) runs on Spark in one
pass each; everything after the first aggregate is a table with one row per
item, cell or pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi2_sf_udf, fisher_udf, t_two_sided_udf
from ..functions.stats import quantile_columns, value_histogram
from ..functions.text import p_value_text, stars
from ..plans.ordering import weighted_prefix
from ..schema import DEMO_LABELS, DEMOGRAPHICS, INDICES, LIKERT_ITEMS, SURVEY_VARS
from ..session import materialize

# Effect-size scales (upper bounds and labels).
V_SCALES = {
    "strength": [(0.10, "Despreciable"), (0.20, "Débil"), (0.40, "Moderada"), (0.60, "Fuerte"), (None, "Muy fuerte")],
    "graded": [(0.10, "Negligible"), (0.20, "Débil"), (0.30, "Moderado"), (0.40, "Moderado-fuerte"), (None, "Fuerte")],
    "cohen": [(0.10, "Negligible"), (0.30, "Small"), (0.50, "Moderate"), (None, "Large")],
}
BIN_LABELS = ["Desacuerdo", "Neutro", "Acuerdo"]


def _long(df: DataFrame, items: list[str], id_cols: list[str] | None = None) -> DataFrame:
    return df.select(*(id_cols or []), *items).unpivot(id_cols or [], items, "item", "value")


# ---------------------------------------------------------------- descriptives
def moments(df: DataFrame, items: list[str] | None = None) -> DataFrame:
    """V1 / V4: n, mean, sd (ddof 1), min, max, skewness and excess kurtosis (population)."""
    items = items or LIKERT_ITEMS
    agg = df.agg(*[F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
                            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
                            F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt")).alias(c)
                   for c in items])
    return agg.unpivot([], items, "item", "m").select("item", "m.*")


def skew_flags(df: DataFrame, items: list[str] | None = None) -> DataFrame:
    """V1: skewness, kurtosis and the direction flag at +-0.5."""
    m = moments(df, items)
    flag = (F.when(F.col("skew") < -0.5, "negativa (sesgo izq.)")
             .when(F.col("skew") > 0.5, "positiva (sesgo der.)").otherwise("simétrica"))
    return m.select("item", F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"), flag.alias("direction"))


def item_descriptives(df: DataFrame, items: list[str] | None = None) -> DataFrame:
    """V4: mean, sd, median, min, max, skew, kurt per item."""
    items = items or LIKERT_ITEMS
    med = quantile_columns(df, items, {"median": 0.5}).withColumnRenamed("variable", "item")
    return moments(df, items).join(med, "item").select(
        "item", F.col("n").cast("long").alias("n"),
        *[F.round(c, 6).alias(c) for c in ["mean", "sd", "median", "min", "max", "skew", "kurt"]])


def iqr_outliers(df: DataFrame, items: list[str] | None = None) -> DataFrame:
    """V2: Tukey fences from exact quartiles and the count outside them."""
    items = items or LIKERT_ITEMS
    q = (quantile_columns(df, items, {"q1": 0.25, "q3": 0.75}).withColumnRenamed("variable", "item")
         .withColumn("lower", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
         .withColumn("upper", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    # one row per item: a bounded broadcast
    hits = (_long(df, items).join(F.broadcast(q), "item")
            .groupBy("item").agg(F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
                                 .alias("n_outliers")))
    return q.join(hits, "item").select("item", *[F.round(c, 6).alias(c) for c in ["q1", "q3", "lower", "upper"]],
                                       F.col("n_outliers").cast("long").alias("n_outliers"))


def demographic_profile(df: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """V3: code, label, n and % for each demographic variable."""
    variables = variables or DEMOGRAPHICS
    counts = _long(df, variables).groupBy("item", "value").agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1)).alias("_t"))
    labels = df.sparkSession.createDataFrame(
        [(v, k, lab) for v, m in DEMO_LABELS.items() for k, lab in m.items()], "item string, value int, label string")
    return (counts.crossJoin(F.broadcast(total)).join(F.broadcast(labels), ["item", "value"], "left")
                  .select(F.col("item").alias("variable"), F.col("value").alias("code"),
                          F.coalesce("label", F.col("value").cast("string")).alias("label"),
                          "n", F.round(F.col("n") * 100.0 / F.col("_t"), 6).alias("pct")))


def frequency_table(df: DataFrame, items: list[str] | None = None, categories=(1, 2, 3, 4, 5)) -> DataFrame:
    """V5: item x category counts and %, zero cells kept (wide)."""
    items = items or LIKERT_ITEMS
    cats = list(categories)
    wide = (_long(df, items).groupBy("item").pivot("value", cats).agg(F.count(F.lit(1))).fillna(0))
    total = sum(F.col(str(c)) for c in cats)
    return wide.select("item", *[F.col(str(c)).cast("long").alias(f"n_{c}") for c in cats],
                       *[F.round(F.col(str(c)) * 100.0 / total, 6).alias(f"pct_{c}") for c in cats])


def items_by_mean(df: DataFrame, items: list[str] | None = None) -> DataFrame:
    """V6: items ordered by mean (ascending) with their sd and rank."""
    m = moments(df, items)
    return m.select("item", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"),
                    F.row_number().over(_small_order(F.col("mean"), F.col("item"))).alias("rank"))


def _small_order(*cols: Column):
    # ranking over a result with one row per item: a single small partition by design
    return Window.orderBy(*cols)


def diverging_layout(df: DataFrame, items: list[str] | None = None) -> DataFrame:
    """V7: per item and category the % and the left/right extents of a neutral-centred bar."""
    freq = frequency_table(df, items)
    cats = [1, 2, 3, 4, 5]
    start = -(F.col("pct_1") + F.col("pct_2") + F.col("pct_3") / 2)
    rows = []
    for c in cats:
        left = start + sum((F.col(f"pct_{k}") for k in cats if k < c), F.lit(0.0))
        rows.append(F.struct(F.lit(c).alias("category"), F.col(f"pct_{c}").alias("pct"),
                             left.alias("left"), (left + F.col(f"pct_{c}")).alias("right")))
    agree = F.col("pct_4") + F.col("pct_5")
    out = freq.select("item", agree.alias("agree_pct"), F.explode(F.array(*rows)).alias("r"))
    return out.select("item", F.round("agree_pct", 6).alias("agree_pct"), "r.category",
                      F.round("r.pct", 6).alias("pct"), F.round("r.left", 6).alias("left"),
                      F.round("r.right", 6).alias("right"))


def box_counts(df: DataFrame, items: list[str] | None = None, top: int = 4, bottom: int = 2) -> DataFrame:
    """V8: top-box (>= 4) and bottom-box (<= 2) counts and % per item."""
    items = items or LIKERT_ITEMS
    g = _long(df, items).groupBy("item").agg(
        F.count_if(F.col("value") >= top).alias("n_top"), F.count_if(F.col("value") <= bottom).alias("n_bottom"),
        F.count(F.lit(1)).alias("_n"))
    return g.select("item", "n_top", F.round(F.col("n_top") * 100.0 / F.col("_n"), 6).alias("pct_top"),
                    "n_bottom", F.round(F.col("n_bottom") * 100.0 / F.col("_n"), 6).alias("pct_bottom"))


def with_indices(df: DataFrame, indices: dict | None = None) -> DataFrame:
    """V9: composite indices as row means (reversed items scored 6 - x)."""
    indices = indices or INDICES
    cols = []
    for name, (items, reverse) in indices.items():
        terms = [(6 - F.col(c)) if reverse else F.col(c) for c in items]
        cols.append((sum(terms) / len(items)).cast("double").alias(name))
    return df.select("*", *cols)


def index_stats(df: DataFrame, indices: dict | None = None) -> DataFrame:
    """V9: mean, sd, median, min, max of each composite index."""
    indices = indices or INDICES
    names = list(indices)
    scored = with_indices(df, indices)
    med = quantile_columns(scored, names, {"median": 0.5}).withColumnRenamed("variable", "item")
    m = scored.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
                              F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in names])
    return (m.unpivot([], names, "item", "m").select("item", "m.*").join(med, "item")
             .select(F.col("item").alias("index"), *[F.round(c, 6).alias(c) for c in ["mean", "sd", "median", "min", "max"]]))


def agreement_bin(col: Column | str) -> Column:
    """Right-closed cuts (0,2], (2,3], (3,5] -> Desacuerdo / Neutro / Acuerdo."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.when((c > 0) & (c <= 2), BIN_LABELS[0]).when((c > 2) & (c <= 3), BIN_LABELS[1])
             .when((c > 3) & (c <= 5), BIN_LABELS[2]))


def crosstab_margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """V10 + V11: binned cross-tab of two items with 'All' margins (cube)."""
    binned = df.select(agreement_bin(a).alias("row_cat"), agreement_bin(b).alias("col_cat")) \
               .filter(F.col("row_cat").isNotNull() & F.col("col_cat").isNotNull())
    cube = binned.cube("row_cat", "col_cat").agg(F.count(F.lit(1)).alias("n"),
                                                  F.grouping_id().alias("_g"))
    return cube.select(F.lit(a).alias("row_item"), F.lit(b).alias("col_item"),
                       F.coalesce("row_cat", F.lit("All")).alias("row_cat"),
                       F.coalesce("col_cat", F.lit("All")).alias("col_cat"), "n")


def contradiction(df: DataFrame, pairs: list[tuple[str, str]], cut: int = 4) -> DataFrame:
    """Joint agreement (a >= 4 and b >= 4) n and %, and the mean difference per pair."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for a, b in pairs:
        aggs += [F.count_if((F.col(a) >= cut) & (F.col(b) >= cut)).alias(f"{a}_{b}_n"),
                 (F.avg(a) - F.avg(b)).alias(f"{a}_{b}_d")]
    agg = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("item_a"), F.lit(b).alias("item_b"), F.col(f"{a}_{b}_n").alias("n_both"),
                     F.col(f"{a}_{b}_d").alias("mean_diff")) for a, b in pairs]
    return agg.select("_n", F.explode(F.array(*rows)).alias("r")).select(
        "r.item_a", "r.item_b", "r.n_both", F.round(F.col("r.n_both") * 100.0 / F.col("_n"), 6).alias("pct_both"),
        F.round("r.mean_diff", 6).alias("mean_diff"))


# ------------------------------------------------------ all-pairs association
def all_pairs(variables: list[str]) -> list[tuple[str, str]]:
    return list(combinations(variables, 2))


def cross_pairs(left: list[str], right: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in left for b in right]


class PairCounts:
    """Counts of level pairs of many variables, from products of one-hot matrices."""

    def __init__(self, n_variables: int, pairs: list[tuple[int, int]]):
        self.pairs = pairs
        self.places: list[dict[int, int]] = [{} for _ in range(n_variables)]       # level -> its place among the variable's levels
        self.counts: dict[tuple[int, int], np.ndarray] = {}

    def add(self, columns: list[np.ndarray], known: list[np.ndarray]) -> None:
        """One batch: a Gram matrix of the one-hot columns holds every pair's table."""
        blocks = []
        for places, values, there in zip(self.places, columns, known, strict=True):
            levels, at = np.unique(values[there], return_inverse=True)
            spots = np.array([places.setdefault(int(v), len(places)) for v in levels], dtype=int)
            hot = np.zeros((len(values), len(places)), dtype=np.float32)
            hot[np.flatnonzero(there), spots[at]] = 1       # a null has no level
            blocks.append(hot)
        starts = np.cumsum([0, *(b.shape[1] for b in blocks)])
        hot = np.concatenate(blocks, axis=1)
        gram = (hot.T @ hot).astype(np.int64)               # exact: a batch has fewer than 2^24 rows
        for a, b in self.pairs:
            part = gram[starts[a]:starts[a + 1], starts[b]:starts[b + 1]]
            total = np.zeros(part.shape, dtype=np.int64)
            if (a, b) in self.counts:
                before = self.counts[a, b]
                total[:before.shape[0], :before.shape[1]] = before
            self.counts[a, b] = total + part

    def rows(self) -> pd.DataFrame:
        out = []
        for number, (a, b) in enumerate(self.pairs):
            table = self.counts.get((a, b))
            if table is not None:
                left, right = list(self.places[a]), list(self.places[b])
                out += [(number, left[i], right[j], int(table[i, j])) for i, j in zip(*np.nonzero(table))]
        return pd.DataFrame(out, columns=["pair", "v1", "v2", "n"])


PAIR_BATCH = 100_000    # rows of one product


def pair_contingency(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(var1, var2, v1, v2, n) for every pair in ONE scan.

    Each Arrow batch becomes a one-hot matrix of all variables' levels; its
    Gram matrix holds the tables of all pairs. A task adds its batches up and
    the shuffle carries at most pairs x cells rows per task.
    """
    names = sorted({v for p in pairs for v in p})
    places = [(names.index(a), names.index(b)) for a, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PairCounts(len(names), places)
        for batch in batches:
            for start in range(0, batch.num_rows, PAIR_BATCH):
                part = batch.slice(start, PAIR_BATCH)
                known = [c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns]
                counts.add([c.fill_null(0).to_numpy(zero_copy_only=False) for c in part.columns], known)
        yield pa.RecordBatch.from_pandas(counts.rows().astype({"pair": "int32", "v1": "int32", "v2": "int32", "n": "int64"}), preserve_index=False)

    partial = df.select(*[F.col(v).cast("int").alias(f"c{i}") for i, v in enumerate(names)]).mapInArrow(run, "pair int, v1 int, v2 int, n long")
    counts = partial.groupBy("pair", "v1", "v2").agg(F.sum("n").alias("n"))
    sides = [F.get(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair")) for side in (0, 1)]
    return counts.select(sides[0].alias("var1"), sides[1].alias("var2"), "v1", "v2", "n")


def chi_square(ct: DataFrame, yates: bool = True) -> DataFrame:
    """Chi-square of independence per pair over the full grid of observed levels.

    Zero cells count (expected = row total x column total / n); Yates'
    correction shrinks |o - e| by min(.5, |o - e|) when dof = 1. The table of
    counts is written once, as it is joined with its own margins.
    """
    k = ["var1", "var2"]
    ct = materialize(ct, "pair-counts")
    rows = ct.groupBy(*k, "v1").agg(F.sum("n").alias("r_tot"))
    cols = ct.groupBy(*k, "v2").agg(F.sum("n").alias("c_tot"))
    tot = ct.groupBy(*k).agg(F.sum("n").alias("n_total"), F.countDistinct("v1").alias("r"),
                             F.countDistinct("v2").alias("k"))
    cells = (rows.join(cols, k).join(ct, [*k, "v1", "v2"], "left").fillna(0, subset=["n"]).join(tot, k)
                 .withColumn("dof", (F.col("r") - 1) * (F.col("k") - 1))
                 .withColumn("e", F.col("r_tot").cast("double") * F.col("c_tot") / F.col("n_total")))
    diff = F.abs(F.col("n") - F.col("e"))
    adj = F.when((F.col("dof") == 1) & F.lit(yates), diff - F.least(F.lit(0.5), diff)).otherwise(diff)
    # cell positions inside the pair's grid (a table of pairs x cells rows)
    from pyspark.sql import Window
    cells = (cells.withColumn("_i", F.dense_rank().over(Window.partitionBy(*k).orderBy("v1")))
                  .withColumn("_j", F.dense_rank().over(Window.partitionBy(*k).orderBy("v2"))))
    corner = lambda i, j: F.sum(F.when((F.col("_i") == i) & (F.col("_j") == j), F.col("n"))).cast("long")
    return cells.groupBy(*k, "n_total", "r", "k", "dof").agg(
        F.sum(adj * adj / F.col("e")).alias("chi2"), F.min("e").alias("min_expected"),
        corner(1, 1).alias("c11"), corner(1, 2).alias("c12"), corner(2, 1).alias("c21"), corner(2, 2).alias("c22"))


def cramers_v(tests: DataFrame) -> DataFrame:
    """Plain and bias-corrected Cramér's V from the chi-square table."""
    n, r, k, chi2 = F.col("n_total"), F.col("r"), F.col("k"), F.col("chi2")
    plain = F.sqrt(F.try_divide(chi2, n * (F.least(r, k) - 1)))
    phi2c = F.greatest(F.lit(0.0), chi2 / n - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    denom = F.least(kc - 1, rc - 1)
    corrected = F.when(denom > 0, F.sqrt(phi2c / denom)).otherwise(F.lit(0.0))
    return tests.withColumn("v_plain", plain).withColumn("v_corrected", corrected)


def strength(v: Column | str, scale: str = "strength") -> Column:
    """Effect-size label on one of the three scales."""
    c = F.col(v) if isinstance(v, str) else v
    expr = None
    for bound, label in V_SCALES[scale]:
        if bound is None:
            return expr.otherwise(label)
        expr = F.when(c < bound, label) if expr is None else expr.when(c < bound, label)
    return expr


def pair_tests(df: DataFrame, pairs: list[tuple[str, str]], yates: bool = True) -> DataFrame:
    """Contingency, chi-square, p (chi-square or Fisher), both V's, labels, stars."""
    t = cramers_v(chi_square(pair_contingency(df, pairs), yates)).filter((F.col("r") >= 2) & (F.col("k") >= 2))
    use_fisher = (F.col("min_expected") < 5) & (F.col("r") == 2) & (F.col("k") == 2)
    p_chi = chi2_sf_udf(F.col("chi2"), F.col("dof"))
    # Python functions run before the CASE: pairs that need no exact test pass nulls and return at once
    p_fisher = fisher_udf(*[F.when(use_fisher, F.col(c)) for c in ("c11", "c12", "c21", "c22")])
    out = (t.withColumn("test", F.when(use_fisher, "Fisher").otherwise("Chi²"))
            .withColumn("p_value", F.when(use_fisher, p_fisher).otherwise(p_chi))
            .withColumn("chi2_reported", F.when(use_fisher, F.lit(None).cast("double")).otherwise(F.col("chi2"))))
    return out.select("var1", "var2", "n_total", "r", "k", "dof", "chi2", "chi2_reported", "min_expected", "test",
                      "p_value", "v_plain", "v_corrected",
                      strength("v_corrected", "strength").alias("strength"),
                      strength("v_plain", "graded").alias("strength_graded"),
                      strength("v_plain", "cohen").alias("magnitude"),
                      stars("p_value").alias("stars"), p_value_text("p_value").alias("p_text"))


def fisher_by_group(df: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Exact p of the 2 x 2 table of two variables coded 1 and 2, per group; only where an expected count is below 5."""
    cell = lambda i, j: F.count_if((F.col(a) == i) & (F.col(b) == j)).alias(f"c{i}{j}")
    t = df.groupBy(group).agg(cell(1, 1), cell(1, 2), cell(2, 1), cell(2, 2))
    rows, cols = [F.col("c11") + F.col("c12"), F.col("c21") + F.col("c22")], [F.col("c11") + F.col("c21"), F.col("c12") + F.col("c22")]
    least = F.least(*rows).cast("double") * F.least(*cols) / (rows[0] + rows[1])
    t = t.withColumn("min_expected", least).filter((F.least(*rows) > 0) & (F.least(*cols) > 0) & (least < 5))
    return t.withColumn("p_value", fisher_udf("c11", "c12", "c21", "c22")).withColumn("stars", stars("p_value"))


#: The three sets of thresholds (p below, V at least) and the V they read.
SIGNIFICANT = {"moderate": (0.05, 0.20, "v_corrected"), "strong": (0.001, 0.40, "v_plain"), "excellent": (0.001, 0.30, "v_plain")}


def significant_pairs(tests: DataFrame, p_max: float = 0.05, v_min: float = 0.20,
                      v_col: str = "v_corrected") -> DataFrame:
    """Pairs with p < p_max and V >= v_min."""
    return tests.filter((F.col("p_value") < p_max) & (F.col(v_col) >= v_min))


def significant_sets(tests: DataFrame) -> DataFrame:
    """The pairs of every threshold set, numbered from the strongest; a pair stands once per set that holds it."""
    sets = F.array(*[F.when((F.col("p_value") < p) & (F.col(v) >= low), F.struct(F.lit(name).alias("set"), F.col(v).alias("v")))
                     for name, (p, low, v) in SIGNIFICANT.items()])
    rows = tests.select("var1", "var2", "chi2", "dof", "p_value", F.inline(F.filter(sets, lambda x: x.isNotNull())))
    place = F.row_number().over(Window.partitionBy("set").orderBy(F.desc("v"), "var1", "var2"))     # a row per pair
    return rows.select("set", place.alias("place"), "var1", "var2", "chi2", "dof", "v", stars("p_value").alias("stars"), p_value_text("p_value").alias("p_text"))


def top_pairs(tests: DataFrame, by: str = "v_plain", k: int = 10) -> DataFrame:
    """The k strongest pairs (ties broken by names) -- a top-k report."""
    return tests.orderBy(F.desc(by), "var1", "var2").limit(k)


def top_significant_pairs(tests: DataFrame, p_max: float, v_min: float, by: str = "v_plain", k: int = 10) -> DataFrame:
    """The k strongest of the pairs that pass both limits; of all pairs where none passes (``filtered`` tells which)."""
    passes = F.coalesce((F.col("p_value") < p_max) & (F.col("v_plain") >= v_min), F.lit(False))
    rows = materialize(tests.withColumn("filtered", passes), "pair-tests")      # a row per pair
    some = rows.filter("filtered").limit(1).count() > 0
    return top_pairs(rows.filter("filtered") if some else rows, by, k)


def association_graph(tests: DataFrame, v_min: float = 0.40, v_col: str = "v_plain") -> tuple[DataFrame, DataFrame]:
    """Edges with V >= v_min and the degree of every node."""
    edges = tests.filter(F.col(v_col) >= v_min).select("var1", "var2", F.col(v_col).alias("v"))
    ends = edges.select(F.col("var1").alias("node")).unionByName(edges.select(F.col("var2").alias("node")))
    return edges, ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


# ------------------------------------------------------------- reliability
def cronbach_alpha(df: DataFrame, items: list[str] | None = None, deleted: bool = True) -> DataFrame:
    """Alpha of the scale and alpha if each item is deleted, one aggregate."""
    items = items or LIKERT_ITEMS
    k = len(items)
    total = sum(F.col(c) for c in items)
    aggs = [F.var_samp(c).alias(f"var_{c}") for c in items] + [F.var_samp(total).alias("var_total")]
    if deleted:
        aggs += [F.var_samp(total - F.col(c)).alias(f"var_wo_{c}") for c in items]
    agg = df.agg(*aggs)
    sum_var = sum(F.col(f"var_{c}") for c in items)
    alpha = (F.lit(k / (k - 1)) * (1 - sum_var / F.col("var_total")))
    out = agg.select(alpha.alias("alpha"), *[F.col(c) for c in agg.columns])
    if not deleted:
        return out.select(F.round("alpha", 6).alias("alpha"), reliability_label("alpha").alias("label"))
    rows = []
    for c in items:
        rest = sum((F.col(f"var_{o}") for o in items if o != c), F.lit(0.0))
        a_wo = F.lit((k - 1) / (k - 2)) * (1 - rest / F.col(f"var_wo_{c}"))
        rows.append(F.struct(F.lit(c).alias("item"), a_wo.alias("alpha_if_deleted")))
    return out.select("alpha", F.explode(F.array(*rows)).alias("r")).select(
        "r.item", F.round("alpha", 6).alias("alpha"), F.round("r.alpha_if_deleted", 6).alias("alpha_if_deleted"),
        F.round(F.col("r.alpha_if_deleted") - F.col("alpha"), 6).alias("delta"),
        (F.col("r.alpha_if_deleted") - F.col("alpha") > 0.01).alias("consider_removal"),
        reliability_label("alpha").alias("label"))


def reliability_label(alpha: str) -> Column:
    # Lower bounds and words.
    a = F.col(alpha)
    return (F.when(a >= 0.90, "excelente").when(a >= 0.80, "buena").when(a >= 0.70, "aceptable")
             .when(a >= 0.60, "cuestionable").otherwise("inaceptable"))


def index_alphas(df: DataFrame, indices: dict | None = None) -> DataFrame:
    """Alpha of the items behind each composite index."""
    indices = indices or INDICES
    out = None
    for name, (items, _) in indices.items():
        a = cronbach_alpha(df, items, deleted=False).select(F.lit(name).alias("index"), "alpha", "label")
        out = a if out is None else out.unionByName(a)
    return out


# ------------------------------------------------------------- correlation
def average_ranks(df: DataFrame, items: list[str]) -> DataFrame:
    """(variable, value, rank): 1-based average rank of each distinct value (ties share it)."""
    hist = value_histogram(df, items)
    cum = weighted_prefix(hist, ["variable"], "value", "n")
    return cum.select("variable", "value", (F.col("cum_before") + (F.col("n") + 1) / 2.0).alias("rank"))


def correlation_pairs(df: DataFrame, items: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(var1, var2, r, n) for every item pair.

    Pearson is one aggregate over the rows. Spearman puts the average ranks on
    the pair contingency (cells, not rows) and takes the weighted correlation,
    centred first so that large counts do not cancel.
    """
    items = items or LIKERT_ITEMS
    pairs = all_pairs(items)
    if method == "spearman":
        total = df.agg(F.count(F.lit(1)).alias("n_all"))
        ranks = average_ranks(df, items).withColumn("value", F.col("value").cast("int"))
        cells = pair_contingency(df, pairs)
        for side in ("1", "2"):
            cells = cells.join(ranks.select(F.col("variable").alias(f"var{side}"), F.col("value").alias(f"v{side}"),
                                            F.col("rank").alias(f"x{side}")), [f"var{side}", f"v{side}"])
        weight, pair = F.col("n"), ["var1", "var2"]
        means = cells.groupBy(*pair).agg(*[(F.sum(weight * F.col(x)) / F.sum(weight)).alias(f"m{x}") for x in ("x1", "x2")])
        a, b = F.col("x1") - F.col("mx1"), F.col("x2") - F.col("mx2")
        sums = cells.join(means, pair).groupBy(*pair).agg(F.sum(weight * a * b).alias("ab"), F.sum(weight * a * a).alias("aa"),
                                                          F.sum(weight * b * b).alias("bb"))
        return sums.crossJoin(F.broadcast(total)).select(*pair, F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))).alias("r"),
                                                         F.col("n_all").alias("n"))
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}") for a, b in pairs])
    rows = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs]
    return agg.select("_n", F.explode(F.array(*rows)).alias("x")).select("x.var1", "x.var2", "x.r",
                                                                         F.col("_n").alias("n"))


def spearman_tests(df: DataFrame, items: list[str] | None = None) -> DataFrame:
    """Spearman r, p (t with n-2 dof), stars, strong and collinear flags."""
    c = correlation_pairs(df, items, "spearman")
    r, n = F.col("r"), F.col("n")
    t = r * F.sqrt((n - 2) / F.greatest(F.lit(1e-300), 1 - r * r))
    p = F.when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(t_two_sided_udf(t, n - 2))
    out = c.withColumn("p_value", p)
    return out.select("var1", "var2", F.round("r", 6).alias("r"), "n", "p_value", stars("p_value").alias("stars"),
                      ((F.abs("r") >= 0.40) & (F.col("p_value") < 0.05)).alias("strong"),
                      F.when(F.abs("r") >= 0.60, "fuerte").when(F.abs("r") >= 0.40, "moderada").alias("magnitude"),
                      (F.abs("r") >= 0.80).alias("collinear"))


# ------------------------------------------------------------- factor structure
def correlation_matrix(df: DataFrame, items: list[str] | None = None) -> tuple[np.ndarray, int]:
    """The p x p Pearson matrix computed by one Spark aggregate (p = number of items)."""
    items = items or LIKERT_ITEMS
    rows = correlation_pairs(df, items).collect()  # p(p-1)/2 rows: bounded by the item count
    idx = {c: i for i, c in enumerate(items)}
    mat = np.eye(len(items))
    n = 0
    for row in rows:
        i, j = idx[row["var1"]], idx[row["var2"]]
        mat[i, j] = mat[j, i] = row["r"]
        n = row["n"]
    return mat, n


def factor_summary(df: DataFrame, items: list[str] | None = None) -> dict:
    """KMO, Bartlett sphericity, eigenvalues, Kaiser count, loadings."""
    from ..functions.distributions import chi2_sf
    items = items or LIKERT_ITEMS
    R, n = correlation_matrix(df, items)
    p = len(items)
    inv = np.linalg.inv(R)
    d = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    partial = -inv / d
    off = ~np.eye(p, dtype=bool)
    r2, q2 = (R[off] ** 2).sum(), (partial[off] ** 2).sum()
    kmo = r2 / (r2 + q2)
    chi2 = -(n - 1 - (2 * p + 5) / 6.0) * np.log(np.linalg.det(R))
    dof = p * (p - 1) // 2
    p_b = chi2_sf(float(chi2), dof)
    vals, vecs = np.linalg.eigh(R)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    n_kaiser = int((vals > 1).sum())
    loadings = vecs[:, :n_kaiser] * np.sqrt(vals[:n_kaiser])
    loadings *= np.where(loadings.sum(axis=0) < 0, -1.0, 1.0)
    ss = (loadings ** 2).sum(axis=0)
    return {"items": items, "n": n, "kmo": float(kmo), "bartlett_chi2": float(chi2), "bartlett_dof": dof,
            "bartlett_p": p_b, "eigenvalues": vals.tolist(), "n_kaiser": n_kaiser, "loadings": loadings,
            "ss": ss, "proportion": ss / p, "cumulative": np.cumsum(ss / p)}


def kmo_label(kmo: float) -> str:
    # Lower bounds and words.
    return ("meritorious" if kmo >= 0.80 else "middling" if kmo >= 0.70
            else "mediocre" if kmo >= 0.60 else "unacceptable")
