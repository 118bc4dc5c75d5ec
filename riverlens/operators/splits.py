"""Splits, resampling and scaling P1-P12.

Every split is a deterministic function of the row key and a seed, so reruns,
retried tasks and different partition counts give the same rows. Exact "first
x %" cuts use ``sections``: the cut values are found by counting, and rows tag
themselves in place; no feature column is shuffled or copied. Hash order is
that of md5, which SQL engines share, so an oracle can name the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import sections


def _hash_order(key: str, seed: int, salt: int = 0) -> Column:
    """60 leading bits of md5("key:seed:salt")."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)), F.lit(str(salt))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _tie(key: str) -> Column:
    return F.col(key).cast("long")


def _counts(df: DataFrame, by: list[str], name: str = "_cnt") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def stratified_split(df: DataFrame, label: str, key: str = "reading_id", test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Exact per-class split; ``split`` = train for the first ceil(0.8 n_c) rows in hash order."""
    sizes = F.array(F.ceil(F.col("n") * (1 - test_fraction)))
    out = sections(df, [label], _hash_order(key, seed), _tie(key), sizes, out="_section")
    return out.withColumn("split", F.when(F.col("_section") == 0, "train").otherwise("test")).drop("_section")


def _time(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def chronological_split(df: DataFrame, key: str = "station_id", train_fraction: float = 0.8, ts: str = "ts",
                        tie: str = "reading_id") -> DataFrame:
    """Per station, the first floor(0.8 n) readings in time order are train."""
    out = sections(df, [key], _time(ts), _tie(tie), F.array(F.floor(F.col("n") * train_fraction)), out="_section")
    return out.withColumn("split", F.when(F.col("_section") == 0, "train").otherwise("test")).drop("_section")


def fit_standardizer(train: DataFrame, columns: list[str]) -> DataFrame:
    """One-row table of train means and population std (sklearn's StandardScaler)."""
    return train.agg(*[F.avg(c).alias(f"_mu_{c}") for c in columns],
                     *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns])


def apply_standardizer(df: DataFrame, stats: DataFrame, columns: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / std; a zero-variance column maps to 0 (scale 1)."""
    joined = df.crossJoin(F.broadcast(stats))  # one row
    scaled = [((F.col(c) - F.col(f"_mu_{c}")) /
               F.when(F.col(f"_sd_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_sd_{c}"))).alias(c + suffix)
              for c in columns]
    keep = [c for c in df.columns if suffix or c not in columns]
    return joined.select(*keep, *scaled)


def label_encoder(df: DataFrame, label: str, output: str = "label_index"):
    """Alphabetical label encoding (StringIndexer alphabetAsc) and its inverse."""
    from pyspark.ml.feature import IndexToString, StringIndexer
    model = StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc").fit(df)
    inverse = IndexToString(inputCol="prediction", outputCol=f"{label}_pred", labels=model.labels)
    return model, inverse


def stratified_folds(df: DataFrame, label: str, key: str = "reading_id", k: int = 5, seed: int = 42) -> DataFrame:
    """P5: stratified k-fold id: per class, k runs of the hash order; the first n mod k runs hold one row more."""
    sizes = F.array(*[F.floor(F.col("n") / k) * i + F.least(F.lit(i), F.col("n") % k) for i in range(1, k)])
    return sections(df, [label], _hash_order(key, seed, 1), _tie(key), sizes, out="fold")


def time_roles(df: DataFrame, key: str = "station_id", n_splits: int = 5, ts: str = "ts", tie: str = "reading_id") -> DataFrame:
    """Expanding-window folds as one array column ``roles``: per fold 'train', 'test' or null; test size n // (n_splits + 1)."""
    size = F.floor(F.col("n") / (n_splits + 1))
    out = sections(df, [key], _time(ts), _tie(tie), F.array(*[F.col("n") - (n_splits - i) * size for i in range(n_splits + 1)]), out="_section")
    roles = F.array(*[F.when(F.col("_section") <= i, "train").when(F.col("_section") == i + 1, "test") for i in range(n_splits)])
    return out.withColumn("roles", roles).drop("_section")


def time_folds(df: DataFrame, key: str = "station_id", n_splits: int = 5) -> DataFrame:
    """P6 in long form: a row per reading and fold that it takes part in (fold, role)."""
    return (time_roles(df, key, n_splits).select("*", F.posexplode("roles").alias("time_fold", "role"))
            .filter(F.col("role").isNotNull()).drop("roles"))


def _uniform(key: str, seed: int, salt: int, draw: int) -> Column:
    """A number in (0, 1] per row: 52 leading bits of md5("key:seed:salt:draw"), plus one."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), *[F.lit(str(x)) for x in (seed, salt, draw)]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 1) / float(1 << 52)


def gaussian(key: str, seed: int, salt: int) -> Column:
    """Standard normal draw keyed by (row, seed, salt): Box-Muller on two hashed uniforms."""
    return F.sqrt(-2 * F.log(_uniform(key, seed, salt, 1))) * F.cos(2 * math.pi * _uniform(key, seed, salt, 2))


def with_noise(df: DataFrame, columns: list[str], sigma: float, key: str = "reading_id", seed: int = 42) -> DataFrame:
    """Add N(0, sigma) to each (already scaled) column; same draws for every sigma."""
    if sigma == 0:
        return df
    return df.select(*[c for c in df.columns if c not in columns],
                     *[(F.col(c) + sigma * gaussian(key, seed, i)).alias(c) for i, c in enumerate(columns)])


def with_noises(df: DataFrame, columns: list[str], sigmas: list[float], key: str = "reading_id", seed: int = 42) -> DataFrame:
    """Every row once per noise level (``sigma``), as ``with_noise`` gives it; a row's draws are made once for all levels."""
    draws = df.select("*", *[gaussian(key, seed, i).alias(f"_z{i}") for i in range(len(columns))])
    levels = draws.select("*", F.explode(F.array(*[F.lit(float(s)) for s in sigmas])).alias("sigma"))
    at = {c: i for i, c in enumerate(columns)}
    return levels.select(*[F.when(F.col("sigma") == 0, F.col(c)).otherwise(F.col(c) + F.col("sigma") * F.col(f"_z{at[c]}")).alias(c) if c in at
                           else c for c in df.columns], "sigma")


def first_fraction(df: DataFrame, fractions: list[float], out: str = "from_fraction", rows: Column | None = None, key: str = "reading_id",
                   seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """Nested subsets as one column: the smallest fraction f whose first ceil(f n) rows in hash order hold the row, else null."""
    steps = sorted(fractions)
    sizes = F.array(*[F.ceil(F.lit(float(f)) * F.col("n")) for f in steps])
    tagged = sections(df, by or [], _hash_order(key, seed, 2), _tie(key), sizes, rows, out="_section")
    return tagged.withColumn(out, F.get(F.array(*[F.lit(float(f)) for f in steps]), F.col("_section"))).drop("_section")


def learning_subsets(df: DataFrame, fractions: list[float], key: str = "reading_id", seed: int = 42,
                     by: list[str] | None = None) -> DataFrame:
    """P8 in long form: a row per fraction that holds it."""
    tagged = first_fraction(df, fractions, "_from", key=key, seed=seed, by=by)
    return (tagged.select("*", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
            .filter(F.col("_from") <= F.col("fraction")).drop("_from"))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """P10: balanced weights n / (K * n_c), joined back as a weight column."""
    counts = _counts(df, [label], "_nc")
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label)  # one row per class


def contamination(df: DataFrame, label: str = "anomaly") -> DataFrame:
    """Share of positives."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("contamination"))


def normal_only(df: DataFrame, label: str = "anomaly") -> DataFrame:
    """The label-0 rows used to train semi-supervised detectors."""
    return df.filter(F.col(label) == 0)
