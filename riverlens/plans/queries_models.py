"""Registered queries: splits (P*), models (M*), validation studies and reports (E12-E15, R*).

All models run with their full parameters. Boosted fits of a study grow
together (``operators/boosting.py``); forests are fitted side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import boosting as B
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import splits as P
from ..operators.quality import guard_leakage
from ..functions.stats import exact_quantiles
from ..plans.ordering import SEQ
from ..schema import SENSORS, features_full, features_no_leak
from ..sources.adapters import load_readings
from . import sql as S
from ..session import STUDIES, ensure_checkpoint_dir, materialize, table_path
from .catalog import register

FEAT_SQL = S.features_sql(True)
# Eight equal steps of the learning curve.
FRACTIONS = [round(0.1 + 0.9 * i / 7, 6) for i in range(8)]
MODELS = ("random_forest", "boosted", "gradient_boosting")
BOOSTED = MODELS[1:]
CLASS_SIGMAS, NUMBER_SIGMAS = [0.0, 0.01, 0.02, 0.05, 0.10], [0.0, 0.01, 0.05, 0.10]
FILE_ROWS = 1 << 15     # of the feature table: a file is read by one task
NEAR = "turbidity_mean_4"     # forests' rows are sorted by it within a label: one of the features, so that like rows follow each other
NEAR_NO_LEAK = "dissolved_oxygen_mean_4"    # the same for the anomaly forest, whose features have no turbidity
FITS = 6    # fits of a study side by side: each is a chain of small jobs


def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.build_features(load_readings(spark, sf_dir))


def model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table, checkpointed: model fitting runs many jobs over it, and
    a cut lineage keeps each job from re-planning and recomputing the windows."""
    return materialize(feature_frame(spark, sf_dir).drop(SEQ, "block"), "features", FILE_ROWS)


# ----------------------------------------------------------------------- splits
@register("split_stratified", sql=f"""
WITH f AS ({FEAT_SQL}), c AS (SELECT quality_class, count(*) AS n FROM f GROUP BY quality_class)
SELECT quality_class, 'train' AS split, CAST(ceil(n * 0.8) AS BIGINT) AS n FROM c
UNION ALL SELECT quality_class, 'test', CAST(n - ceil(n * 0.8) AS BIGINT) FROM c WHERE n - ceil(n * 0.8) > 0""")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact stratified 80/20 split sizes per class."""
    s = P.stratified_split(model_input(spark, sf_dir), "quality_class")
    return s.groupBy("quality_class", "split").agg(F.count(F.lit(1)).alias("n"))


@register("split_chronological", sql=f"""
WITH f AS (SELECT *, row_number() OVER {S.W} - 1 AS rn, count(*) OVER (PARTITION BY station_id) AS cnt FROM ({FEAT_SQL}) x)
SELECT station_id, CASE WHEN rn < floor(cnt * 0.8) THEN 'train' ELSE 'test' END AS split, CAST(count(*) AS BIGINT) AS n,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts
FROM f GROUP BY ALL""")
def split_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per station, first 80 % of readings in time order train."""
    s = P.chronological_split(model_input(spark, sf_dir))
    return s.groupBy("station_id", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ts"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"))


_SCALE_COLS = SENSORS + ["turbidity_mean_16"]


@register("split_standardized", sql=f"""
WITH f AS (SELECT *, row_number() OVER {S.W} - 1 AS rn, count(*) OVER (PARTITION BY station_id) AS cnt FROM ({FEAT_SQL}) x),
st AS (SELECT {', '.join(f'avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}' for c in _SCALE_COLS)} FROM f WHERE rn < floor(cnt * 0.8))
SELECT reading_id, {', '.join(f'round(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1 ELSE sd_{c} END, 6) AS {c}' for c in _SCALE_COLS)}
FROM f, st""")
def split_standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardise with train-only mean and population std, applied to all rows."""
    s = P.chronological_split(model_input(spark, sf_dir))
    stats = P.fit_standardizer(s.filter(F.col("split") == "train"), _SCALE_COLS)
    out = P.apply_standardizer(s.select("reading_id", *_SCALE_COLS), stats, _SCALE_COLS)
    return out.select("reading_id", *[F.round(c, 6).alias(c) for c in _SCALE_COLS])


@register("split_label_encoding", sql=f"""
SELECT quality_class, CAST(dense_rank() OVER (ORDER BY quality_class) - 1 AS DOUBLE) AS label_index
FROM (SELECT DISTINCT quality_class FROM ({S.READINGS}) r) d""")
def split_label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alphabetical label encoding."""
    r = load_readings(spark, sf_dir)
    model, _ = P.label_encoder(r, "quality_class")
    return model.transform(r.select("quality_class").distinct())


@register("split_stratified_folds", sql=f"""
WITH c AS (SELECT quality_class, count(*) AS n FROM ({FEAT_SQL}) f GROUP BY quality_class)
SELECT quality_class, CAST(k AS INT) AS fold, CAST(n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM c, range(5) t(k) WHERE n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END > 0""")
def split_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: stratified 5-fold sizes per class."""
    f = P.stratified_folds(model_input(spark, sf_dir), "quality_class")
    return f.groupBy("quality_class", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("split_time_folds", sql=f"""
WITH f AS (SELECT *, row_number() OVER {S.W} - 1 AS rn, count(*) OVER (PARTITION BY station_id) AS cnt FROM ({FEAT_SQL}) x),
e AS (SELECT f.*, k AS time_fold, cnt // 6 AS ts_, cnt - (5 - k) * (cnt // 6) AS st FROM f, range(5) t(k)),
r AS (SELECT *, CASE WHEN rn < st THEN 'train' WHEN rn < st + ts_ THEN 'test' END AS role FROM e)
SELECT station_id, CAST(time_fold AS INT) AS time_fold, role, CAST(count(*) AS BIGINT) AS n,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts FROM r WHERE role IS NOT NULL GROUP BY ALL""")
def split_time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding-window time folds (train all earlier rows, test the next block)."""
    t = P.time_folds(model_input(spark, sf_dir))
    return t.groupBy("station_id", "time_fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_ts"))


def _draw_sql(draw: int) -> str:
    return f"(CAST('0x' || substr(md5(reading_id || ':42:' || salt || ':{draw}'), 1, 13) AS BIGINT) + 1) / CAST({1 << 52} AS DOUBLE)"


@register("split_noise", sql=f"""
WITH d AS (SELECT sqrt(-2 * ln({_draw_sql(1)})) * cos(2 * pi() * ({_draw_sql(2)})) AS z FROM ({FEAT_SQL}) f, range({len(features_no_leak())}) t(salt))
SELECT sigma, round(avg(sigma * z), 6) AS noise_mean, round(stddev_pop(sigma * z), 6) AS noise_std, CAST(count(*) AS BIGINT) AS n
FROM d, (VALUES {', '.join(f"(CAST({s} AS DOUBLE))" for s in CLASS_SIGMAS)}) v(sigma) GROUP BY sigma""")
def split_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sigma, mean and std of the noise added to the scaled non-turbidity features."""
    n = len(features_no_leak())
    draws = feature_frame(spark, sf_dir).select(F.explode(F.array(*[P.gaussian("reading_id", 42, i) for i in range(n)])).alias("z"))
    # every sigma's moments from one row per draw
    moments = [F.struct(F.lit(x).alias("sigma"), F.round(F.avg(F.lit(x) * F.col("z")), 6).alias("noise_mean"),
                        F.round(F.stddev_pop(F.lit(x) * F.col("z")), 6).alias("noise_std"), F.count(F.lit(1)).alias("n")) for x in CLASS_SIGMAS]
    return draws.agg(F.array(*moments).alias("m")).select(F.inline("m")).filter("n > 0")


@register("split_learning_subsets", sql=f"""
WITH c AS (SELECT count(*) AS n FROM ({FEAT_SQL}) f)
SELECT fr AS fraction, CAST(ceil(fr * n) AS BIGINT) AS n FROM c,
  (VALUES {', '.join(f"(CAST({f} AS DOUBLE))" for f in FRACTIONS)}) v(fr)""")
def split_learning_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested learning-curve subset sizes."""
    s = P.learning_subsets(model_input(spark, sf_dir), FRACTIONS)
    return s.groupBy("fraction").agg(F.count(F.lit(1)).alias("n"))


def _hash_sql(seed: int, salt: int) -> str:
    return f"CAST('0x' || substr(md5(reading_id || ':{seed}:{salt}'), 1, 15) AS BIGINT)"


@register("split_stratified_rows", sql=f"""
WITH r AS (SELECT reading_id, row_number() OVER (PARTITION BY quality_class ORDER BY {_hash_sql(42, 0)}, reading_id) AS rn,
  count(*) OVER (PARTITION BY quality_class) AS n FROM ({FEAT_SQL}) f)
SELECT reading_id, CASE WHEN rn <= ceil(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r""")
def split_stratified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows train."""
    return P.stratified_split(model_input(spark, sf_dir), "quality_class").select("reading_id", "split")


@register("split_fold_rows", sql=f"""
WITH r AS (SELECT reading_id, row_number() OVER (PARTITION BY quality_class ORDER BY {_hash_sql(42, 1)}, reading_id) - 1 AS rn,
  count(*) OVER (PARTITION BY quality_class) AS n FROM ({FEAT_SQL}) f)
SELECT reading_id, CAST(CASE WHEN rn < (n % 5) * (n // 5 + 1) THEN rn // (n // 5 + 1)
  ELSE n % 5 + (rn - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS INT) AS fold FROM r""")
def split_fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the fold of every row."""
    return P.stratified_folds(model_input(spark, sf_dir), "quality_class").select("reading_id", "fold")


@register("split_subset_rows", sql=f"""
WITH r AS (SELECT reading_id, row_number() OVER (ORDER BY {_hash_sql(42, 2)}, reading_id) AS rn, count(*) OVER () AS n FROM ({FEAT_SQL}) f)
SELECT reading_id, min(fr) AS from_fraction FROM r, (VALUES {', '.join(f"(CAST({f} AS DOUBLE))" for f in FRACTIONS)}) v(fr)
WHERE rn <= ceil(fr * n) GROUP BY reading_id""")
def split_subset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fraction that holds each row."""
    return P.first_fraction(model_input(spark, sf_dir), FRACTIONS).select("reading_id", "from_fraction")


@register("split_label_decoding", sql=f"""
WITH d AS (SELECT DISTINCT quality_class FROM ({S.READINGS}) r), c AS (SELECT quality_class, dense_rank() OVER (ORDER BY quality_class) - 1 AS at FROM d)
SELECT r.reading_id, r.quality_class, CAST(c.at AS DOUBLE) AS label_index, c.quality_class AS decoded FROM ({S.READINGS}) r JOIN c USING (quality_class)""")
def split_label_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels encoded and decoded again by the inverse."""
    r = load_readings(spark, sf_dir)
    model, inverse = P.label_encoder(r, "quality_class")
    coded = model.transform(r.select("reading_id", "quality_class")).withColumn("prediction", F.col("label_index"))
    return inverse.transform(coded).select("reading_id", "quality_class", "label_index", F.col("quality_class_pred").alias("decoded"))


@register("split_smote")
def split_smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMOTE balance on the anomaly training rows (26 non-turbidity features)."""
    feats = features_no_leak()
    s = P.chronological_split(model_input(spark, sf_dir)).filter(F.col("split") == "train")
    sm = ML.smote(s, feats, "anomaly", "reading_id", k=3)
    return sm.groupBy("anomaly", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@register("split_class_weights", sql=f"""
WITH c AS (SELECT quality_class, count(*) AS nc FROM ({FEAT_SQL}) f GROUP BY quality_class)
SELECT quality_class, round(CAST(sum(nc) OVER () AS DOUBLE) / (count(*) OVER () * nc), 6) AS weight FROM c""")
def split_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: balanced class weights."""
    w = P.class_weights(feature_frame(spark, sf_dir), "quality_class")
    return w.select("quality_class", F.round("weight", 6).alias("weight")).distinct()


@register("split_contamination", sql=f"SELECT round(avg(CAST(anomaly AS DOUBLE)), 6) AS contamination FROM ({FEAT_SQL}) f")
def split_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    return P.contamination(feature_frame(spark, sf_dir)).select(F.round("contamination", 6).alias("contamination"))


@register("split_normal_only", sql=f"SELECT CAST(count(*) AS BIGINT) AS n FROM ({FEAT_SQL}) f WHERE anomaly = 0")
def split_normal_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    return P.normal_only(feature_frame(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------- models
def _version(spark: SparkSession, path: str) -> tuple:
    """Changes when the files below ``path`` do: their number and a sum over names, sizes and modification times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


_LOCKS: dict[tuple, Lock] = {}


def _once(name: str, run, spark: SparkSession, sf_dir: str):
    """A study's written prediction table, made once per application and state of the input: its queries are views of it."""
    path = table_path(sf_dir, "events")
    key, version = (spark.sparkContext.applicationId, name, path), _version(spark, path)
    with _LOCKS.setdefault(key, Lock()):        # of studies side by side one makes a table that they share
        if key not in STUDIES or STUDIES[key][0] != version:
            STUDIES[key] = version, run(spark, sf_dir)
        return STUDIES[key][1]


def _study_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table of all studies, written once like their predictions."""
    return _once("features", model_input, spark, sf_dir)


def _together(jobs: list[Callable]) -> list:
    """Results of jobs that run side by side: one-task growth of boosted fits leaves cores to forests."""
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(inheritable_thread_target(lambda job: job()), jobs))


def _studies(spark: SparkSession, sf_dir: str, **runs: Callable) -> None:
    """Run those studies side by side, so that their queries find them written."""
    _together([lambda n=n, run=run: _once(n.replace("_", "-"), run, spark, sf_dir) for n, run in runs.items()])


def _classes(df: DataFrame) -> list[str]:
    """The labels in alphabetical order (P4): a handful of values."""
    return sorted(r[0] for r in df.select("quality_class").distinct().collect() if r[0] is not None)


def _class_number(labels: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("quality_class")) - 1


def _label_of(labels: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), number.cast("int") + 1)


def _likeliest(labels: list[str], output: str = "output") -> Column:
    return _label_of(labels, F.array_position(output, F.array_max(output)) - 1)


def _boosted_predictions(df: DataFrame, labels: list[str], fits: dict[str, tuple[str, Column]], keep: list[str]) -> DataFrame:
    """(keep..., fit, output): every fit (learner, rows to train on) grown together, then applied to all rows of ``df``."""
    grown = B.fit_many(df, features_full(), _class_number(labels), {n: (B.LEARNERS[kind], rows) for n, (kind, rows) in fits.items()}, len(labels))
    return grown.predict(df, keep)


def _class_forest_run(spark: SparkSession, sf_dir: str):
    """The forest of the stratified training rows, for predictions and importances."""
    df = materialize(P.stratified_split(_study_input(spark, sf_dir), "quality_class"), "split")
    train = materialize(P.class_weights(df.filter(F.col("split") == "train"), "quality_class"), "train")
    return ML.classification_pipeline(ML.make_classifier("random_forest"), features_full(), "quality_class").fit(ML.dealt(train, "quality_class", NEAR))


def _classifier_run(spark: SparkSession, sf_dir: str):
    df = materialize(P.stratified_split(_study_input(spark, sf_dir), "quality_class"), "split")
    labels = _classes(df)
    test = df.filter(F.col("split") == "test")
    trained = F.col("split") == "train"

    def forest() -> DataFrame:
        model = _once("class-forest", _class_forest_run, spark, sf_dir)
        p = model.transform(test).withColumn("pred", _label_of(model.stages[0].labels, F.col("prediction")))
        for c in labels:
            p = ML.class_probability(p, model, c, "quality_class", out=f"p_{c}")
        return materialize(p.select(F.lit("random_forest").alias("model"), "reading_id", F.col("quality_class").alias("y"), "pred",
                                    *[f"p_{c}" for c in labels]), "predictions")

    def boosted() -> DataFrame:
        b = _boosted_predictions(df, labels, {m: (m, trained) for m in BOOSTED}, ["reading_id", "quality_class", "split"]).filter(~trained)
        return materialize(b.select(F.col("fit").alias("model"), "reading_id", F.col("quality_class").alias("y"), _likeliest(labels).alias("pred"),
                                    *[F.col("output")[i].alias(f"p_{c}") for i, c in enumerate(labels)]), "predictions")
    return _side_by_side([boosted, forest]), labels


@register("model_classifier_comparison")
def model_classifier_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier comparison with cross-validation mean, deviation and gap, the best marked."""
    preds, labels = _once("classifiers", _classifier_run, spark, sf_dir)
    summ = M.classification_summary(preds, ["model"], "y", "pred")
    long = preds.select("model", "reading_id", "y", F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(f"p_{c}").alias("score")) for c in labels])).alias("c"))
    long = long.select("model", F.col("c.label").alias("label"), (F.col("y") == F.col("c.label")).cast("int")
                       .alias("is_class"), F.col("c.score").alias("score"))
    auc = M.roc_auc_ovr(long, ["model"], "label", "is_class", "score")
    cv = _cv_table(spark, sf_dir).select("model", "cv_mean", "cv_std", "train_mean", "gap")
    table = materialize(summ.join(auc, "model", "left").join(cv, "model", "left"), "comparison")
    best = ML.best_model(table, "f1_macro", MODELS).select(F.col("best").alias("model")).withColumn("is_best", F.lit(True))
    return table.join(best, "model", "left").fillna(False, subset=["is_best"])


@register("model_classifier_per_class")
def model_classifier_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class detail of every classifier."""
    preds, _ = _once("classifiers", _classifier_run, spark, sf_dir)
    return M.per_class(preds, ["model"], "y", "pred")


@register("model_feature_importance")
def model_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-forest importances, ranked, with % of the total; the top 15 are marked."""
    forest = _once("class-forest", _class_forest_run, spark, sf_dir)
    imp = ML.feature_importances(forest, features_full(), spark)
    top = ML.top_importances(imp, 15).select("feature", F.lit(True).alias("in_top"))
    return imp.join(top, "feature", "left").fillna(False, subset=["in_top"])


def _regression_run(spark: SparkSession, sf_dir: str):
    feats = features_full()
    df = materialize(P.chronological_split(_study_input(spark, sf_dir)).withColumn("target", F.col("wqi")), "regression")
    train, test = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "test")

    def forest() -> DataFrame:
        model = ML.regression_pipeline(ML.make_regressor("random_forest"), feats).fit(ML.dealt(train, "target", NEAR))
        return materialize(model.transform(test).select(
            F.lit("random_forest").alias("model"), "reading_id", "station_id", "ts", F.col("target").alias("y"), F.col("prediction").alias("p")), "predictions")

    def boosted() -> DataFrame:
        grown = B.fit_many(df, feats, F.col("target"), {m: (B.LEARNERS[m], F.col("split") == "train") for m in BOOSTED})
        return materialize(grown.predict(test, ["reading_id", "station_id", "ts", "target"]).select(
            F.col("fit").alias("model"), "reading_id", "station_id", "ts", F.col("target").alias("y"), F.col("output")[0].alias("p")), "predictions")
    return _side_by_side([boosted, forest])


@register("model_regressor_comparison")
def model_regressor_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regressor comparison (chronological split)."""
    r = materialize(M.regression_metrics(_once("regressors", _regression_run, spark, sf_dir), ["model"], "y", "p"), "comparison")
    best = ML.best_model(r, "r2", MODELS).select(F.col("best").alias("model")).withColumn("is_best", F.lit(True))
    return r.join(best, "model", "left").fillna(False, subset=["is_best"])


@register("model_prediction_series")
def model_prediction_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamp, actual, predicted and residual per model on the test span."""
    p = _once("regressors", _regression_run, spark, sf_dir)
    return p.select("model", "station_id", "reading_id", "ts", "y", "p", (F.col("y") - F.col("p")).alias("residual"))


def _anomaly_run(spark: SparkSession, sf_dir: str):
    feats = features_no_leak()
    s = P.chronological_split(_study_input(spark, sf_dir))
    stats = P.fit_standardizer(s.filter(F.col("split") == "train"), feats)
    scaled = materialize(P.apply_standardizer(s, stats, feats), "scaled")
    train, test = scaled.filter(F.col("split") == "train"), scaled.filter(F.col("split") == "test")
    guard_leakage(train, feats)
    cont = train.agg(F.avg(F.col("anomaly").cast("double"))).first()[0] or 0.01
    keep = ["reading_id", "ts", "turbidity", "wqi", "quality_class", F.col("anomaly").alias("y"), "pred", "score"]

    def isolation() -> DataFrame:
        trees = ML.fit_isolation_forest(train, feats)
        iso_test = ML.score_isolation_forest(test, trees, feats)
        iso_train = materialize(ML.score_isolation_forest(train.select("reading_id", *feats), trees, feats).select("iso_score"), "iso-train")
        thr = exact_quantiles(iso_train, ["iso_score"], [1 - cont]).first()["value"]
        iso = A.with_min_max_score(materialize(iso_test.withColumn("pred", (F.col("iso_score") >= thr).cast("int")), "iso"),
                                   "iso_score", "score")
        return iso.select(F.lit("isolation_forest").alias("model"), *keep)

    def forest(rows) -> PipelineModel:
        balanced = materialize(ML.smote(rows, feats, "anomaly", "reading_id", k=3), "smote")
        est = ML.RandomForestClassifier(featuresCol="features", labelCol="anomaly", seed=42, **ML.CLASSIFIER_PARAMS["random_forest"])
        return ML.regression_pipeline(est, feats).fit(ML.dealt(balanced.withColumn("anomaly", F.col("anomaly").cast("double")), "anomaly", NEAR_NO_LEAK))

    def threshold() -> float:
        # from a fifth of the training rows that its forest has not seen; test rows decide nothing
        fold = F.pmod(F.xxhash64("reading_id", F.lit(8)), F.lit(5)) == 0
        held = forest(train.filter(~fold)).transform(train.filter(fold)).withColumn("score", ML.vector_to_array("probability")[1])
        best = M.best_f1_threshold(materialize(held.select(F.lit("rf_smote").alias("model"), F.col("anomaly").alias("y"), "score"), "held"),
                                   ["model"], "y", "score").first()
        return best["threshold"] if best else 0.5

    def one_class() -> DataFrame:
        oc = ML.fit_one_class(train.filter(F.col("anomaly") == 0), feats, nu=max(cont, 0.01))
        ocp = ML.score_one_class(test, oc)
        ocp = A.with_min_max_score(materialize(ocp.withColumn("pred", (F.col("ocsvm_score") > 0).cast("int")), "oc"), "ocsvm_score", "score")
        return ocp.select(F.lit("one_class").alias("model"), *keep)

    rf, rf_t, ocp, iso = _together([lambda: forest(train), threshold, one_class, isolation])
    rfp = rf.transform(test).withColumn("score", ML.vector_to_array("probability")[1]).withColumn("pred", (F.col("score") >= rf_t).cast("int"))
    rfp = rfp.select(F.lit("rf_smote").alias("model"), *keep)
    return materialize(iso.unionByName(rfp).unionByName(ocp), "anomaly-predictions")


@register("model_one_class_share")
def model_one_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: share of the normal training rows that the one-class detector flags, against nu."""
    feats = features_no_leak()
    train = P.chronological_split(model_input(spark, sf_dir)).filter((F.col("split") == "train") & (F.col("anomaly") == 0))
    train = materialize(P.apply_standardizer(train, P.fit_standardizer(train, feats), feats), "normal")
    out = None
    nus = (0.02, 0.05, 0.10)
    for nu, model in zip(nus, ML.fit_one_classes(train, feats, nus), strict=True):
        share = ML.score_one_class(train.select("reading_id", *feats), model).agg(
            F.lit(nu).alias("nu"), F.avg((F.col("ocsvm_score") > 0).cast("double")).alias("flagged"), F.count(F.lit(1)).alias("n"))
        share = share.withColumn("within_band", F.abs(F.col("flagged") - F.col("nu")) <= 0.2 * F.col("nu"))
        out = share if out is None else out.unionByName(share)
    return out


@register("model_anomaly_comparison")
def model_anomaly_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly detectors with AP, AUC, F1 and TP/FP/FN/TN."""
    preds = _once("anomalies", _anomaly_run, spark, sf_dir)
    counts = M.binary_counts(preds, ["model"], "y", "pred")
    f1 = counts.select("model", (2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
                       .alias("f1"))
    out = (counts.join(f1, "model").join(M.average_precision(preds, ["model"], "y", "score"), "model")
                 .join(M.roc_auc(preds, ["model"], "y", "score"), "model"))
    best = ML.best_model(out, "f1", ("isolation_forest", "rf_smote", "one_class")).select(F.col("best").alias("model")).withColumn("is_best", F.lit(True))
    return out.join(best, "model", "left").fillna(False, subset=["is_best"])


@register("model_anomaly_timeline")
def model_anomaly_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline of the isolation-forest score with bands and labelled events."""
    p = _once("anomalies", _anomaly_run, spark, sf_dir).filter(F.col("model") == "isolation_forest")
    band = F.when(F.col("score") >= 0.65, "alto").when(F.col("score") >= 0.35, "medio").otherwise("bajo")
    return p.select("reading_id", "ts", "turbidity", "y", "score", band.alias("score_band"), "wqi", "quality_class",
                    F.when(F.col("y") == 1, F.when(F.col("score") >= 0.65, "ROJO").otherwise("AMARILLO"))
                     .alias("event_level"))


@register("model_anomaly_events")
def model_anomaly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled anomalies with the isolation forest's score and a two-way level."""
    p = _once("anomalies", _anomaly_run, spark, sf_dir).filter(F.col("model") == "isolation_forest").withColumnsRenamed({"y": "anomaly", "score": "anomaly_score"})
    return A.anomaly_events(p).select("reading_id", "ts", "turbidity", "wqi", "quality_class", "anomaly_score", "event_level")


@register("model_report_tables")
def model_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model reports (R1-R6, R12, R13) written as tables and read back: columns and rows of each."""
    from ..sources import io
    made = (model_classifier_comparison, model_classifier_per_class, model_regressor_comparison, model_anomaly_comparison, model_feature_importance,
            model_anomaly_events, model_prediction_series, model_anomaly_timeline)
    _studies(spark, sf_dir, classifiers=_classifier_run, cv=_cv_run, regressors=_regression_run, anomalies=_anomaly_run)
    return io.save_reports({f.__name__.removeprefix("model_"): f(spark, sf_dir) for f in made},
                           f"{ensure_checkpoint_dir(spark)}/tables/model-reports-{uuid.uuid4().hex[:8]}")


@register("validation_report_tables")
def validation_report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation reports (R10, R11) written as tables and read back: columns and rows of each."""
    from ..sources import io
    made = (validation_summary, validation_cv_summary, validation_time_folds, validation_noise, validation_noise_regression)
    return io.save_reports({f.__name__.removeprefix("validation_"): f(spark, sf_dir) for f in made},
                           f"{ensure_checkpoint_dir(spark)}/tables/validation-reports-{uuid.uuid4().hex[:8]}")


def fitted_alert_models(spark: SparkSession, sf_dir: str):
    """Classifier (saved and loaded again) and isolation forest, fitted on the first 80 % of every station; also those splits."""
    from ..sources.io import load_model, save_model
    feats, anom = features_full(), features_no_leak()
    rows = materialize(P.chronological_split(model_input(spark, sf_dir)), "alert-rows")
    train = materialize(P.class_weights(rows.filter(F.col("split") == "train"), "quality_class"), "alert-train")
    path = f"{ensure_checkpoint_dir(spark)}/models/alerts-{uuid.uuid4().hex[:8]}"
    save_model(ML.classification_pipeline(ML.make_classifier("random_forest"), feats, "quality_class").fit(ML.dealt(train, "quality_class", NEAR)), path)
    stats = P.fit_standardizer(train, anom)
    row = stats.first()     # one mean and one deviation per feature
    scaled = P.apply_standardizer(train, stats, anom).select("reading_id", *anom)
    models = ML.AlertModels(load_model(path), "quality_class", ML.fit_isolation_forest(scaled, anom), anom,
                            {f: (row[f"_mu_{f}"], row[f"_sd_{f}"]) for f in anom}, (0.0, 1.0))
    models.bounds = tuple(models.raw(train).agg(F.min("iso_score"), F.max("iso_score")).first())
    models.rows = rows
    return models


@register("model_alert_layers")
def model_alert_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + A8/A9/A13/A14: both alert layers on held-out readings, driven by models fitted on the earlier ones."""
    models = fitted_alert_models(spark, sf_dir)
    alerts = materialize(A.with_alerts(models.score(models.rows.filter(F.col("split") == "test"))), "alerts")
    return A.layer_distribution(alerts).join(A.layer_recall(alerts).withColumnRenamed("layer", "variable"),
                                             "variable", "left")


def _side_by_side(jobs: list[Callable[[], DataFrame]]) -> DataFrame:
    """Union of the written tables of jobs that run side by side."""
    return reduce(DataFrame.unionByName, _together(jobs))


def _forest(train: DataFrame) -> tuple[PipelineModel, Column]:
    """The studies' forest and its predicted label; without the indexer it also scores rows of a label that ``train`` lacks."""
    model = ML.classification_pipeline(ML.make_classifier("random_forest"), features_full(), "quality_class").fit(
        ML.dealt(P.class_weights(train, "quality_class"), "quality_class", NEAR))
    return PipelineModel(model.stages[1:]), _label_of(model.stages[0].labels, F.col("prediction"))


def _name(kind: str, *tags) -> str:
    return "|".join([kind, *map(str, tags)])


def _tag(i: int) -> Column:
    return F.split("fit", r"\|")[i]


def _cv_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = P.stratified_split(_study_input(spark, sf_dir), "quality_class").filter(F.col("split") == "train")
    df = materialize(P.stratified_folds(seen, "quality_class"), "folds")
    labels = _classes(df)

    def columns(name: Column, k: Column, pred: Column) -> list[Column]:
        return [name.alias("model"), k.alias("cv_fold"), F.when(F.col("fold") == k, "test").otherwise("train").alias("role"),
                F.col("quality_class").alias("y"), pred.alias("pred")]

    def forest(k: int) -> DataFrame:
        model, lab = _forest(df.filter(F.col("fold") != k))
        return materialize(model.transform(df).select(columns(F.lit("random_forest"), F.lit(k), lab)), "cv")

    def boosted() -> DataFrame:
        out = _boosted_predictions(df, labels, {_name(m, k): (m, F.col("fold") != k) for m in BOOSTED for k in range(5)}, ["quality_class", "fold"])
        return materialize(out.select(columns(_tag(0), _tag(1).cast("int"), _likeliest(labels))), "cv")
    return _side_by_side([boosted, *[lambda k=k: forest(k) for k in range(5)]])


def _cv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11 per classifier from the predictions, which are written once."""
    s = M.classification_summary(_once("cv", _cv_run, spark, sf_dir), ["model", "cv_fold", "role"], "y", "pred")
    fm = s.groupBy("model", "cv_fold").pivot("role", ["test", "train"]).agg(F.first("f1_macro"))
    return M.cv_summary(fm, ["model"], "cv_fold", "test", "train", list(range(5)))


def _time_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(P.time_roles(_study_input(spark, sf_dir)), "time-folds")
    labels = _classes(df)
    role = [F.col("roles")[k] for k in range(5)]

    def forest(k: int) -> DataFrame:
        model, lab = _forest(df.filter(role[k] == "train"))
        return materialize(model.transform(df.filter(role[k] == "test")).select(
            F.lit("random_forest").alias("model"), F.lit(k).alias("time_fold"), F.col("quality_class").alias("y"), lab.alias("pred")), "time")

    def boosted() -> DataFrame:
        out = _boosted_predictions(df, labels, {_name(m, k): (m, role[k] == "train") for m in BOOSTED for k in range(5)}, ["quality_class", "roles"])
        fold = _tag(1).cast("int")
        return materialize(out.filter(F.get("roles", fold) == "test").select(
            _tag(0).alias("model"), fold.alias("time_fold"), F.col("quality_class").alias("y"), _likeliest(labels).alias("pred")), "time")
    return _side_by_side([boosted, *[lambda k=k: forest(k) for k in range(5)]])


def _time_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12 per classifier from the predictions, which are written once."""
    s = M.classification_summary(_once("time", _time_run, spark, sf_dir), ["model", "time_fold"], "y", "pred").withColumnRenamed("f1_macro", "test")
    return M.cv_summary(s, ["model"], "time_fold", "test", None, list(range(5)))


@register("validation_time_folds")
def validation_time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanding time folds (true time order) of every classifier, mean/std and consistency."""
    return _time_table(spark, sf_dir)


def _noisy(test: DataFrame, sigmas: list[float], columns: list[str]) -> DataFrame:
    """Written table of the held-out rows once per noise level, for all models of a study."""
    rows = P.with_noises(test.select("reading_id", *columns), features_no_leak(), sigmas)
    return materialize(rows.select(*columns, "sigma"), "noisy", FILE_ROWS)


def _noise_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = features_full()
    s = P.stratified_split(_study_input(spark, sf_dir), "quality_class")
    stats = P.fit_standardizer(s.filter(F.col("split") == "train"), feats)
    scaled = materialize(P.apply_standardizer(s, stats, feats), "scaled")
    labels = _classes(scaled)
    train = scaled.filter(F.col("split") == "train")
    (model, lab), grown, test = _together([
        lambda: _forest(train),
        lambda: B.fit_many(train, feats, _class_number(labels), {m: (B.LEARNERS[m], F.lit(True)) for m in BOOSTED}, len(labels)),
        lambda: _noisy(scaled.filter(F.col("split") == "test"), CLASS_SIGMAS, ["quality_class", *feats])])

    def forest() -> DataFrame:
        return materialize(model.transform(test).select(F.lit("random_forest").alias("model"), "sigma", F.col("quality_class").alias("y"), lab.alias("pred")), "noise")

    def boosted() -> DataFrame:
        return materialize(grown.predict(test, ["sigma", "quality_class"]).select(
            F.col("fit").alias("model"), "sigma", F.col("quality_class").alias("y"), _likeliest(labels).alias("pred")), "noise")
    return _side_by_side([boosted, forest])


def _noise_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E13 per classifier from the predictions, which are written once."""
    s = M.classification_summary(_once("noise", _noise_run, spark, sf_dir), ["model", "sigma"], "y", "pred").withColumnRenamed("f1_macro", "f1")
    return M.noise_table(s, ["model"], "sigma", "f1", CLASS_SIGMAS)


@register("validation_noise")
def validation_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of every classifier on all 45 features as Gaussian noise grows on the scaled non-turbidity ones."""
    return _noise_table(spark, sf_dir)


def _noise_regression_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = features_full()
    s = P.chronological_split(_study_input(spark, sf_dir)).withColumn("target", F.col("wqi"))
    scaled = materialize(P.apply_standardizer(s, P.fit_standardizer(s.filter(F.col("split") == "train"), feats), feats), "scaled")
    train = scaled.filter(F.col("split") == "train")
    model, grown, test = _together([
        lambda: ML.regression_pipeline(ML.make_regressor("random_forest"), feats).fit(ML.dealt(train, "target", NEAR)),
        lambda: B.fit_many(train, feats, F.col("target"), {m: (B.LEARNERS[m], F.lit(True)) for m in BOOSTED}),
        lambda: _noisy(scaled.filter(F.col("split") == "test"), NUMBER_SIGMAS, ["target", *feats])])

    def forest() -> DataFrame:
        return materialize(model.transform(test).select(
            F.lit("random_forest").alias("model"), "sigma", F.col("target").alias("y"), F.col("prediction").alias("p")), "noise-r2")

    def boosted() -> DataFrame:
        return materialize(grown.predict(test, ["sigma", "target"]).select(
            F.col("fit").alias("model"), "sigma", F.col("target").alias("y"), F.col("output")[0].alias("p")), "noise-r2")
    return _side_by_side([boosted, forest])


def _regression_noise_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E8-E10 per regressor and sigma from the predictions, which are written once."""
    return M.regression_metrics(_once("noise-r2", _noise_regression_run, spark, sf_dir), ["model", "sigma"], "y", "p")


@register("validation_noise_regression")
def validation_noise_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R² of every regressor on all 45 features as noise grows on the scaled non-turbidity ones."""
    return M.noise_table(_regression_noise_metrics(spark, sf_dir), ["model"], "sigma", "r2", NUMBER_SIGMAS)


@register("validation_cv_summary")
def validation_cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified 5-fold F1-macro of every classifier with train-test gap, F1 under noise
    and verdict; every regressor's R² with its verdict (a row's values of the other task are null)."""
    _studies(spark, sf_dir, cv=_cv_run, noise=_noise_run, noise_r2=_noise_regression_run)
    noise = _noise_table(spark, sf_dir).select("model", F.col("f1_s0_05").alias("noise_f1"))
    classes = _cv_table(spark, sf_dir).join(noise, "model").select(F.lit("classification").alias("task"), "*")
    numbers = _regression_noise_metrics(spark, sf_dir).filter(F.col("sigma") == 0).select(F.lit("regression").alias("task"), "model", "r2")
    out = M.verdicts(classes.unionByName(numbers, allowMissingColumns=True), noise="noise_f1", r2="r2")
    return out.withColumn("validated", F.when(F.col("task") == "regression", F.col("r2_ok")).otherwise(F.col("validated")))


def _best(table: DataFrame, value: str) -> DataFrame:
    """The row of the highest value; ties go to the earlier of MODELS."""
    return table.orderBy(F.desc(value), F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))).limit(1)    # a row per model


def _key_values(task: str, row: DataFrame, values: dict[str, str]) -> DataFrame:
    return row.select(F.lit(task).alias("task"), "model", F.inline(F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.col(c).alias("value")) for metric, c in values.items()])))


@register("validation_summary")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best classifier by CV F1-macro and best regressor by R² with their key values, from the tables of the studies."""
    _studies(spark, sf_dir, cv=_cv_run, time=_time_run, noise=_noise_run, noise_r2=_noise_regression_run)
    time = _time_table(spark, sf_dir).select("model", F.col("cv_mean").alias("time_mean"), F.col("cv_std").alias("time_std"))
    noise = _noise_table(spark, sf_dir).select("model", "f1_s0_05")
    c = _best(_cv_table(spark, sf_dir), "cv_mean").join(time, "model", "left").join(noise, "model", "left")
    n = _regression_noise_metrics(spark, sf_dir)
    noisy = n.filter(F.col("sigma") == 0.05).select("model", F.col("r2").alias("r2_s0_05"))
    r = _best(n.filter(F.col("sigma") == 0), "r2").join(noisy, "model", "left")
    return _key_values("classification", c, {
        "cv_f1_mean": "cv_mean", "cv_f1_std": "cv_std", "time_f1_mean": "time_mean", "time_f1_std": "time_std",
        "noise_f1_0_05": "f1_s0_05", "gap": "gap"}).unionByName(_key_values("regression", r, {
            "r2": "r2", "rmse": "rmse", "mae": "mae", "noise_r2_0_05": "r2_s0_05"}))


def _curve_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = P.stratified_split(_study_input(spark, sf_dir), "quality_class").filter(F.col("split") == "train")
    df = P.stratified_folds(seen, "quality_class", k=3)
    for k in range(3):      # the first fraction in which a row trains for fold k; null for its own test rows
        df = P.first_fraction(df, FRACTIONS, f"from_{k}", rows=F.col("fold") != k, seed=k)
    df = materialize(df, "curve-rows")
    labels = _classes(df)
    grid = [(k, f) for k in range(3) for f in FRACTIONS]

    def trains(k: int, frac: float) -> Column:
        return F.coalesce(F.col(f"from_{k}") <= frac, F.lit(False))

    def columns(name: Column, frac: Column, k: Column, test: Column, pred: Column) -> list[Column]:
        return [name.alias("model"), frac.alias("fraction"), k.alias("cv_fold"), F.when(test, "test").otherwise("train").alias("role"),
                F.col("quality_class").alias("y"), pred.alias("pred")]

    def forest(k: int, frac: float) -> DataFrame:
        model, lab = _forest(df.filter(trains(k, frac)))
        rows = df.filter((F.col("fold") == k) | trains(k, frac))
        return materialize(model.transform(rows).select(columns(F.lit("random_forest"), F.lit(frac), F.lit(k), F.col("fold") == k, lab)), "curve")

    def boosted() -> DataFrame:
        keep = ["quality_class", "fold", "from_0", "from_1", "from_2"]
        out = _boosted_predictions(df, labels, {_name(m, k, f): (m, trains(k, f)) for m in BOOSTED for k, f in grid}, keep)
        k, frac = _tag(1).cast("int"), _tag(2).cast("double")
        own = F.get(F.array("from_0", "from_1", "from_2"), k) <= frac
        return materialize(out.filter((F.col("fold") == k) | F.coalesce(own, F.lit(False))).select(
            columns(_tag(0), frac, k, F.col("fold") == k, _likeliest(labels))), "curve")
    return _side_by_side([boosted, *[lambda k=k, f=f: forest(k, f) for k, f in grid]])


@register("validation_learning_curve")
def validation_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning curve of every classifier over nested training fractions (3 folds)."""
    s = M.classification_summary(_once("curve", _curve_run, spark, sf_dir), ["model", "fraction", "cv_fold", "role"], "y", "pred")
    cm = s.groupBy("model", "fraction", "cv_fold").pivot("role", ["test", "train"]).agg(F.first("f1_macro"))
    return M.learning_curve(cm, ["model"], "fraction", "train", "test")


@register("model_persist_roundtrip")
def model_persist_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, save to the shared checkpoint folder, load and batch-score all rows; ``n_same`` rows get
    the same probabilities from the loaded model as from the fitted one."""
    from ..sources.io import load_model, save_model
    feats = features_full()
    df = materialize(P.class_weights(model_input(spark, sf_dir), "quality_class"), "weighted")
    model = ML.classification_pipeline(ML.make_classifier("random_forest"), feats,
                                       "quality_class").fit(ML.dealt(df, "quality_class", NEAR))
    path = f"{ensure_checkpoint_dir(spark)}/models/rf-{uuid.uuid4().hex[:8]}"
    save_model(model, path)
    loaded = load_model(path)
    lab = _label_of(loaded.stages[0].labels, F.col("prediction"))
    probabilities = ML.vector_to_array("probability")
    before = model.transform(df).select(*df.columns, probabilities.alias("fitted"))
    scored = loaded.transform(before).select("quality_class", lab.alias("predicted_class"), (probabilities == F.col("fitted")).alias("same"))
    return scored.groupBy("quality_class", "predicted_class").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_same"))
