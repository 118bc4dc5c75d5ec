"""Registered queries: survey descriptives, associations, reliability, factors (V*)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import p_value_text, stars
from ..operators import survey as V
from ..schema import DEMOGRAPHICS, INDICES, LIKERT_ITEMS, SURVEY_VARS
from ..sources.adapters import load_survey
from . import sql as S
from .catalog import register

SV = f"({S.SURVEY})"
ALL_PAIRS = V.all_pairs(SURVEY_VARS)
ITEM_PAIRS = V.all_pairs(LIKERT_ITEMS)
DEMO_ITEM_PAIRS = V.cross_pairs(DEMOGRAPHICS, LIKERT_ITEMS)
CONTRADICTIONS = [("L1", "L4"), ("L7", "L8")]


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def _moments_sql(item: str) -> str:
    return f"""SELECT '{item}' AS item, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd,
  CAST(min(x) AS DOUBLE) AS min, CAST(max(x) AS DOUBLE) AS max, quantile_cont(x, 0.5) AS median,
  avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5) AS skew,
  avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) - 3 AS kurt
FROM (SELECT CAST({item} AS DOUBLE) AS x, avg(CAST({item} AS DOUBLE)) OVER () AS mu FROM {SV} s) t"""


MOMENTS_SQL = " UNION ALL ".join(_moments_sql(c) for c in LIKERT_ITEMS)


@register("survey_skew", sql=f"""
SELECT item, round(skew, 6) AS skew, round(kurt, 6) AS kurt,
  CASE WHEN skew < -0.5 THEN 'negativa (sesgo izq.)' WHEN skew > 0.5 THEN 'positiva (sesgo der.)'
       ELSE 'simétrica' END AS direction FROM ({MOMENTS_SQL}) m""")
def survey_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1."""
    return V.skew_flags(load_survey(spark, sf_dir))


@register("survey_item_descriptives", sql=f"""
SELECT item, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(median, 6) AS median,
  round(min, 6) AS min, round(max, 6) AS max, round(skew, 6) AS skew, round(kurt, 6) AS kurt FROM ({MOMENTS_SQL}) m""")
def survey_item_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4."""
    return V.item_descriptives(load_survey(spark, sf_dir))


@register("survey_iqr_outliers", sql=" UNION ALL ".join(f"""
SELECT '{c}' AS item, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower,
  round(q3 + 1.5 * (q3 - q1), 6) AS upper,
  CAST((SELECT count(*) FROM {SV} s2 WHERE s2.{c} < q1 - 1.5 * (q3 - q1) OR s2.{c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {SV} s) q""" for c in LIKERT_ITEMS))
def survey_iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2."""
    return V.iqr_outliers(load_survey(spark, sf_dir))


_LABEL_ROWS = ", ".join(f"('{v}', {k}, '{lab}')" for v, m in
                        {"SEX": {1: "Masculino", 2: "Femenino"},
                         "AGE": {1: "Rango etario 1", 2: "Rango etario 2", 3: "Rango etario 3"},
                         "ZONE": {1: "Urbana", 2: "Rural"}}.items() for k, lab in m.items())


@register("survey_demographics", sql=f"""
WITH s AS {SV}, c AS ({' UNION ALL '.join(f"SELECT '{v}' AS variable, {v} AS code, count(*) AS n FROM s GROUP BY {v}" for v in DEMOGRAPHICS)}),
l AS (SELECT * FROM (VALUES {_LABEL_ROWS}) t(variable, code, label))
SELECT c.variable, c.code, coalesce(l.label, CAST(c.code AS VARCHAR)) AS label, CAST(c.n AS BIGINT) AS n,
  round(c.n * 100.0 / (SELECT count(*) FROM s), 6) AS pct
FROM c LEFT JOIN l ON c.variable = l.variable AND c.code = l.code""")
def survey_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3."""
    return V.demographic_profile(load_survey(spark, sf_dir))


_FREQ = " UNION ALL ".join(
    f"SELECT '{c}' AS item, " + ", ".join(f"CAST(count(*) FILTER (WHERE {c} = {k}) AS BIGINT) AS n_{k}" for k in range(1, 6))
    + f" FROM {SV} s" for c in LIKERT_ITEMS)
_FREQ_PCT = "SELECT *, " + ", ".join(
    f"round(n_{k} * 100.0 / (n_1 + n_2 + n_3 + n_4 + n_5), 6) AS pct_{k}" for k in range(1, 6)) + f" FROM ({_FREQ}) f"


@register("survey_frequencies", sql=_FREQ_PCT)
def survey_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5."""
    return V.frequency_table(load_survey(spark, sf_dir))


@register("survey_items_by_mean", sql=f"""
SELECT item, round(mean, 6) AS mean, round(sd, 6) AS sd,
  CAST(row_number() OVER (ORDER BY mean, item) AS INT) AS rank FROM ({MOMENTS_SQL}) m""")
def survey_items_by_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6."""
    return V.items_by_mean(load_survey(spark, sf_dir))


@register("survey_diverging", sql=f"""
WITH p AS ({_FREQ_PCT}), x AS (
  SELECT item, pct_4 + pct_5 AS agree, -(pct_1 + pct_2 + pct_3 / 2) AS s, pct_1, pct_2, pct_3, pct_4, pct_5 FROM p)
{' UNION ALL '.join(f"SELECT item, round(agree, 6) AS agree_pct, {c} AS category, round(pct_{c}, 6) AS pct, round(s{''.join(f' + pct_{k}' for k in range(1, c))}, 6) AS left, round(s{''.join(f' + pct_{k}' for k in range(1, c + 1))}, 6) AS right FROM x" for c in range(1, 6))}""")
def survey_diverging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7."""
    return V.diverging_layout(load_survey(spark, sf_dir))


@register("survey_box_counts", sql=" UNION ALL ".join(f"""
SELECT '{c}' AS item, count(*) FILTER (WHERE {c} >= 4) AS n_top, round(count(*) FILTER (WHERE {c} >= 4) * 100.0 / count(*), 6) AS pct_top,
  count(*) FILTER (WHERE {c} <= 2) AS n_bottom, round(count(*) FILTER (WHERE {c} <= 2) * 100.0 / count(*), 6) AS pct_bottom FROM {SV} s""" for c in LIKERT_ITEMS))
def survey_box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8."""
    return V.box_counts(load_survey(spark, sf_dir))


def _index_expr(items, reverse):
    terms = [f"(6 - {c})" if reverse else c for c in items]
    return f"CAST(({' + '.join(terms)}) AS DOUBLE) / {len(items)}"


@register("survey_index_stats", sql=" UNION ALL ".join(f"""
SELECT '{name}' AS index, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(quantile_cont(x, 0.5), 6) AS median,
  round(min(x), 6) AS min, round(max(x), 6) AS max FROM (SELECT {_index_expr(items, rev)} AS x FROM {SV} s) t"""
    for name, (items, rev) in INDICES.items()))
def survey_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9."""
    return V.index_stats(load_survey(spark, sf_dir))


def _bin(c: str) -> str:
    return (f"CASE WHEN {c} > 0 AND {c} <= 2 THEN 'Desacuerdo' WHEN {c} > 2 AND {c} <= 3 THEN 'Neutro' "
            f"WHEN {c} > 3 AND {c} <= 5 THEN 'Acuerdo' END")


@register("survey_crosstabs", sql=" UNION ALL ".join(f"""
SELECT '{a}' AS row_item, '{b}' AS col_item, coalesce(rc, 'All') AS row_cat, coalesce(cc, 'All') AS col_cat,
  CAST(count(*) AS BIGINT) AS n
FROM (SELECT {_bin(a)} AS rc, {_bin(b)} AS cc FROM {SV} s) t WHERE rc IS NOT NULL AND cc IS NOT NULL
GROUP BY CUBE (rc, cc)""" for a, b in CONTRADICTIONS))
def survey_crosstabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned cross-tabs with margins for the contradiction pairs."""
    sv = load_survey(spark, sf_dir)
    out = None
    for a, b in CONTRADICTIONS:
        ct = V.crosstab_margins(sv, a, b)
        out = ct if out is None else out.unionByName(ct)
    return out


@register("survey_contradictions", sql=" UNION ALL ".join(f"""
SELECT '{a}' AS item_a, '{b}' AS item_b, CAST(count(*) FILTER (WHERE {a} >= 4 AND {b} >= 4) AS BIGINT) AS n_both,
  round(count(*) FILTER (WHERE {a} >= 4 AND {b} >= 4) * 100.0 / count(*), 6) AS pct_both,
  round(avg({a}) - avg({b}), 6) AS mean_diff FROM {SV} s""" for a, b in CONTRADICTIONS))
def survey_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12."""
    return V.contradiction(load_survey(spark, sf_dir), CONTRADICTIONS)


def _ct_sql(pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, {a} AS v1, {b} AS v2, count(*) AS n FROM s "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}" for a, b in pairs)


def _chi_sql(pairs) -> str:
    return f"""
WITH s AS {SV}, ct AS ({_ct_sql(pairs)}),
rw AS (SELECT var1, var2, v1, sum(n) AS r_tot FROM ct GROUP BY ALL),
cl AS (SELECT var1, var2, v2, sum(n) AS c_tot FROM ct GROUP BY ALL),
tot AS (SELECT var1, var2, sum(n) AS n_total, count(DISTINCT v1) AS r, count(DISTINCT v2) AS k FROM ct GROUP BY ALL),
cells AS (SELECT rw.var1, rw.var2, rw.v1, cl.v2, coalesce(ct.n, 0) AS n, tot.n_total, tot.r, tot.k,
  (tot.r - 1) * (tot.k - 1) AS dof, CAST(r_tot * c_tot AS DOUBLE) / tot.n_total AS e
  FROM rw JOIN cl ON rw.var1 = cl.var1 AND rw.var2 = cl.var2
  LEFT JOIN ct ON ct.var1 = rw.var1 AND ct.var2 = rw.var2 AND ct.v1 = rw.v1 AND ct.v2 = cl.v2
  JOIN tot ON tot.var1 = rw.var1 AND tot.var2 = rw.var2),
chi AS (SELECT var1, var2, CAST(n_total AS BIGINT) AS n_total, CAST(r AS BIGINT) AS r, CAST(k AS BIGINT) AS k,
  CAST(dof AS BIGINT) AS dof,
  sum(CASE WHEN dof = 1 THEN power(abs(n - e) - least(0.5, abs(n - e)), 2) / e ELSE power(n - e, 2) / e END) AS chi2,
  min(e) AS min_expected FROM cells GROUP BY ALL)"""


def _v_sql() -> str:
    plain = "sqrt(chi2 / (n_total * (least(r, k) - 1)))"
    corr = ("CASE WHEN least(k - (k - 1) * (k - 1) / (n_total - 1.0), r - (r - 1) * (r - 1) / (n_total - 1.0)) - 1 > 0 "
            "THEN sqrt(greatest(0, chi2 / n_total - (k - 1) * (r - 1) / (n_total - 1.0)) / "
            "(least(k - (k - 1) * (k - 1) / (n_total - 1.0), r - (r - 1) * (r - 1) / (n_total - 1.0)) - 1)) ELSE 0 END")
    return f"SELECT *, {plain} AS v_plain, {corr} AS v_corrected FROM chi WHERE r >= 2 AND k >= 2"


def _scale_sql(col: str, scale: str) -> str:
    parts = []
    for bound, label in V.V_SCALES[scale]:
        parts.append(f"WHEN {col} < {bound} THEN '{label}'" if bound is not None else f"ELSE '{label}'")
    return "CASE " + " ".join(parts) + " END"


def _tests(spark, sf_dir, pairs):
    return V.pair_tests(load_survey(spark, sf_dir), pairs)


@register("survey_contingency", sql=f"WITH s AS {SV} SELECT var1, var2, v1, v2, CAST(n AS BIGINT) AS n FROM ({_ct_sql(ALL_PAIRS)}) c")
def survey_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 105 pair tables in one scan (long form)."""
    return V.pair_contingency(load_survey(spark, sf_dir), ALL_PAIRS)


@register("survey_chi_square", sql=_chi_sql(ALL_PAIRS) + """
SELECT var1, var2, n_total, r, k, dof, round(chi2, 6) AS chi2, round(min_expected, 6) AS min_expected FROM chi""")
def survey_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square with Yates' correction on 2x2 tables."""
    t = V.chi_square(V.pair_contingency(load_survey(spark, sf_dir), ALL_PAIRS))
    return t.select("var1", "var2", "n_total", "r", "k", "dof", *_r6("chi2", "min_expected"))


@register("survey_cramers_v", sql=_chi_sql(ALL_PAIRS) + f"""
SELECT var1, var2, round(v_plain, 6) AS v_plain, round(v_corrected, 6) AS v_corrected,
  {_scale_sql('v_corrected', 'strength')} AS strength, {_scale_sql('v_plain', 'graded')} AS strength_graded,
  {_scale_sql('v_plain', 'cohen')} AS magnitude FROM ({_v_sql()}) v""")
def survey_cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and bias-corrected Cramér's V with the three label scales."""
    t = _tests(spark, sf_dir, ALL_PAIRS)
    return t.select("var1", "var2", *_r6("v_plain", "v_corrected"), "strength", "strength_graded", "magnitude")


@register("survey_pair_tests")
def survey_pair_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chi-square or Fisher p-value per pair, stars and p text."""
    return _tests(spark, sf_dir, ALL_PAIRS)


@register("survey_fisher_small_sample")
def survey_fisher_small_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fisher's exact test of SEX x ZONE within every block of 64 respondents, where cells fall below 5."""
    return V.fisher_by_group(load_survey(spark, sf_dir).withColumn("block", F.floor(F.col("respondent_id") / 64)), "block", "SEX", "ZONE")


@register("survey_significant_pairs")
def survey_significant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P < .05 and corrected V >= .20, ordered by p."""
    return V.significant_pairs(_tests(spark, sf_dir, ALL_PAIRS)).orderBy("p_value", "var1", "var2")


# Chi-square quantiles at .95, .99 and .999 by degrees of freedom (published table).
CHI2_QUANTILES = {1: (3.841459, 6.634897, 10.827566), 2: (5.991465, 9.210340, 13.815511), 4: (9.487729, 13.276704, 18.466827),
                  8: (15.507313, 20.090235, 26.124482), 16: (26.296228, 31.999927, 39.252355)}


def _beyond_sql(level: int) -> str:
    """chi2 lies beyond its quantile (0: .95, 1: .99, 2: .999)."""
    return "chi2 > CASE dof " + " ".join(f"WHEN {dof} THEN {q[level]}" for dof, q in CHI2_QUANTILES.items()) + " END"


_STARS_SQL = f"CASE WHEN {_beyond_sql(2)} THEN '***' WHEN {_beyond_sql(1)} THEN '**' WHEN {_beyond_sql(0)} THEN '*' ELSE 'ns' END"


@register("survey_significant_sets", sql=_chi_sql(ALL_PAIRS) + f", v AS ({_v_sql()}), t AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS set, var1, var2, chi2, dof, {col} AS v FROM v WHERE {_beyond_sql(2 if p == 0.001 else 0)} AND {col} >= {low}"
    for name, (p, low, col) in V.SIGNIFICANT.items()) + f""")
SELECT set, CAST(row_number() OVER (PARTITION BY set ORDER BY v DESC, var1, var2) AS INT) AS place, var1, var2, round(chi2, 6) AS chi2, dof,
  round(v, 6) AS v, {_STARS_SQL} AS stars FROM t""")
def survey_significant_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three threshold sets (.05 / .20, .001 / .40, .001 / .30), each from its strongest pair."""
    t = V.significant_sets(_tests(spark, sf_dir, ALL_PAIRS))
    return t.select("set", "place", "var1", "var2", *_r6("chi2"), "dof", *_r6("v"), "stars")


@register("survey_top_chi2_pairs", sql=_chi_sql(ALL_PAIRS) + f"""
SELECT var1, var2, round(chi2, 6) AS chi2, dof, {_STARS_SQL} AS stars FROM ({_v_sql()}) v ORDER BY v.chi2 DESC, var1, var2 LIMIT 10""")
def survey_top_chi2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 pairs by chi-square, without a filter (a top-k report)."""
    t = V.top_pairs(_tests(spark, sf_dir, ALL_PAIRS), "chi2", 10)
    return t.select("var1", "var2", *_r6("chi2"), "dof", "stars")


def _fallback_sql(pairs, v_min: float) -> str:
    return _chi_sql(pairs) + f""", v AS (SELECT *, {_beyond_sql(2)} AND v_plain >= {v_min} AS filtered FROM ({_v_sql()}) w)
SELECT var1, var2, round(chi2, 6) AS chi2, round(v_plain, 6) AS v_plain, filtered FROM v
WHERE filtered OR NOT EXISTS (SELECT 1 FROM v x WHERE x.filtered) ORDER BY v.v_plain DESC, var1, var2 LIMIT 10"""


@register("survey_top_strong_items", sql=_fallback_sql(ITEM_PAIRS, 0.30))
def survey_top_strong_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten strongest item pairs with p < .001 and V >= .30."""
    t = V.top_significant_pairs(_tests(spark, sf_dir, ITEM_PAIRS), 0.001, 0.30)
    return t.select("var1", "var2", *_r6("chi2", "v_plain"), "filtered")


@register("survey_top_strong_demographics", sql=_fallback_sql(DEMO_ITEM_PAIRS, 0.95))
def survey_top_strong_demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demographic pairs with p < .001 and V >= .95; none passes, so the strongest of all are shown."""
    t = V.top_significant_pairs(_tests(spark, sf_dir, DEMO_ITEM_PAIRS), 0.001, 0.95)
    return t.select("var1", "var2", *_r6("chi2", "v_plain"), "filtered")


@register("survey_p_text", sql=f"""
WITH p AS (SELECT respondent_id, CAST(100 + (respondent_id * 37) % 900 AS DOUBLE) / power(10, 3 + respondent_id % 5) AS p FROM {SV} s)
SELECT respondent_id, CASE WHEN p < 1e-4 THEN printf('%.2e', p) WHEN p < 1e-3 THEN printf('%.5f', p) ELSE printf('%.4f', p) END AS p_text,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM p""")
def survey_p_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and stars of p-values of every size, one per respondent."""
    rid = F.col("respondent_id")
    p = (F.lit(100) + (rid * 37) % 900).cast("double") / F.pow(F.lit(10.0), 3 + rid % 5)
    return load_survey(spark, sf_dir).select("respondent_id", p.alias("p")).select("respondent_id", p_value_text("p").alias("p_text"), stars("p").alias("stars"))


def _top_sql(pairs, family: str) -> str:
    return _chi_sql(pairs) + f"""
SELECT '{family}' AS family, var1, var2, round(chi2, 6) AS chi2, dof, round(v_plain, 6) AS v_plain,
  {_scale_sql('v_plain', 'cohen')} AS magnitude
FROM ({_v_sql()}) v ORDER BY v_plain DESC, var1, var2 LIMIT 10"""


@register("survey_top_item_pairs", sql=_top_sql(ITEM_PAIRS, "item_item"))
def survey_top_item_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 item x item pairs by plain V (a top-k report)."""
    t = V.top_pairs(_tests(spark, sf_dir, ITEM_PAIRS), "v_plain", 10)
    return t.select(F.lit("item_item").alias("family"), "var1", "var2", *_r6("chi2"), "dof", *_r6("v_plain"), "magnitude")


@register("survey_top_demographic_pairs", sql=_top_sql(DEMO_ITEM_PAIRS, "demographic_item"))
def survey_top_demographic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 demographic x item pairs by plain V."""
    t = V.top_pairs(_tests(spark, sf_dir, DEMO_ITEM_PAIRS), "v_plain", 10)
    return t.select(F.lit("demographic_item").alias("family"), "var1", "var2", *_r6("chi2"), "dof",
                    *_r6("v_plain"), "magnitude")


def _alpha_sql(items: list[str]) -> str:
    k = len(items)
    total = " + ".join(items)
    return f"{k / (k - 1)!r} * (1 - ({' + '.join(f'var_samp({c})' for c in items)}) / var_samp({total}))"


@register("survey_alpha", sql=" UNION ALL ".join(f"""
SELECT '{c}' AS item, round(a, 6) AS alpha, round(a_wo, 6) AS alpha_if_deleted, round(a_wo - a, 6) AS delta,
  a_wo - a > 0.01 AS consider_removal,
  CASE WHEN a >= 0.9 THEN 'excelente' WHEN a >= 0.8 THEN 'buena' WHEN a >= 0.7 THEN 'aceptable'
       WHEN a >= 0.6 THEN 'cuestionable' ELSE 'inaceptable' END AS label
FROM (SELECT {_alpha_sql(LIKERT_ITEMS)} AS a, {_alpha_sql([x for x in LIKERT_ITEMS if x != c])} AS a_wo FROM {SV} s) t"""
    for c in LIKERT_ITEMS))
def survey_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cronbach's alpha and alpha if item deleted."""
    return V.cronbach_alpha(load_survey(spark, sf_dir))


@register("survey_index_alpha", sql=" UNION ALL ".join(f"""
SELECT '{name}' AS index, round(a, 6) AS alpha,
  CASE WHEN a >= 0.9 THEN 'excelente' WHEN a >= 0.8 THEN 'buena' WHEN a >= 0.7 THEN 'aceptable'
       WHEN a >= 0.6 THEN 'cuestionable' ELSE 'inaceptable' END AS label
FROM (SELECT {_alpha_sql(items)} AS a FROM {SV} s) t""" for name, (items, _) in INDICES.items()))
def survey_index_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha of each composite index's items."""
    return V.index_alphas(load_survey(spark, sf_dir))


def _avg_rank(c: str) -> str:
    return (f"(rank() OVER (ORDER BY {c}) + rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) - 1) / 2.0")


@register("survey_spearman", sql=f"""
WITH rk AS (SELECT {', '.join(f'{_avg_rank(c)} AS {c}' for c in LIKERT_ITEMS)} FROM {SV} s)
""" + " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM rk"
                         for a, b in ITEM_PAIRS))
def survey_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman matrix (average ranks from the value histogram)."""
    c = V.correlation_pairs(load_survey(spark, sf_dir), LIKERT_ITEMS, "spearman")
    return c.select("var1", "var2", *_r6("r"), "n")


@register("survey_spearman_tests")
def survey_spearman_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values, stars, strong and collinear pairs."""
    return V.spearman_tests(load_survey(spark, sf_dir))


@register("survey_pearson", sql=" UNION ALL ".join(
    f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM {SV} s"
    for a, b in ITEM_PAIRS))
def survey_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V27."""
    c = V.correlation_pairs(load_survey(spark, sf_dir), LIKERT_ITEMS, "pearson")
    return c.select("var1", "var2", *_r6("r"), "n")


@register("survey_factor_adequacy")
def survey_factor_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KMO, Bartlett sphericity and eigenvalues with the Kaiser rule.

    The 12 x 12 correlation matrix comes from one Spark aggregate; only that
    matrix (bounded by the number of items) is inverted on the driver.
    """
    fs = V.factor_summary(load_survey(spark, sf_dir))
    rows = [(i + 1, float(ev), bool(ev > 1), fs["kmo"], V.kmo_label(fs["kmo"]), fs["bartlett_chi2"],
             fs["bartlett_dof"], fs["bartlett_p"], bool(fs["kmo"] >= 0.60 and fs["bartlett_p"] < 0.05))
            for i, ev in enumerate(fs["eigenvalues"])]
    return spark.createDataFrame(rows, "factor int, eigenvalue double, kaiser boolean, kmo double, kmo_label string, "
                                       "bartlett_chi2 double, bartlett_dof int, bartlett_p double, efa_viable boolean")


@register("survey_factor_loadings")
def survey_factor_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unrotated principal loadings of the Kaiser factors, SS and variance shares."""
    fs = V.factor_summary(load_survey(spark, sf_dir))
    rows = []
    for j in range(fs["n_kaiser"]):
        for i, item in enumerate(fs["items"]):
            rows.append((f"F{j + 1}", item, float(fs["loadings"][i, j]), float(fs["ss"][j]),
                         float(fs["proportion"][j]), float(fs["cumulative"][j])))
    return spark.createDataFrame(rows, "factor string, item string, loading double, ss double, "
                                       "proportion double, cumulative double")


_EDGE_SQL = _chi_sql(ITEM_PAIRS) + f", v AS ({_v_sql()})"


@register("survey_graph_edges", sql=_EDGE_SQL + " SELECT var1, var2, round(v_plain, 6) AS v FROM v WHERE v_plain >= 0.40")
def survey_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association edges (plain V >= .40 among items)."""
    edges, _ = V.association_graph(_tests(spark, sf_dir, ITEM_PAIRS))
    return edges.select("var1", "var2", *_r6("v"))


@register("survey_graph_degree", sql=_EDGE_SQL + """
SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (
  SELECT var1 AS node FROM v WHERE v_plain >= 0.40 UNION ALL SELECT var2 FROM v WHERE v_plain >= 0.40) e GROUP BY node""")
def survey_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node degree of the association graph."""
    _, deg = V.association_graph(_tests(spark, sf_dir, ITEM_PAIRS))
    return deg
