import math

import numpy as np
from pyspark.sql import functions as F

from fixture_paths import SMALL
from riverlens.functions.distributions import chi2_sf, fisher_two_sided, t_two_sided
from riverlens.operators import survey as V
from riverlens.sources.adapters import load_survey


def test_published_critical_values():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(chi2_sf(9.487729036781154, 4) - 0.05) < 1e-9
    assert abs(chi2_sf(26.29622760486423, 16) - 0.05) < 1e-9
    assert abs(t_two_sided(2.228138851986274, 10) - 0.05) < 1e-9
    assert abs(fisher_two_sided(8, 2, 1, 5) - 0.034965034965035) < 1e-9


def test_cramers_v_symmetric_and_bounded(spark):
    sv = load_survey(spark, SMALL)
    t1 = {(r.var1, r.var2): r.v_plain for r in V.pair_tests(sv, [("L1", "L2"), ("SEX", "L3")]).collect()}
    t2 = {(r.var2, r.var1): r.v_plain for r in V.pair_tests(sv, [("L2", "L1"), ("L3", "SEX")]).collect()}
    for k in t1:
        assert 0 <= t1[k] <= 1 and abs(t1[k] - t2[k]) < 1e-9


def test_chi_square_matches_numpy(spark):
    sv = load_survey(spark, SMALL)
    t = V.chi_square(V.pair_contingency(sv, [("AGE", "L1")])).first()
    pdf = sv.select("AGE", "L1").toPandas()
    ct = pdf.groupby(["AGE", "L1"]).size().unstack(fill_value=0).to_numpy(float)
    e = ct.sum(1, keepdims=True) * ct.sum(0, keepdims=True) / ct.sum()
    assert abs(t.chi2 - ((ct - e) ** 2 / e).sum()) < 1e-9


def test_alpha_of_duplicated_items_is_one(spark):
    sv = load_survey(spark, SMALL).withColumn("L1b", F.col("L1")).withColumn("L1c", F.col("L1"))
    a = V.cronbach_alpha(sv, ["L1", "L1b", "L1c"], deleted=False).first()["alpha"]
    assert abs(a - 1.0) < 1e-9


def test_spearman_matches_pandas(spark):
    sv = load_survey(spark, SMALL)
    got = {(r.var1, r.var2): r.r for r in V.correlation_pairs(sv, ["L1", "L2", "L9"], "spearman").collect()}
    pdf = sv.select("L1", "L2", "L9").toPandas()
    exp = pdf.rank().corr()
    for (a, b), r in got.items():
        assert abs(r - exp.loc[a, b]) < 1e-9


def test_fisher_used_for_small_two_by_two(spark):
    sv = load_survey(spark, SMALL).filter(F.col("respondent_id") < 60)
    row = V.pair_tests(sv, [("SEX", "ZONE")]).first()
    assert row.test == "Fisher" and row.chi2_reported is None and 0 <= row.p_value <= 1
