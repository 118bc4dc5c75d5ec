import pytest
from pyspark.sql import functions as F

from fixture_paths import SMALL
from riverlens.operators import quality as Q
from riverlens.sources.adapters import load_readings, load_survey


def test_fault_injection_is_detected(spark):
    bad = load_readings(spark, SMALL, faults=True)
    nulls = {r["column"]: r["n_bad"] for r in Q.null_counts(bad).collect()}
    assert nulls["ph"] > 0 and nulls["reading_id"] == 0
    assert Q.duplicate_rows(bad).first()["n_bad"] > 0
    with pytest.raises(Q.QualityError):
        Q.enforce(Q.null_counts(bad))


def test_clean_readings_pass_null_and_duplicate_checks(spark):
    ok = load_readings(spark, SMALL)
    Q.enforce(Q.null_counts(ok))
    Q.enforce(Q.duplicate_rows(ok))


def test_schema_contract(spark):
    r = load_readings(spark, SMALL)
    expected = [(f.name, f.dataType.simpleString()) for f in r.schema.fields]
    assert Q.schema_contract(r, expected).filter(~F.col("ok")).count() == 0
    assert Q.schema_contract(r.drop("wqi"), expected).filter(~F.col("ok")).count() == 1
    assert Q.schema_contract(r.withColumn("ph", F.col("ph").cast("float")), expected).filter(~F.col("ok")).count() == 1


def test_describe_quartiles_match_pandas(spark):
    r = load_readings(spark, SMALL)
    got = {row["variable"]: row for row in Q.describe(r).collect()}
    pdf = r.select("ph", "turbidity").toPandas()
    for c in ["ph", "turbidity"]:
        for name, q in [("p25", .25), ("p50", .5), ("p75", .75)]:
            assert abs(got[c][name] - pdf[c].quantile(q)) < 1e-6


def test_code_domain(spark):
    d = {r["column"]: r for r in Q.code_domain(load_survey(spark, SMALL)).collect()}
    assert d["SEX"]["observed"] == "1,2" and d["AGE"]["n_bad"] == 0
