"""Boundary tests for every alert threshold."""

import pytest
from pyspark.sql import functions as F

from riverlens.functions import levels as L
from riverlens.functions.text import display_round, fixed


def _eval(spark, col, values, dtype="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(col(F.col("x"))).collect()]


def test_ph_levels(spark):
    vals = [6.49, 6.5, 6.79, 6.8, 8.0, 8.01, 8.5, 8.51, None]
    assert _eval(spark, L.level_ph, vals) == [
        "CRÍTICO", "MALA", "MALA", "BUENA", "BUENA", "MALA", "MALA", "CRÍTICO", "NORMAL"]


def test_do_levels(spark):
    assert _eval(spark, L.level_do, [4.99, 5.0, 5.99, 6.0, 7.99, 8.0]) == [
        "CRÍTICO", "MALA", "MALA", "BUENA", "BUENA", "NORMAL"]


def test_turbidity_levels(spark):
    assert _eval(spark, L.level_turbidity, [10.0, 10.01, 25.0, 25.01, 50.0, 50.01]) == [
        "NORMAL", "BUENA", "BUENA", "MALA", "MALA", "CRÍTICO"]


def test_temperature_levels(spark):
    vals = [4.9, 5.0, 9.9, 10.0, 14.9, 15.0, 25.0, 25.1, 30.0, 30.1, 35.0, 35.1]
    assert _eval(spark, L.level_temperature, vals) == [
        "CRÍTICO", "MALA", "MALA", "BUENA", "BUENA", "NORMAL", "NORMAL", "BUENA", "BUENA", "MALA", "MALA", "CRÍTICO"]


def test_global_level_two_bad_lift_to_critical(spark):
    df = spark.createDataFrame([("MALA", "MALA", "NORMAL", "BUENA"), ("MALA", "BUENA", "NORMAL", "NORMAL"),
                                ("NORMAL", "NORMAL", "NORMAL", "NORMAL")], "a string, b string, c string, d string")
    got = [r[0] for r in df.select(L.global_level("a", "b", "c", "d")).collect()]
    assert got == ["CRÍTICO", "MALA", "NORMAL"]


@pytest.mark.parametrize("turb,delta,prob,expected", [
    (5.01, 0.0, 0.0, "ROJO"), (5.0, 0.0, 0.0, "VERDE"), (1.0, 1.51, 0.0, "AMARILLO"),
    (1.0, 1.5, 0.0, "VERDE"), (1.0, None, 0.21, "AMARILLO"), (1.0, None, 0.20, "VERDE")])
def test_layer1(spark, turb, delta, prob, expected):
    df = spark.createDataFrame([(turb, delta, prob)], "t double, d double, p double")
    assert df.select(L.layer1_level("t", "d", "p")).first()[0] == expected


@pytest.mark.parametrize("score,prob,delta,expected", [
    (0.65, 0.0, 0.0, "ROJO"), (0.45, 0.31, 0.0, "ROJO"), (0.45, 0.30, 0.0, "AMARILLO"),
    (0.35, 0.0, 0.0, "AMARILLO"), (0.34, 0.0, 1.51, "AMARILLO"), (0.34, 0.21, 0.0, "AMARILLO"),
    (0.34, 0.20, 1.5, "VERDE")])
def test_layer2(spark, score, prob, delta, expected):
    df = spark.createDataFrame([(score, prob, delta)], "s double, p double, d double")
    assert df.select(L.layer2_level("s", "p", "d")).first()[0] == expected


def test_text_rounds_like_python(spark):
    vals = [0.015, 0.125, 2.675, 1234.5678, -0.005]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(fixed("x", 2)).collect()]
    assert got == [f"{v:.2f}" for v in vals]
    rounded = [r[0] for r in df.select(display_round("x", 2)).collect()]
    assert rounded == [round(v, 2) for v in vals]


def test_reason_and_status(spark):
    df = spark.createDataFrame([(8.65, "CRÍTICO", "EXCELENTE", "ROJO")], "ph double, lv string, c string, l string")
    r = df.select(L.reason("ph", "lv"), L.class_status("c"), L.layer_number("l")).first()
    assert r[0] == "pH=8.65 fuera de rango (6.5–8.5)"
    assert r[1] == "verde" and r[2] == 3
