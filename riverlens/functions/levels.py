"""Alert rule column functions (A1-A9, A20). Pure Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASS_STATUS, LAYER1, LAYER2, LAYER_NUMBER, SEVERITY
from .text import fixed

CRIT, BAD, GOOD, NORMAL = "CRÍTICO", "MALA", "BUENA", "NORMAL"

# Reason texts per variable and level ({v} = value with 2 decimals).
REASONS = {
    "ph": {CRIT: "pH={v} fuera de rango (6.5–8.5)", GOOD: "pH={v} en rango óptimo",
           BAD: "pH={v} en zona de advertencia", NORMAL: "pH={v} normal"},
    "dissolved_oxygen": {CRIT: "OD={v} mg/L bajo mínimo vital (5.0)", BAD: "OD={v} mg/L en zona de estrés",
                         GOOD: "OD={v} mg/L aceptable", NORMAL: "OD={v} mg/L óptimo"},
    "turbidity": {CRIT: "Turbidez={v} NTU sobre límite (50)", BAD: "Turbidez={v} NTU alta",
                  GOOD: "Turbidez={v} NTU moderada", NORMAL: "Turbidez={v} NTU clara"},
    "temperature": {CRIT: "Temp={v}°C fuera de rango (5–35°C)", BAD: "Temp={v}°C en estrés térmico",
                    GOOD: "Temp={v}°C admisible", NORMAL: "Temp={v}°C óptima"},
}
LEVEL_COLUMNS = {"ph": "level_ph", "dissolved_oxygen": "level_do",
                 "turbidity": "level_turbidity", "temperature": "level_temperature"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def level_ph(ph="ph") -> Column:
    """A1: CRÍTICO outside [6.5, 8.5]; BUENA in [6.8, 8.0]; MALA in the margins."""
    v = _c(ph)
    return (F.when((v < 6.5) | (v > 8.5), CRIT)
             .when((v >= 6.8) & (v <= 8.0), GOOD)
             .when(((v >= 6.5) & (v < 6.8)) | ((v > 8.0) & (v <= 8.5)), BAD)
             .otherwise(NORMAL))


def level_do(do="dissolved_oxygen") -> Column:
    """A2: < 5 CRÍTICO, < 6 MALA, < 8 BUENA, else NORMAL."""
    v = _c(do)
    return F.when(v < 5.0, CRIT).when(v < 6.0, BAD).when(v < 8.0, GOOD).otherwise(NORMAL)


def level_turbidity(turb="turbidity") -> Column:
    """A3: > 50 CRÍTICO, > 25 MALA, > 10 BUENA, else NORMAL."""
    v = _c(turb)
    return F.when(v > 50.0, CRIT).when(v > 25.0, BAD).when(v > 10.0, GOOD).otherwise(NORMAL)


def level_temperature(temp="temperature") -> Column:
    """A4: outside 5-35 CRÍTICO, outside 10-30 MALA, outside 15-25 BUENA, else NORMAL."""
    v = _c(temp)
    return (F.when((v < 5.0) | (v > 35.0), CRIT)
             .when((v < 10.0) | (v > 30.0), BAD)
             .when((v < 15.0) | (v > 25.0), GOOD)
             .otherwise(NORMAL))


LEVEL_FUNCTIONS = {"ph": level_ph, "dissolved_oxygen": level_do,
                   "turbidity": level_turbidity, "temperature": level_temperature}


def reason(variable: str, level: Column | str, value: Column | str | None = None) -> Column:
    """A5: the reason text for ``variable`` at ``level``, value printed with 2 decimals."""
    value = _c(value if value is not None else variable)
    lvl = _c(level)
    txt = fixed(value, 2)
    expr = None
    for name, template in REASONS[variable].items():
        head, tail = template.split("{v}")
        piece = F.concat(F.lit(head), txt, F.lit(tail))
        expr = F.when(lvl == name, piece) if expr is None else expr.when(lvl == name, piece)
    return expr


def severity(level: Column | str) -> Column:
    """NORMAL 0, BUENA 1, MALA 2, CRÍTICO 3."""
    lvl = _c(level)
    expr = None
    for name, sev in SEVERITY.items():
        expr = F.when(lvl == name, sev) if expr is None else expr.when(lvl == name, sev)
    return expr


def global_level(*levels: Column | str) -> Column:
    """Worst variable level; two or more MALA lift the result to CRÍTICO."""
    sev = [severity(lv) for lv in levels]
    worst = F.greatest(*sev)
    n_bad = sum((s == 2).cast("int") for s in sev)
    final = F.when(n_bad >= 2, F.lit(3)).otherwise(worst)
    return (F.when(final == 3, CRIT).when(final == 2, BAD)
             .when(final == 1, GOOD).otherwise(NORMAL))


def layer1_level(turbidity="turbidity", abs_delta="turbidity_delta1_abs",
                 prob="prob_aceptable", t=LAYER1) -> Column:
    """ROJO if turbidity > 5; AMARILLO if |delta| > 1.5 or P > .20; else VERDE."""
    d = F.coalesce(_c(abs_delta), F.lit(0.0))
    return (F.when(_c(turbidity) > t["red_turbidity"], "ROJO")
             .when((d > t["delta"]) | (_c(prob) > t["prob"]), "AMARILLO")
             .otherwise("VERDE"))


def layer2_level(score="anomaly_score", prob="prob_aceptable",
                 abs_delta="turbidity_delta1_abs", t=LAYER2) -> Column:
    """Score-driven level with the probability and delta as secondary triggers."""
    s, p = _c(score), _c(prob)
    d = F.coalesce(_c(abs_delta), F.lit(0.0))
    return (F.when((s >= t["red_score"]) | ((s >= t["red_score_mid"]) & (p > t["red_prob"])), "ROJO")
             .when((s >= t["amber_score"]) | (d > t["delta"]) | (p > t["prob"]), "AMARILLO")
             .otherwise("VERDE"))


def class_from_index(wqi="wqi") -> Column:
    """Q6 rule: >= 90 EXCELENTE, >= 80 BUENA, else ACEPTABLE."""
    v = _c(wqi)
    return F.when(v >= 90, "EXCELENTE").when(v >= 80, "BUENA").otherwise("ACEPTABLE")


def class_status(cls="quality_class") -> Column:
    """Class -> status colour."""
    m = F.create_map(*[F.lit(x) for kv in CLASS_STATUS.items() for x in kv])
    return m[_c(cls)]


def layer_number(level) -> Column:
    """VERDE 1, AMARILLO 2, ROJO 3."""
    m = F.create_map(*[F.lit(x) for kv in LAYER_NUMBER.items() for x in kv])
    return m[_c(level)]
