"""Schemas, feature lists and the fixed rule values of the monitoring domain."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Input contracts
# ---------------------------------------------------------------------------
SENSORS = ["ph", "dissolved_oxygen", "turbidity", "temperature"]

READINGS = T.StructType([
    T.StructField("reading_id", T.LongType()),
    T.StructField("station_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ph", T.DoubleType()),
    T.StructField("dissolved_oxygen", T.DoubleType()),
    T.StructField("turbidity", T.DoubleType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("wqi", T.DoubleType()),
    T.StructField("quality_class", T.StringType()),
])
READINGS_COLUMNS = [f.name for f in READINGS.fields]

LIKERT_ITEMS = [f"L{i}" for i in range(1, 13)]
DEMOGRAPHICS = ["SEX", "AGE", "ZONE"]
SURVEY_VARS = DEMOGRAPHICS + LIKERT_ITEMS
SURVEY = T.StructType(
    [T.StructField("respondent_id", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in SURVEY_VARS]
)
SURVEY_COLUMNS = [f.name for f in SURVEY.fields]

# ---------------------------------------------------------------------------
# Fixed values (must equal the monitored domain's published rules)
# ---------------------------------------------------------------------------
# Inclusive validity ranges per sensor column.
VALID_RANGES = {
    "ph": (6.5, 8.5),
    "dissolved_oxygen": (7.0, 14.0),
    "turbidity": (0.0, 50.0),
    "temperature": (20.0, 30.0),
    "wqi": (0.0, 100.0),
}
# Index -> class: >= 90 EXCELENTE, >= 80 BUENA, else ACEPTABLE.
CLASS_CUTS = [(90.0, "EXCELENTE"), (80.0, "BUENA")]
CLASS_DEFAULT = "ACEPTABLE"
CLASSES = ["ACEPTABLE", "BUENA", "EXCELENTE"]
ANOMALY_TURBIDITY = 5.0  # label: turbidity > 5 NTU
# Per-variable levels and severities.
LEVELS = ["NORMAL", "BUENA", "MALA", "CRÍTICO"]
SEVERITY = {"NORMAL": 0, "BUENA": 1, "MALA": 2, "CRÍTICO": 3}
LAYER_LEVELS = ["VERDE", "AMARILLO", "ROJO"]
ALL_NORMAL_TEXT = "Todas normales"
REASON_SEPARATOR = " | "
# Layer thresholds.
LAYER1 = {"red_turbidity": 5.0, "delta": 1.5, "prob": 0.20}
LAYER2 = {"red_score": 0.65, "red_score_mid": 0.45, "red_prob": 0.30,
          "amber_score": 0.35, "delta": 1.5, "prob": 0.20}
# Threshold reference table: variable, unit, NORMAL, BUENA, MALA, CRÍTICO, action.
THRESHOLD_TABLE = [
    ("pH", "Unidades", "6.8 – 8.0", "6.5–6.8 ó 8.0–8.5", "< 6.5 ó > 8.5", "< 6.5 ó > 8.5",
     "Verificar contaminación ácida/básica"),
    ("Oxígeno Disuelto", "mg/L", "> 8.0", "6.0 – 8.0", "5.0 – 6.0", "< 5.0",
     "Revisar materia orgánica / eutrofización"),
    ("Turbidez", "NTU", "≤ 10", "10 – 25", "25 – 50", "> 50",
     "Identificar fuente de sedimentos"),
    ("Temperatura", "°C", "15 – 25", "10–15 ó 25–30", "5–10 ó 30–35", "< 5 ó > 35",
     "Evaluar estrés térmico en ecosistema"),
]
# Class -> status colour, level -> number.
CLASS_STATUS = {"EXCELENTE": "verde", "BUENA": "amarillo", "ACEPTABLE": "rojo"}
LAYER_NUMBER = {"VERDE": 1, "AMARILLO": 2, "ROJO": 3}
# Survey code labels.
DEMO_LABELS = {
    "SEX": {1: "Masculino", 2: "Femenino"},
    "AGE": {1: "Rango etario 1", 2: "Rango etario 2", 3: "Rango etario 3"},
    "ZONE": {1: "Urbana", 2: "Rural"},
}
DEMO_DOMAINS = {"SEX": [1, 2], "AGE": [1, 2, 3], "ZONE": [1, 2]}
# Composite indices: name -> (items, reversed).
INDICES = {
    "IDX_deterioro": (["L1", "L2"], False),
    "IDX_desconfianza": (["L3", "L4"], True),
    "IDX_participacion": (["L5", "L6", "L7"], False),
    "IDX_tecnologia": (["L9", "L10", "L11"], False),
}

# ---------------------------------------------------------------------------
# Feature lists (order is part of the model contract)
# ---------------------------------------------------------------------------
LAGS = [1, 2, 4, 8, 16]
TURBIDITY_DIFFS = [1, 4, 8]
ROLLING_WINDOWS = [4, 8, 16]
MAX_LOOKBACK = max(LAGS + ROLLING_WINDOWS + TURBIDITY_DIFFS)
LAG_ORDER = ["ph", "turbidity", "dissolved_oxygen", "temperature"]


def features_full() -> list[str]:
    """The 45 model inputs, in a fixed order."""
    cols = list(SENSORS) + ["hour_sin", "hour_cos"]
    cols += [f"{s}_lag{k}" for k in LAGS for s in LAG_ORDER]
    cols += [f"turbidity_delta{d}" for d in TURBIDITY_DIFFS]
    cols += ["ph_delta1", "dissolved_oxygen_delta1", "temperature_delta1"]
    for w in ROLLING_WINDOWS:
        cols += [f"turbidity_mean_{w}", f"turbidity_std_{w}", f"turbidity_max_{w}",
                 f"dissolved_oxygen_mean_{w}"]
    cols.append("turbidity_log")
    return cols


def features_no_leak() -> list[str]:
    """Anomaly inputs: the full list minus every turbidity-derived column."""
    return [c for c in features_full() if "turb" not in c.lower()]
