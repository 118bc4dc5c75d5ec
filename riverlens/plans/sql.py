"""ANSI SQL equivalents (DuckDB dialect) used as the correctness oracle.

Each builder returns SQL text over the driver's tables; the Spark code never
runs these -- they are the independent check that the DataFrame plans
compute the same rows.
"""

from __future__ import annotations

from ..schema import LAG_ORDER, LAGS, ROLLING_WINDOWS, TURBIDITY_DIFFS, features_full

READINGS = """
SELECT event_id AS reading_id, event_type AS station_id, CAST(ts AS TIMESTAMP) AS ts,
  CAST(630 + (event_id % 49) * 5 AS DOUBLE) / 100 AS ph,
  CAST(45 + (event_id * 7) % 76 AS DOUBLE) / 10 AS dissolved_oxygen,
  value / 30 AS turbidity,
  CAST(30 + (event_id * 11) % 341 AS DOUBLE) / 10 AS temperature,
  greatest(CAST(0 AS DOUBLE), 100 - value/12 - CAST(abs((event_id % 21) - 10) AS DOUBLE)/2) AS wqi,
  CASE WHEN event_id % 997 = 0 THEN 'BUENA'
       WHEN 100 - value/12 - CAST(abs((event_id % 21) - 10) AS DOUBLE)/2 >= 90 THEN 'EXCELENTE'
       WHEN 100 - value/12 - CAST(abs((event_id % 21) - 10) AS DOUBLE)/2 >= 80 THEN 'BUENA'
       ELSE 'ACEPTABLE' END AS quality_class
FROM events
"""

READINGS_FAULTY = """
WITH r AS (""" + READINGS + """),
holed AS (
  SELECT reading_id, station_id, ts,
    CASE WHEN reading_id % 101 = 0 THEN NULL ELSE ph END AS ph,
    CASE WHEN reading_id % 101 = 0 THEN NULL ELSE dissolved_oxygen END AS dissolved_oxygen,
    CASE WHEN reading_id % 101 = 0 THEN NULL ELSE turbidity END AS turbidity,
    CASE WHEN reading_id % 101 = 0 THEN NULL ELSE temperature END AS temperature,
    CASE WHEN reading_id % 101 = 0 THEN NULL ELSE wqi END AS wqi,
    quality_class
  FROM r)
SELECT * FROM holed UNION ALL SELECT * FROM holed WHERE reading_id % 103 = 0
"""

ITEM_A = [1, 1, 2, 2, 1, 1, 1, 3, 3, 3, 3, 2]
ITEM_B = [1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 30]

SURVEY = ("SELECT o_orderkey AS respondent_id,\n"
          "  CAST(1 + (o_custkey + o_orderkey) % 2 AS INT) AS SEX,\n"
          "  CAST(1 + o_custkey % 3 AS INT) AS AGE,\n"
          "  CAST(CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END AS INT) AS ZONE,\n"
          + ",\n".join(
              f"  CAST(least(5, greatest(1, 1 + (o_custkey * {a}) % 5 + ((o_orderkey * {b}) % 31) % 3 - 1)) AS INT) AS L{i + 1}"
              for i, (a, b) in enumerate(zip(ITEM_A, ITEM_B)))
          + "\nFROM orders")

W = "(PARTITION BY station_id ORDER BY ts, reading_id)"


def _rolling(agg: str, col: str, n: int) -> str:
    frame = f"(PARTITION BY station_id ORDER BY ts, reading_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) OVER {frame} = {n} THEN {agg}({col}) OVER {frame} END"


def features_sql(dropna: bool = True) -> str:
    """Readings + the 45 features + label, as one SELECT with window columns."""
    cols = ["r.*",
            "sin(2 * pi() * hour(ts) / 24) AS hour_sin",
            "cos(2 * pi() * hour(ts) / 24) AS hour_cos",
            "CAST(isodow(ts) - 1 AS INT) AS weekday",
            "CAST(dayofmonth(ts) AS INT) AS day_of_month"]
    cols += [f"lag({s}, {k}) OVER {W} AS {s}_lag{k}" for k in LAGS for s in LAG_ORDER]
    cols += [f"turbidity - lag(turbidity, {d}) OVER {W} AS turbidity_delta{d}" for d in TURBIDITY_DIFFS]
    cols += [f"{s} - lag({s}, 1) OVER {W} AS {s}_delta1" for s in ["ph", "dissolved_oxygen", "temperature"]]
    for n in ROLLING_WINDOWS:
        cols += [f"{_rolling('avg', 'turbidity', n)} AS turbidity_mean_{n}",
                 f"{_rolling('stddev_samp', 'turbidity', n)} AS turbidity_std_{n}",
                 f"{_rolling('max', 'turbidity', n)} AS turbidity_max_{n}",
                 f"{_rolling('avg', 'dissolved_oxygen', n)} AS dissolved_oxygen_mean_{n}"]
    cols += ["ln(1 + turbidity) AS turbidity_log",
             "CAST(turbidity > 5.0 AS INT) AS anomaly"]
    body = "SELECT " + ",\n  ".join(cols) + "\nFROM (" + READINGS + ") r"
    body = "SELECT f.*, abs(turbidity_delta1) AS turbidity_delta1_abs FROM (" + body + ") f"
    if dropna:
        body += "\nWHERE " + " AND ".join(f"{c} IS NOT NULL" for c in features_full())
    return body


LEVEL_PH = """CASE WHEN ph < 6.5 OR ph > 8.5 THEN 'CRÍTICO'
  WHEN ph >= 6.8 AND ph <= 8.0 THEN 'BUENA'
  WHEN (ph >= 6.5 AND ph < 6.8) OR (ph > 8.0 AND ph <= 8.5) THEN 'MALA' ELSE 'NORMAL' END"""
LEVEL_DO = """CASE WHEN dissolved_oxygen < 5.0 THEN 'CRÍTICO' WHEN dissolved_oxygen < 6.0 THEN 'MALA'
  WHEN dissolved_oxygen < 8.0 THEN 'BUENA' ELSE 'NORMAL' END"""
LEVEL_TURB = """CASE WHEN turbidity > 50.0 THEN 'CRÍTICO' WHEN turbidity > 25.0 THEN 'MALA'
  WHEN turbidity > 10.0 THEN 'BUENA' ELSE 'NORMAL' END"""
LEVEL_TEMP = """CASE WHEN temperature < 5.0 OR temperature > 35.0 THEN 'CRÍTICO'
  WHEN temperature < 10.0 OR temperature > 30.0 THEN 'MALA'
  WHEN temperature < 15.0 OR temperature > 25.0 THEN 'BUENA' ELSE 'NORMAL' END"""


def _sev(col: str) -> str:
    return f"(CASE {col} WHEN 'NORMAL' THEN 0 WHEN 'BUENA' THEN 1 WHEN 'MALA' THEN 2 WHEN 'CRÍTICO' THEN 3 END)"


REASON_SQL = {
    "level_ph": ("'pH=' || printf('%.2f', ph) || ' fuera de rango (6.5–8.5)'",
                 "'pH=' || printf('%.2f', ph) || ' en zona de advertencia'"),
    "level_do": ("'OD=' || printf('%.2f', dissolved_oxygen) || ' mg/L bajo mínimo vital (5.0)'",
                 "'OD=' || printf('%.2f', dissolved_oxygen) || ' mg/L en zona de estrés'"),
    "level_turbidity": ("'Turbidez=' || printf('%.2f', turbidity) || ' NTU sobre límite (50)'",
                        "'Turbidez=' || printf('%.2f', turbidity) || ' NTU alta'"),
    "level_temperature": ("'Temp=' || printf('%.2f', temperature) || '°C fuera de rango (5–35°C)'",
                          "'Temp=' || printf('%.2f', temperature) || '°C en estrés térmico'"),
}


def alerts_sql(source: str, prob: str = "CAST(0 AS DOUBLE)", score: str | None = None) -> str:
    """Levels, layers and reasons over ``source`` (a SELECT with readings + features)."""
    lv = (f"SELECT s.*, {prob} AS prob_aceptable, {LEVEL_PH} AS level_ph, {LEVEL_DO} AS level_do, "
          f"{LEVEL_TURB} AS level_turbidity, {LEVEL_TEMP} AS level_temperature FROM ({source}) s")
    sevs = [_sev(c) for c in ["level_ph", "level_do", "level_turbidity", "level_temperature"]]
    nbad = " + ".join(f"CAST({s} = 2 AS INT)" for s in sevs)
    final = f"CASE WHEN {nbad} >= 2 THEN 3 ELSE greatest({', '.join(sevs)}) END"
    parts = []
    for col, (crit, bad) in REASON_SQL.items():
        parts.append(f"CASE WHEN {col} = 'CRÍTICO' THEN {crit} WHEN {col} = 'MALA' THEN {bad} END")
    reasons = f"coalesce(nullif(concat_ws(' | ', {', '.join(parts)}), ''), 'Todas normales')"
    d = "coalesce(turbidity_delta1_abs, 0)"
    layer1 = (f"CASE WHEN turbidity > 5.0 THEN 'ROJO' WHEN {d} > 1.5 OR prob_aceptable > 0.20 "
              f"THEN 'AMARILLO' ELSE 'VERDE' END")
    cols = [f"CASE {final} WHEN 3 THEN 'CRÍTICO' WHEN 2 THEN 'MALA' WHEN 1 THEN 'BUENA' ELSE 'NORMAL' END AS level_global",
            f"{reasons} AS vars_in_alert", f"{layer1} AS level_layer1"]
    if score is not None:
        layer2 = (f"CASE WHEN {score} >= 0.65 OR ({score} >= 0.45 AND prob_aceptable > 0.30) THEN 'ROJO' "
                  f"WHEN {score} >= 0.35 OR {d} > 1.5 OR prob_aceptable > 0.20 THEN 'AMARILLO' ELSE 'VERDE' END")
        cols.append(f"{layer2} AS level_layer2")
    return f"SELECT l.*, {', '.join(cols)} FROM ({lv}) l"


def distribution_sql(source: str, columns: list[str], levels: list[str]) -> str:
    """Wide level distribution with zero cells kept, as the Spark pivot computes it."""
    unions = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS level FROM src" for c in columns)
    plain = [lv.replace("Í", "I").lower() for lv in levels]
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE level = '{lv}') AS BIGINT) AS n_{p}"
                       for lv, p in zip(levels, plain))
    pcts = ", ".join(f"round(n_{p} * 100.0 / n_total, 6) AS pct_{p}" for p in plain)
    return (f"WITH src AS ({source}), long AS ({unions}), "
            f"w AS (SELECT variable, {counts}, CAST(count(*) AS BIGINT) AS n_total FROM long GROUP BY variable) "
            f"SELECT *, {pcts} FROM w")


REASON_ALL_SQL = {
    "ph": ("level_ph", "'pH=' || printf('%.2f', ph) || ", [
        ("CRÍTICO", "' fuera de rango (6.5–8.5)'"), ("BUENA", "' en rango óptimo'"),
        ("MALA", "' en zona de advertencia'"), ("NORMAL", "' normal'")]),
    "dissolved_oxygen": ("level_do", "'OD=' || printf('%.2f', dissolved_oxygen) || ", [
        ("CRÍTICO", "' mg/L bajo mínimo vital (5.0)'"), ("MALA", "' mg/L en zona de estrés'"),
        ("BUENA", "' mg/L aceptable'"), ("NORMAL", "' mg/L óptimo'")]),
    "turbidity": ("level_turbidity", "'Turbidez=' || printf('%.2f', turbidity) || ", [
        ("CRÍTICO", "' NTU sobre límite (50)'"), ("MALA", "' NTU alta'"),
        ("BUENA", "' NTU moderada'"), ("NORMAL", "' NTU clara'")]),
    "temperature": ("level_temperature", "'Temp=' || printf('%.2f', temperature) || ", [
        ("CRÍTICO", "'°C fuera de rango (5–35°C)'"), ("MALA", "'°C en estrés térmico'"),
        ("BUENA", "'°C admisible'"), ("NORMAL", "'°C óptima'")]),
}


def reason_columns_sql() -> list[str]:
    out = []
    for var, (col, head, cases) in REASON_ALL_SQL.items():
        whens = " ".join(f"WHEN {col} = '{lv}' THEN {head}{tail}" for lv, tail in cases)
        out.append(f"CASE {whens} END AS reason_{var}")
    return out


def scored_sql(dropna: bool = True) -> str:
    """Features + rule-based probability and min-max anomaly score (no model)."""
    f = features_sql(dropna)
    raw = "abs(ph - 7.5) + abs(dissolved_oxygen - 9.0) / 3"
    return (f"SELECT f.*, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (85 - wqi) / 20)) AS prob_rule, "
            f"{raw} AS raw_score, ({raw} - min({raw}) OVER ()) / (max({raw}) OVER () - min({raw}) OVER () + 1e-9) "
            f"AS anomaly_score FROM ({f}) f")


PREDICTIONS = f"""
WITH r AS ({READINGS}), b AS (SELECT *, CAST(round(turbidity * 1000) AS BIGINT) AS t_milli FROM r)
SELECT 'm1' AS model, reading_id AS row_id, CAST(reading_id % 5 AS INT) AS fold, quality_class AS y_class,
  CASE WHEN wqi + 2 >= 90 THEN 'EXCELENTE' WHEN wqi + 2 >= 80 THEN 'BUENA' ELSE 'ACEPTABLE' END AS pred_class,
  wqi + 2 AS shifted, CAST(turbidity > 5.0 AS INT) AS y_bin,
  CAST(((reading_id * 37) % 1000) // 20 + least(50, t_milli // 100) AS DOUBLE) / 100 AS score,
  wqi AS y_reg, wqi + CAST((reading_id % 13) - 6 AS DOUBLE) / 4 AS p_reg FROM b
UNION ALL
SELECT 'm2', reading_id, CAST(reading_id % 5 AS INT), quality_class,
  CASE WHEN wqi - 2 >= 90 THEN 'EXCELENTE' WHEN wqi - 2 >= 80 THEN 'BUENA' ELSE 'ACEPTABLE' END,
  wqi - 2, CAST(turbidity > 5.0 AS INT),
  CAST(((reading_id * 53) % 1000) // 25 + least(60, t_milli // 80) AS DOUBLE) / 100,
  wqi, wqi - CAST((reading_id % 7) - 3 AS DOUBLE) / 2 FROM b
"""


def f1_ctes(src: str, g: list[str]) -> str:
    """CTEs ``pc`` (per-class precision/recall/f1/support) over ``src`` (g..., y, pred)."""
    gs = ", ".join(g)
    gsel = (gs + ", ") if g else ""
    using = ", ".join([*g, "label"])
    return f"""cm AS (SELECT {gsel}y, pred, count(*) AS n FROM {src} GROUP BY ALL),
lab AS (SELECT DISTINCT {gsel}y AS label FROM cm UNION SELECT DISTINCT {gsel}pred FROM cm),
tpc AS (SELECT {gsel}y AS label, n AS tp FROM cm WHERE y = pred),
sup AS (SELECT {gsel}y AS label, sum(n) AS support FROM cm GROUP BY ALL),
npr AS (SELECT {gsel}pred AS label, sum(n) AS n_pred FROM cm GROUP BY ALL),
pc0 AS (SELECT lab.*, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(n_pred, 0) AS n_pred
  FROM lab LEFT JOIN tpc USING ({using}) LEFT JOIN sup USING ({using}) LEFT JOIN npr USING ({using})),
pc1 AS (SELECT *, CASE WHEN n_pred > 0 THEN CAST(tp AS DOUBLE) / n_pred ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pc1)"""
