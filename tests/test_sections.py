"""Exact rank cuts by counting against sorting, at every size of a pass and of the last step."""
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverlens.operators import splits as P
from riverlens.plans import ordering as O


def brute(rows, sizes, takes=lambda r: True):
    """Section of each row by (group, order, tie); rows equal in both lie where the first of them lies."""
    groups = defaultdict(list)
    for r in rows:
        if takes(r):
            groups[r[1]].append(r)
    out = {}
    for g, members in groups.items():
        # a null counts as the smallest value there is
        low_o = min((r[2] for r in rows if r[2] is not None), default=0)
        members.sort(key=lambda r: (low_o if r[2] is None else r[2], r[3]))
        place = {}
        for i, r in enumerate(members):
            place.setdefault((low_o if r[2] is None else r[2], r[3]), i)
        wanted = sizes(len(members))
        for r in members:
            out[r[0]] = sum(s <= place[low_o if r[2] is None else r[2], r[3]] for s in wanted)
    return out


@pytest.mark.parametrize("leaf,digit", [(4096, 12), (3, 3), (1, 1)])
def test_sections_equal_sorting(spark, monkeypatch, leaf, digit):
    monkeypatch.setattr(O, "LEAF_ROWS", leaf)
    monkeypatch.setattr(O, "DIGIT", digit)
    rng = np.random.default_rng(11)
    rows = [(i, [None, "a", "b", "c"][int(rng.integers(0, 4))], None if rng.random() < 0.05 else int(rng.integers(-40, 40)), i * 7 % 60) for i in range(60)]
    rows += [(100, "one", 5, 0)]
    df = spark.createDataFrame(rows, "id long, g string, o long, t long").repartition(3)
    sizes = F.array(F.floor(F.col("n") / 3), F.ceil(F.col("n") * 0.8), F.lit(0).cast("long"), F.col("n"), F.col("n") + 5)
    got = {r.id: r.section for r in O.sections(df, ["g"], F.col("o"), F.col("t"), sizes).collect()}
    assert got == brute(rows, lambda n: [n // 3, -(-n * 4 // 5), 0, n, n])
    part = {r.id: r.section for r in O.sections(df, ["g"], F.col("o"), F.col("t"), sizes, rows=F.col("id") % 2 == 0).collect()}
    want = brute(rows, lambda n: [n // 3, -(-n * 4 // 5), 0, n, n], lambda r: r[0] % 2 == 0)
    assert part == {r[0]: want.get(r[0]) for r in rows}


def test_sections_without_rows_or_groups(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id long, o long")
    whole = O.sections(df, [], F.col("o"), F.col("id"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    assert {r.id: r.section for r in whole.collect()} == {1: 2, 2: 0, 3: 1}
    assert O.sections(df.limit(0), [], F.col("o"), F.col("id"), F.array(F.col("n"))).count() == 0
    assert {r.section for r in O.sections(df, [], F.col("o"), F.col("id"), F.array(F.col("n")), rows=F.lit(False)).collect()} == {None}


def test_features_are_not_shuffled(spark):
    df = spark.range(9000).selectExpr("id as reading_id", "id % 3 as label", "cast(id as double) as feature")
    for split in (P.stratified_split(df, "label"), P.stratified_folds(df, "label"), P.first_fraction(df, [0.3, 1.0])):
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "SortMergeJoin" not in plan


def test_roles_of_a_short_series(spark):
    """Fewer readings than folds: no test rows, all train."""
    df = spark.createDataFrame([(i, "a", f"2026-01-01 00:0{i}:00") for i in range(3)], "reading_id long, station_id string, ts string")
    roles = [r.roles for r in P.time_roles(df.withColumn("ts", F.to_timestamp("ts"))).collect()]
    assert roles == [["train"] * 5] * 3
