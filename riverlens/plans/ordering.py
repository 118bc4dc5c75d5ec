"""Row order within a series, without one task per series.

A station's readings form one ordered series. ``Window.partitionBy(station)``
would put a whole station (possibly a third of all rows) into one task, so
row-based lags and rolling frames are computed on *blocks* instead:

1. ``sequence_index`` range-partitions on (key, ts) -- Spark samples the
   keys, so a hot station is split across many tasks -- sorts within each
   partition and numbers rows with ``monotonically_increasing_id``.  A tiny
   per-(partition, key) count table turns those ids into a 0-based
   position ``seq`` inside the key.
2. ``framed`` cuts every key into blocks of ``block_rows`` consecutive rows
   and copies the last ``halo`` rows of each block into the next one, so a
   window over (key, block) sees every row that a frame of ``halo`` rows
   can reach.  Work per task is bounded by ``block_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAX_LOOKBACK
from ..session import materialize

DEFAULT_BLOCK_ROWS = 1 << 15     # small enough that a few stations keep every core busy; a halo is 16 rows
SEQ, BLOCK, HALO = "seq", "block", "is_halo"


def sequence_index(df: DataFrame, key: str = "station_id", order: str = "ts",
                   tiebreak: str = "reading_id", partitions: int | None = None) -> DataFrame:
    """Add ``seq``: the 0-based position of each row within its key by (order, tiebreak)."""
    ordered = (df.repartitionByRange(*([partitions] if partitions else []), key, order, tiebreak)
                 .sortWithinPartitions(key, order, tiebreak)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id()))
    # Both branches below must see the same ranges: a second run of the exchange may sample
    # other bounds, so the numbered rows are written once to the shared folder.
    ordered = materialize(ordered, "ordered")
    runs = ordered.groupBy("_pid", key).agg(F.min("_mid").alias("_first"),
                                            F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_pid", key, "_first",
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # ``runs`` has one row per (partition, key): AQE broadcasts it when its
    # measured size is under the broadcast threshold, else it shuffles.
    return (ordered.join(runs, ["_pid", key])
                   .withColumn(SEQ, F.col("_mid") - F.col("_first") + F.col("_offset"))
                   .drop("_pid", "_mid", "_first", "_offset"))


def framed(df: DataFrame, key: str = "station_id", halo: int = MAX_LOOKBACK,
           block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Add ``block`` and ``is_halo``; halo rows are copies from the previous block."""
    if block_rows < halo:
        raise ValueError("block_rows must be at least the halo size")
    body = df.withColumn(BLOCK, F.floor(F.col(SEQ) / block_rows)).withColumn(HALO, F.lit(False))
    tail = (body.filter(F.col(SEQ) % block_rows >= block_rows - halo)
                .withColumn(BLOCK, F.col(BLOCK) + 1)
                .withColumn(HALO, F.lit(True)))
    return body.unionByName(tail)


def block_window(key: str = "station_id") -> Window:
    """The one ordered window spec shared by every series column."""
    return Window.partitionBy(key, BLOCK).orderBy(SEQ)


def carry_max(df: DataFrame, value: str, key: str = "station_id") -> DataFrame:
    """Per (key, block): running max of ``value`` over all *earlier* blocks.

    Works on a table with one row per block, so the window over the key is
    small even for a hot key.
    """
    per_block = df.groupBy(key, BLOCK).agg(F.max(value).alias("_blk_max"))
    w = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(key, BLOCK, F.max("_blk_max").over(w).alias(f"{value}_carry"))


def weighted_prefix(df: DataFrame, keys: list[str], order: str, weight,
                    partitions: int | None = None) -> DataFrame:
    """Add ``cum_before``: sum of ``weight`` over rows of the same keys with a smaller ``order``.

    Range partitioning spreads a hot key over many tasks; each task sums its
    own slice, and a table with one row per (partition, key) supplies the
    offsets of the earlier slices. The ranged rows are written once with their
    partition number: two exchanges may sample different bounds, and slices
    and rows would then not belong together.
    """
    weights = [weight] if isinstance(weight, str) else list(weight)
    outs = ["cum_before"] if isinstance(weight, str) else [f"cum_before_{w}" for w in weights]
    ranged = (df.repartitionByRange(*([partitions] if partitions else []), *keys, order)
                .withColumn("_pid", F.spark_partition_id()))
    ranged = materialize(ranged, "ranged")
    local = Window.partitionBy("_pid", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    slices = ranged.groupBy("_pid", *keys).agg(*[F.sum(w).alias(f"_slice{i}") for i, w in enumerate(weights)])
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("_pid", *keys, *[F.coalesce(F.sum(f"_slice{i}").over(earlier), F.lit(0)).alias(f"_off{i}")
                                             for i in range(len(weights))])
    out = ranged.select("*", *[F.coalesce(F.sum(w).over(local), F.lit(0)).alias(f"_local{i}")
                               for i, w in enumerate(weights)]).join(offsets, ["_pid", *keys])
    out = out.select("*", *[(F.col(f"_local{i}") + F.col(f"_off{i}")).alias(o) for i, o in enumerate(outs)])
    return out.drop("_pid", *[f"_local{i}" for i in range(len(weights))], *[f"_off{i}" for i in range(len(weights))])


# ------------------------------------------------------------- exact rank cuts
DIGIT = 12              # bits that one counting pass narrows a cut by
LEAF_ROWS = 4096        # rows between which the last step sorts


def _digits(bits: int) -> list[int]:
    return list(range(max(bits - DIGIT, 0), 0, -DIGIT)) + [0]


def sections(df: DataFrame, by: list[str], order: Column, tie: Column, sizes: Column, rows: Column | None = None,
             out: str = "section") -> DataFrame:
    """Add ``out``: how many of the group's ``sizes`` lie at or below the row's rank by (order, tie).

    ``sizes`` is an array of longs over ``n``, the group's row count; a row of
    rank r (from 0) lies in section s if s of the sizes are at most r. Rows are
    not sorted or moved: each size's cut value is found by counting rows by
    prefix, ``DIGIT`` bits a pass, until few rows share the prefix, and rows
    compare themselves with the cuts. Only (group, order, tie) are read for
    that, and only counts are shuffled. ``order`` and ``tie`` are longs; rows
    equal in both fall on the same side of a cut. ``rows`` limits the ranking:
    other rows get null. Null orders come first.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    ranked = df if rows is None else df.filter(rows)
    slim = ranked.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], order.alias("_o"), tie.alias("_t"))
    reach = slim.agg(*[f(c).alias(f"{f.__name__}{c}") for c in ("_o", "_t") for f in (F.min, F.max)]).first()
    if reach["min_o"] is None:
        return df.withColumn(out, F.lit(None).cast("int"))
    low = {c: reach[f"min{c}"] or 0 for c in ("_o", "_t")}
    bits = {c: ((reach[f"max{c}"] or 0) - low[c]).bit_length() for c in ("_o", "_t")}
    if max(bits.values()) > 63:
        raise ValueError("order and tie must span less than 63 bits")

    def above(column: Column, c: str) -> Column:
        return F.coalesce(column, F.lit(low[c])) - F.lit(low[c])

    slim = slim.select(*keys, above(F.col("_o"), "_o").alias("_o"), above(F.col("_t"), "_t").alias("_t"))
    # prefix of a row after each pass: (order's leading bits, tie's leading bits or -1)
    steps = [(F.shiftright("_o", s), F.lit(-1).cast("long")) for s in _digits(bits["_o"])] + \
            [(F.col("_o"), F.shiftright("_t", s)) for s in _digits(bits["_t"])]
    targets = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.posexplode(sizes).alias("_i", "_size"), F.col("n").alias("_all"))
    state = materialize(targets.select(*keys, "_i", F.lit(-1).cast("long").alias("_a"), F.lit(-1).cast("long").alias("_b"),
                                       F.least(F.col("_size"), F.col("_all")).alias("_size"), (F.least(F.col("_size"), F.col("_all")) - 1).alias("_rank"),
                                       F.col("_all").alias("_n")), "cuts")
    before = (F.lit(-1).cast("long"), F.lit(-1).cast("long"))
    same = [*keys, "_a", "_b"]
    for step in steps:
        # a few rows per group: written, so that joins see the size and broadcast it only while it is small
        if not state.filter((F.col("_size") > 0) & (F.col("_n") > LEAF_ROWS)).limit(1).count():
            break
        inside = _matching(slim.select("*", before[0].alias("_a"), before[1].alias("_b")), state.filter("_size > 0").select(*same).distinct(), same)
        counts = inside.groupBy(*same, step[0].alias("_a2"), step[1].alias("_b2")).agg(F.count(F.lit(1)).alias("_c"))
        running = Window.partitionBy(*same).orderBy("_a2", "_b2")      # at most 2^DIGIT counts
        counts = counts.withColumn("_to", F.sum("_c").over(running))
        found = _joined(state.filter("_size > 0"), counts, same).filter((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_c")))
        state = materialize(found.select(*keys, "_i", F.col("_a2").alias("_a"), F.col("_b2").alias("_b"), "_size",
                                         (F.col("_rank") - F.col("_to") + F.col("_c")).alias("_rank"), F.col("_c").alias("_n"))
                            .unionByName(state.filter("_size <= 0")), "cuts")
        before = step
    inside = _matching(slim.select("*", before[0].alias("_a"), before[1].alias("_b")), state.filter("_size > 0").select(*same).distinct(), same)
    inside = inside.withColumn("_at", F.row_number().over(Window.partitionBy(*same).orderBy("_o", "_t")) - 1)
    hit = _joined(state.filter("_size > 0"), inside, same).filter(F.col("_at") == F.col("_rank")).select(*keys, "_i", "_o", "_t")
    none = state.filter("_size <= 0").select(*keys, "_i", F.lit(-1).cast("long").alias("_o"), F.lit(-1).cast("long").alias("_t"))
    cuts = materialize(hit.unionByName(none).groupBy(*keys).agg(F.collect_list(F.struct("_o", "_t")).alias("_cuts")), "cuts")    # an array per group
    own = F.struct(above(order, "_o").alias("_o"), above(tie, "_t").alias("_t"))
    member = F.lit(True) if rows is None else F.coalesce(rows, F.lit(False))
    match = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
    tagged = df.join(cuts, match, "left") if match else df.join(F.broadcast(cuts), how="left")       # without groups: one row
    section = F.size(F.filter("_cuts", lambda c: c < own))
    return tagged.withColumn(out, F.when(member, section)).drop("_cuts", *keys)


def _matching(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    renamed = right.toDF(*[f"{c}_r" for c in columns])
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in columns], "left_semi")


def _joined(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"{c}_r" for c in columns})
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in columns]).drop(*[f"{c}_r" for c in columns])
