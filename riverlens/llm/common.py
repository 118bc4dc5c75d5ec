"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table_path  # noqa: F401  (re-used by the operators)

#: A word is a maximal run of characters other than these six ASCII blanks.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of a non-null text, as long."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def match_spans(text: Column, pattern: str, kind: str, rank: int, probe: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` in ``text``.

    Array of (s, r, e, k, hit): start and end in code points, the kind and
    its rank, and the matched string. ``probe`` is a cheap necessary
    condition; texts that fail it are not searched. ``\\G`` ties each gap to
    the previous match, so a text is walked once however it ends, and the
    lengths of gaps and hits add up to positions.
    """
    rx = F.lit(rf"(?s)\G(.*?)({pattern})")
    pieces = F.zip_with(F.regexp_extract_all(text, rx, F.lit(1)), F.regexp_extract_all(text, rx, F.lit(2)),
                        lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("len"), hit.alias("hit")))
    empty = F.expr("cast(array() as array<struct<s:int,r:int,e:int,k:string,hit:string>>)")
    found = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("s"), F.lit(rank).alias("r"), (acc["at"] + x["gap"] + x["len"]).alias("e"),
                F.lit(kind).alias("k"), x["hit"].alias("hit")))).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.rlike(pattern) if probe is None else probe & text.rlike(pattern), found).otherwise(empty)


def span_list(spans: Column) -> Column:
    """Sorted spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def count_rank(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["r"] == rank)).cast("long")
