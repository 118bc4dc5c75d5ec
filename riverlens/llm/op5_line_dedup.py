"""Line dedup by winnowing over line hashes (DataFrame functions only).

Lines (trimmed, without blank ones) are hashed. The window of a line is the
shortest run of lines from it on that has ``min_words`` words; backward
windows end at a line. The smallest line hash of a window is its fingerprint,
so two equal runs of at least ``min_words`` words are guaranteed to share
fingerprints. The steps:

1. select: fingerprints with their positions, one per window;
2. join positions: only windows whose fingerprint was selected at two or more
   positions can be repeated;
3. extend both ways: of those, windows with equal line sequences are matched
   to the first position (smallest doc_id, then text hash, then line); forward
   and backward windows together reach every line of a maximal equal run;
4. delete: the lines of all windows but the first are deleted.

So a line goes exactly if it lies in a run of lines with ``min_words`` words
or more that also starts at an earlier position. The first occurrence of any
line content always stays.

Matching a window with its first position only (counts and minima, combined
before the shuffle) keeps work linear for passages that many documents share.

Nulls, ties, odd input: a null text stays null and has no lines; rows with
equal doc_id and text are one document, decided alike; null doc_ids come last;
blank lines go only inside deleted runs; lines of any length count; other
columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, materialize, n_words

MIN_WORDS = 50


def line_table(documents: DataFrame) -> DataFrame:
    """Distinct (last, id, h, line, lh, lh2, n): non-blank lines with two hashes and their number of words."""
    rows = documents.filter("text is not null").select(
        F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"),
        F.posexplode(F.split("text", "\n")).alias("line", "content"))
    trimmed = F.regexp_replace("content", rf"^[{BLANK}]+|[{BLANK}]++$", "")
    rows = rows.withColumn("content", trimmed).filter("content <> ''")
    rows = rows.select("last", "id", "h", "line", F.xxhash64("content").alias("lh"), F.xxhash64(F.lit(5), "content").alias("lh2"),
                       n_words(F.col("content")).alias("n"))
    return rows.repartition("last", "id", "h").dropDuplicates(["last", "id", "h", "line"])


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(fingerprint, place, c1, c2, last, id, h, s, e): forward and backward windows of every document.

    The fingerprint is the smallest line hash of the window, ``place`` its (leftmost) line.
    """
    doc = Window.partitionBy("last", "id", "h")
    total = F.sum("n").over(doc.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("upto", total).withColumn("before", F.col("upto") - F.col("n"))

    def frame(w: Window) -> Column:
        # line order is word order, so the collected lists are in line order
        return F.struct(F.sum("n").over(w).alias("words"), F.min(F.struct("lh", "line")).over(w).alias("low"),
                        F.min("line").over(w).alias("s"), F.max("line").over(w).alias("e"),
                        F.xxhash64(F.collect_list("lh").over(w)).alias("c1"), F.xxhash64(F.collect_list("lh2").over(w)).alias("c2"))
    forward = frame(doc.orderBy("before").rangeBetween(0, min_words - 1))
    backward = frame(doc.orderBy("upto").rangeBetween(-(min_words - 1), 0))
    both = lines.select("last", "id", "h", forward.alias("f"), backward.alias("b"))
    out = both.select("last", "id", "h", F.explode(F.array("f", "b")).alias("w")).select("last", "id", "h", "w.*")
    # a forward window at the end of a document may hold too few words
    return out.filter(F.col("words") >= min_words).select(F.col("low.lh").alias("fingerprint"), F.col("low.line").alias("place"),
                                                          "c1", "c2", "last", "id", "h", "s", "e")


def deleted_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, gone): the line numbers to delete of each document that has any."""
    found = materialize(windows(line_table(documents), min_words), "line-windows")
    at = F.struct("last", "id", "h", "s", "e")
    place = F.struct("last", "id", "h", "place")
    repeated = (found.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b"))
                     .filter("a <> b").select("fingerprint"))
    near = found.join(repeated, "fingerprint", "left_semi")
    firsts = near.groupBy("fingerprint", "c1", "c2").agg(F.min(at).alias("first"), F.max(at).alias("final")).filter("first <> final").drop("final")
    later = near.join(firsts, ["fingerprint", "c1", "c2"]).filter(~at.eqNullSafe(F.col("first")))
    runs = later.groupBy("id", "h").agg(F.collect_set(F.struct("s", "e")).alias("runs"))
    return runs.select("id", "h", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["s"], r["e"])))).alias("gone"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with repeated runs cut from ``text``, plus __n_lines and __n_removed (lines)."""
    gone = deleted_lines(documents, min_words).withColumnsRenamed({"id": "__id", "h": "__h", "gone": "__gone"})
    hashed = documents.withColumn("__hash", F.xxhash64("text"))
    joined = hashed.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left")
    split = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__gone")), lambda i: F.get(F.col("__lines"), i))
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), split))
    cut = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumns({"text": cut, "__n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long"),
                               "__n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}) \
                 .drop("__id", "__h", "__hash", "__gone", "__lines")


def op5_line_dedup(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (long) and the text that stays, one row per document row."""
    return dedup_lines(documents.select("doc_id", "text")).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")
