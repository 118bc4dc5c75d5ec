"""Mixing sources to target weights (DataFrame functions only).

Every document gets a hash-random key. Within a source documents are ordered
by that key: the key's leading bits name a bucket, buckets are ranges of the
order and hold few documents each, so a hot source is spread over many
buckets. Bucket totals give each bucket its offset (prefix sum over buckets),
a window inside the bucket gives each document its prefix sum, and the
source's budget cuts there. Whole epochs are taken first; the rest of the
budget ends inside one document, of which only the first words count.

Targets: the sources share ``share`` times all words by weight; a source may
not exceed ``cap`` times its own size; what is above is shared again by
weight. The fixed point is min(cap * size, level * weight) for one level,
found by a running sum over the sources ordered by size / weight (one row per
source).

Nulls, ties, odd input: a null text has size 0; a null source is a source of
its own, last in order; repeated rows are documents of their own (ties of the
key are cut in any order among equal rows, so the multiset of rows is the
same on a rerun); size 0 documents take 0; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, WORD, materialize, n_words, text_or_empty

# Fixed values of the mix.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 8
BUCKET_DOCS = 50_000   # documents of a bucket, about


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From one row per source (src_null, src, source_size): adds weight and target."""
    order = Window.orderBy("src_null", "src")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.lit(cap) * F.col("source_size"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "src_null", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # if all sources before this one are full, the others share the rest at this level
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) \
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = weighed.withColumn("level", level)
    levelled = levelled.withColumn("open", F.col("level") * F.col("weight") <= F.col("limit"))
    # the first source in ratio order that is not full fixes the level
    final = F.min(F.when(F.col("open"), F.col("level"))).over(everything)
    first = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.withColumn("target", F.least(F.col("limit"), F.coalesce(first, final, F.lit(float("inf"))) * F.col("weight"))) \
                   .drop("level", "open", "limit")


def mix(documents: DataFrame, seed: int = SEED, weights=WEIGHTS, share: float = SHARE, cap: float = CAP,
        bucket_docs: int = BUCKET_DOCS, carry: list[str] | None = None) -> DataFrame:
    """Rows (doc_id, text_hash, size, source_size, target, taken), one per document row, with the columns of ``carry``."""
    text = text_or_empty()
    sized = documents.select("doc_id", F.xxhash64(text).alias("text_hash"), F.col("source").alias("src"),
                             F.col("source").isNull().alias("src_null"), n_words(text).alias("size"))
    sized = sized.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    sized = materialize(sized, "mix-sizes")  # the texts are read once; everything after is narrow
    n = sized.count()
    bits = max(6, (max(1, n) // bucket_docs).bit_length())
    # the signed key's leading bits, as an ordered bucket number
    sized = sized.withColumn("bucket", F.shiftright("key", 64 - bits).cast("int"))
    source = [F.coalesce("src", F.lit("")).alias("src"), "src_null"]
    sized = sized.withColumn("src", source[0])
    buckets = sized.groupBy("src_null", "src", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = buckets.groupBy("src_null", "src").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    earlier = Window.partitionBy("src_null", "src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("src_null", "src", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset")) \
                     .join(targets, ["src_null", "src"])
    inside = Window.partitionBy("src_null", "src", "bucket").orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, ["src_null", "src", "bucket"])
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.least("size", F.greatest(F.lit(0), rest - F.col("offset") - F.col("within")))
    return placed.select("doc_id", "text_hash", "size", "source_size", F.col("target").cast("double").alias("target"),
                         (whole * F.col("size") + part).cast("long").alias("taken"))


def op8_source_mixing(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """The op8 contract over ``documents``."""
    return mix(documents).select("doc_id", "size", "source_size", "target", "taken")


def repeat_documents(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last copy cut after its last taken word.

    Equal rows (same doc_id and text) pool what they take.
    """
    per = mixed.groupBy("doc_id", "text_hash").agg(F.sum("taken").alias("__taken"), F.count(F.lit(1)).alias("__rows"), F.max("size").alias("__size"))
    # pooled words are dealt evenly to the equal rows: the first rows take the larger share
    per = per.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}).filter("__taken > 0")
    text = text_or_empty()
    rows = documents.withColumn("__h", F.xxhash64(text)).join(per, (F.col("doc_id").eqNullSafe(F.col("__id"))) & (F.col("__h") == F.col("__hash")))
    # an equal row stands for one of __rows: its share of the pooled words, rounded to the nearest word
    share = F.round(F.col("__taken") / F.col("__rows")).cast("long")
    rows = rows.withColumn("__share", share)
    copies = F.ceil(F.col("__share") / F.greatest("__size", F.lit(1))).cast("int")
    rows = rows.filter("__share > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    left = (F.col("__share") - (F.col("__copy") - 1) * F.col("__size")).cast("int")
    first_words = F.concat(F.lit(rf"^(?:[{BLANK}]*+{WORD}+){{"), left.cast("string"), F.lit("}+"))
    cut = F.call_function("regexp_extract", F.col("text"), first_words, F.lit(0))
    rows = rows.withColumn("text", F.when(left < F.col("__size"), cut).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return rows.select(*documents.columns)
