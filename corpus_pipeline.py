"""Training-data pipeline: toxicity, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared checkpoint folder and reads it again as
the next stage's documents. All stages but the last return the columns of
``documents``.

Nulls, ties, odd input follow the operators: null texts are empty, rows that
are equal in doc_id and text are decided alike, null doc_ids stay, clashing
extra columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlens.llm.common import BLANK, materialize, read
from riverlens.llm.op3_jaccard import jaccard_groups
from riverlens.llm.op4_toxicity import CUT, score_documents, train
from riverlens.llm.op5_line_dedup import dedup_lines
from riverlens.llm.op7_packing import pack, tokenize
from riverlens.llm.op8_mixing import mix, repeat_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut; a document with a label that is held out is scored like any other."""
    scores = score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
    return scores.filter(F.col("__score") < CUT).select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut; documents of which no word is left go."""
    cut = dedup_lines(docs)
    cut = cut.filter((F.col("__n_removed") == 0) | F.col("text").rlike(rf"[^{BLANK}]"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("__n_removed") > 0, length).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id (then text hash) stays, once; empty texts stay."""
    groups = materialize(jaccard_groups(docs).filter("root is not null").groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("rows")), "group-rows")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    first = groups.groupBy("root").agg(F.min(place).alias("first"))
    drop = groups.join(first, "root").filter(~place.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h"))
    kept = hashed.join(drop, same, "left_anti")
    repeated = groups.filter("rows > 1").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    if repeated.limit(1).count():       # rows that are equal in doc_id and text: one of them stays
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__hash"]))
    return kept.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, the last copy cut at its source's budget."""
    return repeat_documents(docs, mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return pack(tokenize(docs))


STAGES = [("toxicity", drop_toxic), ("line_dedup", cut_repeated_lines), ("ngram_jaccard", one_of_each_group),
          ("source_mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: A trained network decides in the first stage, so SQL cannot express the rows; the tests hold each stage against brute force.
ORACLE_SQL = None
