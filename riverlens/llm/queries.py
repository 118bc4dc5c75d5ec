"""Queries of the training-data operators: one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_secrets import op1_secret_scan as run
    return run(spark, read(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_topk import op2_topk as run
    return run(spark, read(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_jaccard import op3_ngram_jaccard as run
    return run(spark, read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_toxicity import op4_toxicity as run
    return run(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_line_dedup import op5_line_dedup as run
    return run(spark, read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_pii import op6_pii as run
    return run(spark, read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_packing import op7_packing as run
    return run(spark, read(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_mixing import op8_source_mixing as run
    return run(spark, read(spark, sf_dir, "documents"))


def op9_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_line_crf import op9_quality_lines as run
    return run(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_archives import op10_warc as run
    return run(spark, read(spark, sf_dir, "pages"))


def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op11_bpe import op11_bpe_encoding as run
    return run(spark, read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_codes import op12_vector_codes as run
    return run(spark, read(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_centroids import op13_centroid_clusters as run
    return run(spark, read(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_topk, op3_ngram_jaccard, op4_toxicity, op5_line_dedup, op6_pii, op7_packing,
                                   op8_source_mixing, op9_quality_lines, op10_warc, op11_bpe_encoding,
                                   op12_vector_codes, op13_centroid_clusters, pipeline)}
ORACLES: dict[str, str] = {}
