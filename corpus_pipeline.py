"""A corpus pipeline: quality, exact copies, near copies, mixture, tokens.

Each stage takes what its predecessor kept. ``run`` writes every stage's rows as Parquet to the shared folder and reads
them again, so a lost executor never costs more than a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.exact_dedup import drop_copies
from quarry.llm.minhash_dedup import drop_near_duplicates
from quarry.llm.piece_nbest import encode_documents
from quarry.llm.quality_classifier import keep_good
from quarry.llm.shared import stored, table
from quarry.llm.source_mix import mixed_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), that of the least id."""
    return drop_near_duplicates(docs, k=5)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix reads them."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left, with the scores of the best segmentations."""
    return encode_documents(docs)


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL expresses neither the classifier nor the segmentation; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
