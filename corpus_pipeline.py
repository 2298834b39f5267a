"""A corpus from raw documents to packed sequences. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trainframe.llm import bwt, crf, forest, mixing, packing
from trainframe.llm.queries import bpe_path
from trainframe.llm.store import stored
from trainframe.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts and the line labels accept."""
    return crf.kept_documents(docs, crf.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a similarity of 0.8 on five-word shingles."""
    return forest.deduplicated(docs, k=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes that an earlier document has; a character cut in two goes."""
    return bwt.cut_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix by source; a second pass over a source repeats rows, its last one may be cut."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences."""
    return packing.pack(packing.pieces(docs, bpe_path(), end_id=0))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("mixture", mixture), ("packing", sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
