"""The corpus pipeline: five stages from raw documents to training tokens, each over all that the one before kept.

Counted as part of the subpackage ``quarrymap.llm``. Stages take (spark, docs, sf_dir); all but the last return the
columns of documents. What a stage returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymap.llm import bpe, curriculum, line_dedup, minhash_dedup, toxicity
from quarrymap.llm.storage import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on the table labels, finds toxic."""
    return toxicity.keep_harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay where they occur first; a document of which nothing is left goes."""
    return line_dedup.keep_first_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash_dedup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In training order; documents of sources that the schedule favours occur several times."""
    return curriculum.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, tokens, n_tokens, round_trip (whether decoding the tokens gives the text)."""
    return bpe.encode(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
#: No SQL: the classifier, MinHash and BPE can't be written in it; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
