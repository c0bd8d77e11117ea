"""A training-corpus pipeline over `documents`: five stages, each an operator of ledgerline.llm.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and gives
a DataFrame, which is written as Parquet and read again as the next stage's docs.

All stages but the last keep every column of their input, whatever its name. An empty
table stays empty. Rows with a null or empty text pass all filters: they score as
clean, have no key line, no shingle and no passage, and encode to no tokens. Rows that
repeat an id are judged by their own texts, but for the n-gram join: there the rows
of an id go together if any of their sets is linked to a smaller id; rows with a null id stay.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, common, decontamination, line_dedup, ngram_join, toxicity

def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    return toxicity.clean(docs, common.read(spark, sf_dir, "labels"))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all texts."""
    common.bounded_batches(spark)
    return line_dedup.dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    common.bounded_batches(spark)
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, common.read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as token ids."""
    common.bounded_batches(spark)
    ids = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_common_lines),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: SQL cannot express the learned, latent and tokenizing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again. What a stage wrote goes once the next one is written; the last one's input stays."""
    place = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = common.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if last is not None:
            removed(spark, last)
        last = f"{place}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
