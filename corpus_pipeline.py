"""A training corpus from the documents table: five stages, each one operator of seqmatch.llm over all its rows.

Each stage's result is written as Parquet and read again as the next one's documents, so a lost executor costs the
running stage only.  All but the last return the columns of ``documents``.  All stages run in the same executors, whose
Python workers and Arrow buffers stay: the stages that hand texts to Python bound the bytes of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmatch.llm import linededup, mixing, ngramjoin, packing, quality
from seqmatch.llm.common import materialize, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: learns from the labelled rows of its input, drops the documents it rejects."""
    small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=COLUMNS, only_good=True).select(*COLUMNS)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: rewrites the texts; n_chars follows them.  No document is dropped."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each class of near duplicates stays."""
    small_batches(spark)
    return ngramjoin.keep_one(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: documents as often as their Poisson counts say, in a random order."""
    return mixing.replicate(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row for each piece with its sequence and offset."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_shared_lines),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
