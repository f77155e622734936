"""The cleaning pipeline of a corpus.

``STAGES`` lists (name, function); each function takes the session, the rows that the
stage before kept and the data folder. Every stage but the last returns whole rows of
documents. ``run`` applies them to the documents table; each result is written to the
shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekcast.llm import decontaminate, exact_dedup, near_dup, packing, toxicity
from weekcast.llm.common import read_table, write_stage
from weekcast.llm.queries import ORACLE, QUERIES, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it is fitted on labelled rows of
    the documents table."""
    model = toxicity.fit(read_table(spark, sf_dir, "documents"),
                         read_table(spark, sf_dir, "labels"))
    return toxicity.drop_rejected(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: that with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates: that with the largest doc_id."""
    return near_dup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into training sequences."""
    pieces = packing.pack(docs, tokenizer_file())
    return pieces.select("doc_id", "piece", "start", "length",
                         F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


# A fitted model and a tokenizer are no SQL; the stages are tested against brute force.
ORACLE_SQL = None

QUERIES = {**QUERIES, "pipeline": run}
