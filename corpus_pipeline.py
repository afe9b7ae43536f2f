"""The corpus pipeline: documents cleaned, deduplicated, decontaminated and encoded, stage by stage.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of
documents. ``run`` writes each stage's rows to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.llm import decontaminate, line_dedup, near_dedup, pieces, toxicity
from lexmill.llm.common import crc_rest, table
from lexmill.sources.workdir import materialize

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
TOXIC_FROM = 0.7
FOREST = near_dedup.Forest(words=5, percent=80, orders=16)

# Texts are long: smaller batches between Spark and Python keep executors within their memory.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; labels of one third of the documents are never learned from."""
    small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(crc_rest("doc_id", 3) != 1)
    return toxicity.drop_toxic(docs, labels, TOXIC_FROM)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents that lose all their words with them."""
    small_batches(spark)
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates stays."""
    small_batches(spark)
    return near_dedup.keep_one(docs, FOREST)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of the documents left."""
    small_batches(spark)
    return pieces.encode(docs, MODEL_PATH)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("benchmark decontamination", drop_benchmark),
    ("pieces", encode),
]

#: Learned and merging stages have no SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
