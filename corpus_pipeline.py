"""The corpus pipeline: toxicity, near-dedup, decontamination, PII redaction, packing.

Every stage is written as Parquet and read again as the next one's documents; all but the last return the columns of
documents. Empty inputs give empty outputs, columns beside those of documents pass through whatever their names, and
nulls, empty texts and repeated rows fare as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, minhash, packing, pii, quality, toxicity
from tessera.llm.common import fresh_path, pack_columns, table, unpack_columns
from tessera.llm.tokens import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from all labels but every fifth document's.

    Every row is judged by its text alone, so repeated rows fare alike; null and empty texts stay.
    """
    known = lambda c: F.crc32(F.col(c).cast("string")) % 5 != 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), known)
    scored = quality.append_scores(pack_columns(docs, "text"), model, "_toxic_score")
    return unpack_columns(scored.filter("_toxic_score < 0.5"), docs.columns, "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8), the one with the smallest doc_id.

    Of rows that repeat doc_id and text one stays; rows without a doc_id or without words stay.
    """
    return minhash.drop_near_duplicates(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go; every row is judged for itself, null and empty texts stay."""
    rows = pack_columns(docs, "text")
    judged = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), keep=rows.columns)
    return unpack_columns(judged.filter(~F.col("contaminated")), docs.columns, "text")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, n_chars follows; every row stays, and a null text stays null."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents with their sequences; null texts count as empty, ties are settled by rows' order."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 2, 1024, cache=400_000)  # other stages share the executors


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
