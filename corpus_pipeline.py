"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays,
secrets are masked, and the rest is packed into training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
result as Parquet in the shared checkpoint folder and reads it again for the next.

Edge cases: further columns stay, whatever their names, until packing; null and empty texts
are kept by all stages but the near-duplicate one, where each row without words stands for
itself; repeated rows are near duplicates of each other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import jaccard, packing, secrets, toxicity
from keystrata.llm.common import fresh, saved, table
from keystrata.llm.queries import model_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = fresh(docs, *toxicity.RESULT)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    kept = toxicity.score(docs, model, keep=True, names=tuple(names)).filter(F.col(names[-1]) == 0)
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the least id, rows without an id last.  Rows
    are joined by a number of their own, so those that repeat an id or have none are told apart."""
    row, = fresh(docs, "row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()))
    same = jaccard.join(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("r"), "component_id", "class_id")
    own = rows.select(F.col(row).alias("r"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("id"))
    first = own.join(same, "r").groupBy("component_id").agg(F.min(F.struct("id", "class_id", "r")).alias("first")).select(F.col("first.r").alias(row))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, model_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
