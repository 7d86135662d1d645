"""A corpus pipeline over ``documents``: quality, line dedup, near-dedup, mixing, tokenising.

Every stage works on what the one before kept and returns the columns of ``documents``; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import line_dedup, mixing, near_dedup, quality, wfst
from seqloom.llm.queries import quality_model, read_model
from seqloom.llm.runtime import fresh, table, written

#: Score from which a document counts as good.
GOOD = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_model(spark, docs, sf_dir)
    name = fresh(docs.columns, "quality_score")[0]
    kept = quality.score(docs, "doc_id", "text", model, *[c for c in docs.columns if c != "doc_id"], name=name)
    return kept.filter(F.col(name) >= GOOD).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; ``n_chars`` follows the text."""
    out = line_dedup.dedup(docs, "doc_id", "text", counts=False)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs, "doc_id", "text").select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row for each time a document, or part of it, is taken."""
    return mixing.mixed(docs, "doc_id", "text", "source", "n_chars", weights=mixing.WEIGHTS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row."""
    e = wfst.encode(docs, "doc_id", "text", read_model())
    return e.select(F.col("key").alias("doc_id"), "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mix", mix_stage),
    ("sentencepiece", encode_stage),
]

#: Hashing, signatures and the transducer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
