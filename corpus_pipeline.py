"""A corpus from documents: toxicity, near-duplicates, benchmark leaks, secrets, then packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  All but the last return the
columns of documents; the last returns the pieces and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, near_dedup, packing, secrets, toxicity
from sparkloom.llm.common import cut, table

#: A document goes if its score reaches this.
TOXIC = 0.5
#: Near-duplicates share so many percent of their five-word shingles; bands for which a pair at 80 is missed with 9e-7.
SIMILAR = 80
BANDS = 35


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learnt from labels, rejects."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, machine, TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.deduplicate(docs, percent=SIMILAR, bands=BANDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret replaced by its kind in brackets; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark leaks", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: The classifier and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
