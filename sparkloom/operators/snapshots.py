"""Manifests of content hashes, and what has changed since one was taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def manifest(files: DataFrame) -> DataFrame:
    """(file, sha256)."""
    return files.where("content is not null").select("file", text.fingerprint(F.col("content")).alias("sha256"))


def compare(current: DataFrame, saved: DataFrame) -> DataFrame:
    """(file, status): added, removed, changed or unchanged."""
    both = current.select("file", F.col("sha256").alias("now")).join(saved.select("file", F.col("sha256").alias("then")), "file", "full_outer")
    return both.select("file", F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed").otherwise("unchanged").alias("status"))


def is_stale(compared: DataFrame) -> bool:
    return not compared.where("status <> 'unchanged'").isEmpty()


def drift(compared: DataFrame) -> DataFrame:
    """(status, n): the number behind a badge."""
    return compared.groupBy("status").agg(F.count("*").alias("n"))


def reusable_summaries(current: DataFrame, saved: DataFrame, previous: DataFrame) -> DataFrame:
    """(file, summary) of unchanged files that have one."""
    same = compare(current, saved).where("status = 'unchanged'").select("file")
    return previous.where(F.coalesce("summary", F.lit("")) != "").select("file", "summary").join(same, "file", "left_semi")
