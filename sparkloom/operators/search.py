"""Search in the lines of files, and ranges of lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def line_table(files: DataFrame) -> DataFrame:
    """(file, line_number, line), from 1."""
    return files.select("file", F.posexplode(text.lines(F.col("content"))).alias("n", "line")).select("file", (F.col("n") + 1).alias("line_number"), "line")


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern for the JVM: named groups are rewritten, and classes and cases follow Unicode."""
    return ("(?iU)" if ignore_case else "(?U)") + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern))


def search(files: DataFrame, pattern: str, context_lines: int = 0, ignore_case: bool = False, *, engine: str = "jvm") -> DataFrame:
    """(file, line_number, line, context_before, context_after) of the lines with a match.

    The lines of a file are an array; matches are picked out of it and only they become rows, so context costs no window
    and files without a match no row.  ``engine="python"`` matches with Python's own expressions.
    """
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid regex: {e}") from e
    lines = text.lines(F.col("content"))
    if engine == "python":

        @F.pandas_udf("array<int>")
        def hits(own: pd.Series) -> pd.Series:
            found = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
            return pd.Series([[k for k, line in enumerate(x) if found.search(line)] for x in own])

        matched = files.select("file", lines.alias("lines")).withColumn("at", hits("lines"))
    else:
        java = java_pattern(pattern, ignore_case)
        numbered = F.transform("lines", lambda line, k: F.when(line.rlike(java), k))
        matched = files.select("file", lines.alias("lines")).withColumn("at", F.filter(numbered, lambda k: k.isNotNull()))
    rows = matched.select("file", "lines", F.explode("at").alias("k"))
    k = F.col("k")
    before = F.least(k, F.lit(context_lines))
    return rows.select(
        "file", (k + 1).cast("int").alias("line_number"), F.element_at("lines", (k + 1).cast("int")).alias("line"),
        F.when(before > 0, F.slice("lines", (k - before + 1).cast("int"), F.greatest(before, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<string>")).alias("context_before"),
        F.when((F.lit(context_lines) > 0) & (k + 1 < F.size("lines")), F.slice("lines", (k + 2).cast("int"), F.lit(max(context_lines, 1)))).otherwise(F.array().cast("array<string>")).alias("context_after"),
    )


def line_range(files: DataFrame, start: int | None = None, end: int | None = None, *, column: str = "compressed") -> DataFrame:
    """(file, text) of lines start to end."""
    return files.select("file", text.slice_lines(F.col(column), F.lit(start).cast("int"), F.lit(end).cast("int")).alias("text"))
