"""Which files hold a secret: the first line of a file that fits a pattern, and of several the first pattern."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

NAMES = ("AWS_SECRET", "API_KEY", "PASSWORD", "SECRET_KEY", "PRIVATE_KEY", "ACCESS_TOKEN", "DATABASE_URL")
#: Ranges in which files are numbered, and the names that set their bounds.
RANGES, SAMPLE = 128, 10_000
PATTERNS = tuple(rf"{name}\s*=\s*[\"']" for name in NAMES)


def finding(content: Column, patterns: tuple[str, ...] = PATTERNS) -> Column:
    """A struct (reason, line, matched_text), or null for a clean text.  One pass per text, nothing is exploded."""
    which = lambda line: F.coalesce(*(F.when(line.rlike(f"(?i){p}"), F.lit(p)) for p in patterns))
    lines = F.when(content.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), text.lines(content)).otherwise(F.array().cast("array<string>"))
    hits = F.filter(F.transform(lines, lambda line, k: F.struct(which(line).alias("reason"), (k + 1).cast("int").alias("line"), line.alias("matched_text"))), lambda x: x["reason"].isNotNull())
    return F.try_element_at(hits, F.lit(1))


#: (file, content) -> a finding (reason, line, matched_text), False for a clean text, None where the scanner can't say.
Scanner = Callable[[str, str], "dict | bool | None"]


def scan(files: DataFrame, patterns: tuple[str, ...] = PATTERNS, external: Scanner | None = None) -> DataFrame:
    """files with finding and dangerous; an external scanner decides where it is available, the patterns elsewhere."""
    own = finding(F.col("content"), patterns)
    if external is not None:
        asked = _asked(external)(F.col("file"), F.col("content"))
        own = text.once(asked, lambda a: F.when(a["state"] == "found", F.struct(a["reason"], a["line"], a["matched_text"])).when(a["state"] == "clean", F.lit(None)).otherwise(own))
    return files.withColumn("finding", own).withColumn("dangerous", F.col("finding").isNotNull())


def _asked(external: Scanner):
    @F.pandas_udf("state string, reason string, line int, matched_text string")
    def ask(file: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for f, c in zip(file, content, strict=True):
            found = external(f, c) if c is not None else False
            rows.append(("found", found.get("reason"), found.get("line"), found.get("matched_text")) if isinstance(found, dict) else ("clean" if found is False else "unavailable", None, None, None))
        return pd.DataFrame(rows, columns=["state", "reason", "line", "matched_text"]).astype({"line": "Int32"})

    return ask


class Command:
    """A scanner run as a program on executors: argv and a file's name; its JSON report is a list of one entry a file, with messages.

    Whatever goes wrong, also that there is no such program, makes it unavailable.
    """

    def __init__(self, *argv: str, seconds: float = 60):
        self.argv, self.seconds = argv, seconds

    def __call__(self, file: str, content: str) -> dict | bool | None:
        try:
            with tempfile.TemporaryDirectory() as folder:  # the executor's own, for the one call
                path = os.path.join(folder, os.path.basename(file) or "file")
                with open(path, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                report = json.loads(subprocess.run([*self.argv, path], capture_output=True, text=True, timeout=self.seconds, check=False).stdout)  # noqa: S603
            messages = [m for entry in report for m in entry["messages"]]
            if not messages:
                return False
            line = messages[0].get("range", {}).get("start", {}).get("line")
            lines = content.splitlines()
            return {"reason": messages[0].get("message") or "a rule of the scanner", "line": line, "matched_text": lines[line - 1] if line and 1 <= line <= len(lines) else None}
        except (OSError, ValueError, KeyError, TypeError, AttributeError, subprocess.SubprocessError):
            return None


def safe(scanned: DataFrame) -> DataFrame:
    return scanned.where(~F.col("dangerous"))


def dangerous(scanned: DataFrame) -> DataFrame:
    """(file, reason, line, matched_text)."""
    return scanned.where("dangerous").select("file", "finding.reason", "finding.line", "finding.matched_text")


def select_files(scanned: DataFrame, names: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """Safe files and overridden dangerous ones, those last; of them only the named ones if names (file) are given.  Unknown names are dropped."""
    chosen = safe(scanned).withColumn("_late", F.lit(0))
    if overrides is not None:
        chosen = chosen.unionByName(scanned.where("dangerous").join(overrides.select("file").distinct(), "file", "left_semi").withColumn("_late", F.lit(1)))
    if names is not None:
        allowed = chosen if overrides is not None else scanned.withColumn("_late", F.col("dangerous").cast("int"))
        chosen = allowed.join(names.select("file").distinct(), "file", "left_semi")
    return chosen.withColumnRenamed("_late", "overridden")


def by_ordinal(files: DataFrame, ordinals: list[int]) -> DataFrame:
    """The files at these places (from 1) of the order by name, in the order asked for, repeats included; other places are ignored."""
    spark = files.sparkSession
    if not ordinals:
        return files.limit(0)
    asked = spark.createDataFrame([(k, n) for k, n in enumerate(ordinals)], "ask int, place int")
    placed = numbered(files)
    return placed.join(asked, "place").orderBy("ask").drop("ask", "place")


def numbered(files: DataFrame, by: str = "file") -> DataFrame:
    """files with place, their number from 1 in the order by a column, nulls last, counted range by range.

    The ranges' bounds are names of a sample, taken once: a row's range follows from its value alone, so the count of the
    ranges and the numbering agree however a plan is cut into partitions.  Every row is counted and numbered.
    """
    sample = sorted(r[0] for r in files.select(by).where(F.col(by).isNotNull()).orderBy(F.rand(0)).limit(SAMPLE).collect())
    bounds = sorted({sample[len(sample) * k // RANGES] for k in range(1, RANGES)} if sample else set())
    ranged = files.withColumn("_p", F.when(F.col(by).isNull(), len(bounds) + 1).otherwise(_range(F.col(by), bounds)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(by).asc_nulls_last()))
    return ranged.join(F.broadcast(sizes), "_p").withColumn("place", (F.col("_before") + own).cast("int")).drop("_p", "_n", "_before")


def _range(value: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds are at most the value, by halving, from a first number on."""
    if not bounds:
        return F.lit(first)
    k = len(bounds) // 2
    return F.when(value < F.lit(bounds[k]), _range(value, bounds[:k], first)).otherwise(_range(value, bounds[k + 1 :], first + k + 1))
