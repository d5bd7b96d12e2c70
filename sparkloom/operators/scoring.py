"""Confidence in summaries, triage, structural summaries and token savings."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

REVIEW = 0.34
HIGH = 0.67
FULL = 3
FAILED = "(summary generation failed)"
SHOWN = 5
NOTHING = "No signatures or dependencies found (structure only)."

_NO = lambda: F.array().cast("array<string>")


def confidence(summary: Column, signatures: Column, failed: str = FAILED) -> Column:
    """The share of the signatures' words, three at most, that the summary names; 0 for a failed summary, 1 without words."""
    own = F.array_distinct(F.flatten(F.transform(F.coalesce(signatures, _NO()), text.identifier_words)))
    expected = F.least(F.size(own), F.lit(FULL))
    hit = F.least(F.size(F.array_intersect(own, text.identifier_words(F.coalesce(summary, F.lit(""))))), expected)
    return F.when(summary == failed, 0.0).when(F.size(own) == 0, 1.0).otherwise(F.bround(hit / expected, 2))


def level(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= REVIEW, "medium").otherwise("low")


def triage(files: DataFrame, threshold: float = REVIEW) -> tuple[DataFrame, DataFrame]:
    """(those to review, the least sure first; the rest in their order); no confidence counts as 1."""
    scored = files.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    kept = scored.where(F.col("confidence") >= threshold)
    return scored.where(F.col("confidence") < threshold).orderBy("confidence", "file"), kept.orderBy("ord") if "ord" in files.columns else kept


def review(files: DataFrame, shown: int = 10) -> DataFrame:
    """Files with their first signatures and how many more there are."""
    return files.select("file", "summary", "confidence", level(F.col("confidence")).alias("level"), F.slice("signatures", 1, shown).alias("signatures"), F.greatest(F.lit(0), F.size("signatures") - shown).alias("more_signatures"))


def structural_summary(signatures: Column, dependencies: Column, shown: int = SHOWN) -> Column:
    """What a file defines, else what it refers to, else a fixed note."""
    listed = lambda word, c: F.concat(F.lit(f"{word}: "), F.array_join(F.slice(c, 1, shown), ", "), F.when(F.size(c) > shown, F.concat(F.lit(", +"), (F.size(c) - shown).cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    signatures, dependencies = F.coalesce(signatures, _NO()), F.coalesce(dependencies, _NO())
    return F.when(F.size(signatures) > 0, listed("Defines", signatures)).when(F.size(dependencies) > 0, listed("References", dependencies)).otherwise(F.lit(NOTHING))


# ---- tokens

MODELS = (("GPT-4o", "o200k_base", 128_000), ("GPT-3.5", "cl100k_base", 16_000), ("GPT-4", "cl100k_base", 128_000))
Counter = Callable[[Column], Column]


def approximate_tokens(content: Column) -> Column:
    """Word pieces of up to four letters or digits, and other signs one by one: a stand-in where a model's own vocabulary isn't at hand, never to be taken for its count."""
    return F.regexp_count(content, F.lit(r"[\p{L}\p{N}]{1,4}|[^\s\p{L}\p{N}]")).cast("long")


def counter(encoding: str) -> Counter:
    """The encoding's own counter if its vocabulary can be loaded, else the approximate one."""
    try:
        import tiktoken

        tiktoken.get_encoding(encoding)
    except Exception:  # noqa: BLE001 - the library raises whatever its download does
        return approximate_tokens

    @F.pandas_udf("bigint")
    def count(content: pd.Series) -> pd.Series:
        own = tiktoken.get_encoding(encoding)
        return pd.Series([len(own.encode(c, disallowed_special=())) for c in content])

    return count


def vocabulary_counter(path: str, pattern: str) -> Counter:
    """Exact counts by a byte-pair vocabulary in a file of lines "base64 rank", which all executors can read, and its splitting pattern."""

    @F.pandas_udf("bigint")
    def count(content: pd.Series) -> pd.Series:
        own = _vocabulary(path, pattern)
        return pd.Series([0 if c is None else len(own.encode_ordinary(c)) for c in content])

    return count


@lru_cache(maxsize=4)
def _vocabulary(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, w) for m, _, w in MODELS], "model string, window bigint")


def framed(file: Column, content: Column) -> Column:
    """A file's part of the text that is counted."""
    return F.concat(F.lit("\n### "), file, F.lit("\n"), content, F.lit("\n"))


def payload(summary: Column) -> Column:
    """What a file's entry ships: its summary as JSON."""
    return F.concat(F.lit('{"summary": '), F.regexp_extract(F.to_json(F.struct(F.coalesce(summary, F.lit("")).alias("s"))), r'(?s)^\{"s":(.*)\}$', 1), F.lit("}"))


def savings(files: DataFrame, original: Column, shipped: Column, counters: dict[str, Counter] | None = None) -> DataFrame:
    """(model, original, compressed, saved_pct) over all files; each file is counted once per encoding."""
    encodings = sorted({e for _, e, _ in MODELS})
    own = counters or {e: counter(e) for e in encodings}
    texts = files.select(framed(F.col("file"), original).alias("o"), framed(F.col("file"), shipped).alias("s"))
    sums = texts.agg(*(F.coalesce(F.sum(own[e](F.col(c))), F.lit(0)).alias(f"{c}_{e}") for e in encodings for c in "os"))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"o_{e}").alias("original"), F.col(f"s_{e}").alias("compressed")) for m, e, _ in MODELS))).alias("r")
    return sums.select(rows).select("r.*").withColumn("saved_pct", F.when(F.col("original") > 0, F.bround((F.col("original") - F.col("compressed")) / F.col("original") * 100, 1)).otherwise(0.0))


def totals(files: DataFrame, content: Column, counters: dict[str, Counter] | None = None) -> DataFrame:
    """(model, tokens, max, percentage, bar): how much of each model's window all files take."""
    own = savings(files, content, content, counters).join(F.broadcast(models(files.sparkSession)), "model")
    share = F.col("original") / F.col("window") * 100
    filled = F.least(F.floor(share / 10), F.lit(10)).cast("int")
    return own.select("model", F.col("original").alias("tokens"), F.col("window").alias("max"), F.bround(share, 1).alias("percentage"), F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.greatest(F.lit(10) - filled, F.lit(0)))).alias("bar"))


def within_budget(tokens: DataFrame, most: int, model: str) -> tuple[bool, int | None]:
    """(whether the model's compressed tokens stay within most, their number); (False, None) for an unknown model."""
    found = tokens.where(F.col("model") == model).select("compressed").head()
    return (found[0] <= most, found[0]) if found else (False, None)


def compressed_of(files: DataFrame) -> Column:
    from .features import compress_text

    return compress_text(F.col("content"), text.extension(F.col("file")))


