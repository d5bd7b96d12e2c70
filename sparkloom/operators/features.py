"""Features of files (file, content): one scan and one Arrow UDF for everything that needs a parse."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import code, compress, text

_LIST = T.ArrayType(T.StringType())
_FEATURES = T.StructType([T.StructField(n, _LIST) for n in ("signatures", "dependencies", "api")] + [T.StructField("compressed", T.StringType())])
_OUTLINE = T.ArrayType(T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(_FEATURES)
def _features(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
    empty = {"signatures": [], "dependencies": [], "api": []}
    rows = []
    for c, e in zip(content, ext, strict=True):
        c = c or ""
        rows.append(code.parse(c, e) or empty | {"compressed": compress.compress(c, e)})
    return pd.DataFrame(rows, columns=["signatures", "dependencies", "api", "compressed"])


@F.pandas_udf(T.StringType())
def compress_text(content: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else compress.compress(c, e) for c, e in zip(content, ext, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def compress_prose(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else compress.compress_prose(c) for c in content], dtype=object)


@F.pandas_udf(_OUTLINE)
def outline(content: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([[{"depth": d, "kind": k, "text": t} for d, k, t in code.outline(c or "", e)] for c, e in zip(content, ext, strict=True)])


def features(files: DataFrame) -> DataFrame:
    """files with signatures, dependencies, api and compressed."""
    parsed = files.withColumn("_f", _features("content", text.extension(F.col("file"))))
    return parsed.select(*files.columns, "_f.signatures", "_f.dependencies", "_f.api", "_f.compressed")


def compress_plain(files: DataFrame, *, block: int = compress.BLOCK, width: int = compress.TEXT) -> DataFrame:
    """(file, compressed) of plain text without Python: runs of lines by array functions, kept within each row."""
    line = F.transform(text.lines(F.col("content")), lambda x: F.when(F.length(x) > width, F.concat(F.substring(x, 1, width), F.lit(f" {compress.mark('text')}"))).otherwise(x))
    is_blank = lambda x: ~x.rlike(r"[^\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f]")
    # the places of blank lines part the others into runs; each run is sliced once
    lines = files.select("file", line.alias("lines")).withColumn("blank", F.filter(F.transform("lines", lambda x, k: F.when(is_blank(x), k)), lambda k: k.isNotNull()))
    n, at, last = F.size("lines"), F.col("blank"), F.size("blank")

    def run(k):
        first = F.when(k > 0, F.get(at, k - 1) + 1).otherwise(F.lit(0))
        size = F.coalesce(F.get(at, k), n) - first
        left_out = F.array(F.concat(F.lit(f"{compress.MARK} ("), (size - block).cast("string"), F.lit(f"{compress.LEFT_OUT['lines']})")))
        none = F.array().cast("array<string>")
        return F.concat(F.slice("lines", first + 1, F.least(size, F.lit(block))), F.when(size > block, left_out).otherwise(none), F.when(k < last, F.array(F.get("lines", F.get(at, k)))).otherwise(none))

    return lines.select("file", F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), last), run)), "\n").alias("compressed"))
