"""What a project is built with, from the manifests at its root."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import manifests


@F.pandas_udf(T.ArrayType(T.StringType()))
def _dependencies(file: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([manifests.dependencies(f, c or "") for f, c in zip(file, content, strict=True)])


def capped(names, most: int = manifests.MOST):
    """(the first distinct names, whether there are more), as columns."""
    distinct = F.array_distinct(names)
    return F.slice(distinct, 1, most), F.size(distinct) > most


def tech_stack(files: DataFrame) -> DataFrame:
    """(ord, manifest, language, package_manager, dependencies, dependencies_truncated) in the manifests' fixed order.  Files below the root don't count."""
    known = files.sparkSession.createDataFrame([(k, n, lang, pm) for k, (n, (lang, pm, _)) in enumerate(manifests.MANIFESTS.items())], "ord int, file string, language string, package_manager string")
    found = files.join(F.broadcast(known), "file").withColumn("all", _dependencies("file", "content"))
    shown, more = capped(F.col("all"))
    return found.select("ord", F.col("file").alias("manifest"), "language", "package_manager", shown.alias("dependencies"), more.alias("dependencies_truncated"))
