"""Sessions with the settings that the operators count on."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, *, name: str = "sparkloom", partitions: int | None = None) -> SparkSession:
    """A session; on a cluster leave master and partitions to its own settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_own_shared: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local master (tests) gets a folder of its own; on a cluster, where executors couldn't see that,
    the setting is asked for.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_shared:
        _own_shared.append("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return _own_shared[0]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make sure that Python workers can import this package: where PYTHONPATH doesn't say so, send it to them, once per application."""
    root = Path(__file__).resolve().parent.parent
    known = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in known or spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="sparkloom-")) / "sparkloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted((root / "sparkloom").rglob("*.py")):
            out.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
