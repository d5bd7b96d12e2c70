"""Drift as files arrive: a stream of (file, content) against a stored manifest, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import snapshots


def watch(files: DataFrame, saved: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append (file, status) of changed and added files to path; a batch that is run again replaces its own output."""

    def drift(batch: DataFrame, number: int) -> None:
        found = snapshots.compare(snapshots.manifest(batch), saved).where(F.col("status").isin("changed", "added"))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(drift).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
