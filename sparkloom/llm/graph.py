"""Connected components of links by local union-find and repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _local_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each node that isn't its set's smallest gets one link, to that."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def stars() -> pa.RecordBatch:
        nodes = list(parent)
        made = pa.record_batch({"a": pa.array(nodes, pa.int64()), "b": pa.array([find(x) for x in nodes], pa.int64())})
        parent.clear()
        return made

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) >= 1_000_000:  # stars of a part of the links join the same nodes
            yield stars()
    if parent:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of links (a, b: long), with the smallest node that it reaches.

    A round names each node after its smallest neighbour and carries the links over to the names.  The smallest node of a
    component keeps its name, and every other node is merged into some smaller one, so few rounds are left over.  The
    names of the rounds are then followed one after the other.  Nothing is collected; hot nodes are aggregated before the
    shuffle.
    """
    left = cut(links.select("a", "b").where("a <> b").mapInArrow(_local_roots, "a bigint, b bigint").distinct(), "links")
    named = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        names = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("name")), "names")
        left_of = names.select(F.col("node").alias("a"), F.col("name").alias("na"))
        right_of = names.select(F.col("node").alias("b"), F.col("name").alias("nb"))
        left = left.join(left_of, "a").join(right_of, "b").where("na <> nb").select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b"))
        left = cut(left.distinct(), "links")
        if named is None:
            named = names.withColumnRenamed("name", "component")
        else:
            named = named.join(names.select(F.col("node").alias("component"), "name"), "component", "left").select("node", F.coalesce("name", "component").alias("component"))
    if named is None:
        return links.sparkSession.createDataFrame([], "node bigint, component bigint")
    return cut(named, "components")
