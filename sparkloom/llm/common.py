"""What the operators share: tables, words, hashing and the shared folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..tables import _written, cut, release, shared_path  # noqa: F401  the operators take them from here

#: The words of the contracts: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes.split() breaks at the bytes 0x20 and 0x09-0x0D and at no others."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """words() with A-Z lower-cased: bytes.lower() changes ASCII letters only."""
    return text.lower().split() if text else []


class Memo(dict):
    """word -> value, computed once; emptied when it has grown to its bound, so that memory stays bounded."""

    def __init__(self, make, bound: int = 300_000):
        super().__init__()
        self.make, self.bound = make, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self[key] = self.make(key)
        return value


word_hash = xxhash.xxh3_64_intdigest


def hashes(tokens: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each width consecutive tokens: a polynomial of their hashes, mixed."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(_BASE) + h[k : k + n]
    return mix(out)


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The batches' rows, one at a time; strings as UTF-8 bytes, without a copy of the whole batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield from zip(*(_plain(part.column(n)).to_pylist() for n in names), strict=True)


def _plain(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column


class Out:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 5000, size: int = 4_000_000):
        self.schema, self.rows, self.size = schema, rows, size
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.held = 0

    def add(self, *values, size: int = 0) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.held += size

    def full(self) -> bool:
        return len(self.columns[0]) >= self.rows or self.held >= self.size

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.clear()
        return batch
