"""A folder of text files as a relation (file, content).

``spark.read.format("project_tree").load(path)`` after ``register(spark)``: the driver walks the folder without entering
ignored ones, and lists of files are the partitions, read and decoded by executors.  What can't be read (a dangling link, a
file without permission or gone meanwhile, something that is no file) is left out, as is what isn't UTF-8.  (Spark's own file sources skip names
that begin with a dot or an underscore.)  For files that are already in a table, ``collected`` applies the same rules as
column expressions.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .ignore_rules import DEFAULT, Rules, gitignore_lines

CONFIG = ".sparkloom.json"
#: Bytes of files in a partition.
PARTITION_BYTES = 16 << 20


def decode(data: bytes) -> str | None:
    """UTF-8 with universal newlines, or None."""
    try:
        return data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return None


def load_config(root: str) -> dict[str, list[str]]:
    """include and ignore of a project's configuration; what is missing or malformed is left out."""
    try:
        with open(os.path.join(root, CONFIG), encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return {}
    if not isinstance(data, dict):
        return {}
    return {k: [p for p in data[k] if isinstance(p, str)] for k in ("include", "ignore") if isinstance(data.get(k), list)}


def init_config(root: str) -> str:
    """Write an empty configuration; one that is there stays."""
    path = os.path.join(root, CONFIG)
    with open(path, "x", encoding="utf-8") as f:
        json.dump({"include": [], "ignore": []}, f, indent=2)
    return path


def patterns(root: str, include: list[str] | None = None, ignore: list[str] | None = None) -> tuple[list[str], list[str]]:
    """(include, ignore) of the configuration and the call together."""
    own = load_config(root)
    return own.get("include", []) + (include or []), own.get("ignore", []) + (ignore or [])


def _size(path: str) -> int:
    about = os.stat(path)
    if not stat.S_ISREG(about.st_mode):
        raise OSError(f"not a file: {path}")
    return about.st_size


def list_files(root: str, include: list[str] | None = None, ignore: list[str] | None = None) -> list[tuple[str, int]]:
    """(relative path, bytes) in order of path."""
    lines = list(DEFAULT)
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            lines += gitignore_lines(f.read())
    except OSError:
        pass
    rules, wanted = Rules(lines + (ignore or [])), Rules(include) if include else None
    found = []
    for folder, folders, names in os.walk(root):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if at == "." else f"{at}/"
        folders[:] = sorted(d for d in folders if not rules.fits(prefix + d, True))
        for name in names:
            path = prefix + name
            if not rules.fits(path) and (wanted is None or wanted.covers(path)):
                with suppress(OSError):
                    found.append((path, _size(os.path.join(folder, name))))
    return sorted(found)


@dataclass
class _Files(InputPartition):
    root: str
    files: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://")
        self.include, self.ignore = (json.loads(options.get(k, "[]")) for k in ("include", "ignore"))
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        parts, held, size = [], [], 0
        for path, n in list_files(self.root, self.include, self.ignore):
            held.append(path)
            size += n
            if size >= self.size:
                parts.append(_Files(self.root, held))
                held, size = [], 0
        return [*parts, _Files(self.root, held)] if held or not parts else parts

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(partition.files), 500):
            rows = []
            for path in partition.files[at : at + 500]:
                with suppress(OSError), open(os.path.join(partition.root, path), "rb") as f:
                    if (text := decode(f.read())) is not None:
                        rows.append({"file": path, "content": text})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("content", pa.string())]))


class ProjectTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return "file string, content string"

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


def read(spark: SparkSession, root: str, include: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """The files of a folder within its configuration."""
    spark.dataSource.register(ProjectTree)
    include, ignore = patterns(root, include, ignore)
    return spark.read.format("project_tree").option("include", json.dumps(include)).option("ignore", json.dumps(ignore)).load(root)


def _decided(path: Column, rules: Rules, folder: bool) -> Column:
    """The last rule that fits a path, as an expression."""
    out = F.lit(False)
    for r in rules.rules:
        if folder or not r.folders:
            out = F.when(path.rlike(r.regex), F.lit(not r.negated)).otherwise(out)
    return out


def covered(path: Column, rules: Rules) -> Column:
    """Rules.covers() without Python: some folder above the path is matched, or the path is."""
    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))
    return F.exists(above, lambda p: _decided(p, rules, True)) | _decided(path, rules, False)


def collected(raw: DataFrame, include: list[str] | None = None, ignore: list[str] | None = None, gitignore: str = "") -> DataFrame:
    """(file, content) from (file, bytes): not ignored, within include, decodable."""
    kept = raw.where(~covered(F.col("file"), Rules([*DEFAULT, *gitignore_lines(gitignore), *(ignore or [])])))
    if include:
        kept = kept.where(covered(F.col("file"), Rules(include)))
    text = F.decode("bytes", "utf-8")
    return kept.where(F.is_valid_utf8(F.col("bytes").cast("string"))).select("file", F.regexp_replace(text, "\r\n?", "\n").alias("content"))
