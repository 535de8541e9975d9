"""A folder of Markdown files as a data source: ``spark.read.format("markdown_vault")``.

Each partition reads a share of the files; the driver only lists names.  Columns: path
(relative, with /), text (strict UTF-8), created, modified (local ISO seconds, null where
the file system can't tell).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmesh.operators.notes import exclude_tags, notes_from_files

FILES_A_TASK = 256


def stamp(path: str, attribute: str) -> str | None:
    try:
        return datetime.fromtimestamp(getattr(os.stat(path), attribute)).isoformat(timespec="seconds")
    except (OSError, AttributeError):
        return None


def walk(root: str, exclude: frozenset[str]) -> Iterator[str]:
    """Relative paths of Markdown files, hidden ones included; folders with an excluded name are left out at any depth."""
    for folder, inner, files in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in exclude)
        for name in sorted(files):
            if name.lower().endswith(".md"):
                yield os.path.relpath(os.path.join(folder, name), root)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class VaultReader(DataSourceReader):
    def __init__(self, root: str, exclude: frozenset[str]):
        self.root, self.exclude = root, exclude

    def partitions(self) -> list[Files]:
        paths = list(walk(self.root, self.exclude))
        return [Files(paths[k : k + FILES_A_TASK]) for k in range(0, len(paths), FILES_A_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            full = os.path.join(self.root, path)
            text = Path(full).read_text(encoding="utf-8")
            yield path.replace(os.sep, "/"), text, stamp(full, "st_ctime"), stamp(full, "st_mtime")


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown_vault"

    def schema(self) -> str:
        return "path string, text string, created string, modified string"

    def reader(self, schema) -> VaultReader:
        names = frozenset(x for x in self.options.get("exclude", "").split(",") if x)
        return VaultReader(self.options["path"], names)


def read_vault(spark: SparkSession, path: str, exclude_dirs: list[str] | None = None, without_tags: list[str] | None = None) -> DataFrame:
    """Notes of a vault."""
    if not os.path.isdir(path):
        raise FileNotFoundError(f"no such folder: {path}")
    spark.dataSource.register(VaultSource)
    files = spark.read.format("markdown_vault").option("exclude", ",".join(exclude_dirs or [])).load(path)
    return exclude_tags(notes_from_files(files), without_tags or [])
