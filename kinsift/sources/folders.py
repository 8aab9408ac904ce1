"""Folders as a Spark data source: every task walks the folders of its part, so no process holds the whole listing.

The driver lists the folders of the first levels only, never a file. Folders above the last of these levels are
parts of their own, those on it are walked with all below them. Names that begin with ``_`` or ``.`` are
found like any other, and sizes, times and hidden attributes come from the walk itself.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinsift.plans.config import SYSTEM_FOLDERS, ScanConfig

SCHEMA = "root string, path string, size bigint, mtime timestamp, mtime_ns bigint, attrs int"

#: Levels of folders below each root that are listed to deal them to tasks.
LEVELS = 2

#: Files in an Arrow batch.
BATCH = 4096


@dataclass
class Part(InputPartition):
    root: str
    folder: str
    deep: bool


class Walker(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options["roots"].split("\n") if r]
        self.recursive = options.get("recursive", "true") == "true"
        self.hidden = options.get("hidden", "false") == "true"
        self.system = options.get("system", "false") == "true"
        self.levels = int(options.get("levels", LEVELS)) if self.recursive else 0

    def entered(self, name: str) -> bool:
        return (self.system or name.lower() not in SYSTEM_FOLDERS) and (self.hidden or not name.startswith("."))

    def listed(self, folder: str) -> Iterator[os.DirEntry]:
        """Entries of a folder; none if it is missing or closed to us."""
        try:
            with os.scandir(folder) as entries:
                yield from entries
        except OSError:
            return

    def below(self, folder: str) -> list[str]:
        """Folders that a walk goes on to; links to folders are not followed."""
        return sorted(e.path for e in self.listed(folder) if e.is_dir(follow_symlinks=False) and self.entered(e.name))

    def partitions(self) -> list[Part]:
        parts, level = [], [(root, root) for root in self.roots]
        for _ in range(self.levels):
            parts += [Part(root, folder, False) for root, folder in level]
            level = [(root, sub) for root, folder in level for sub in self.below(folder)]
        return parts + [Part(root, folder, self.recursive) for root, folder in level]

    def files(self, part: Part) -> Iterator[tuple]:
        todo = [part.folder]
        while todo:
            folder = todo.pop()
            for entry in self.listed(folder):
                if entry.is_dir(follow_symlinks=False):
                    if part.deep and self.entered(entry.name):
                        todo.append(entry.path)
                elif not entry.is_dir():
                    try:
                        found = entry.stat()
                        yield part.root, entry.path, found.st_size, found.st_mtime_ns // 1000, found.st_mtime_ns, getattr(found, "st_file_attributes", 0)
                    except OSError:  # vanished or unreadable: no size
                        yield part.root, entry.path, None, None, None, None

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("root", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")), ("mtime_ns", pa.int64()), ("attrs", pa.int32())])
        held = []
        for row in self.files(partition):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)


class Folders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Walker:  # noqa: ANN001
        return Walker(self.options)


def scan_folders(spark: SparkSession, roots: list[str], config: ScanConfig | None = None, levels: int = LEVELS) -> DataFrame:
    """(root, path, size, mtime, mtime_ns, attrs) of the files under roots, without reading their content.

    With a config the walk leaves out what its scope does: system and hidden folders, and all below the
    roots of a flat scan. Without one it enters every folder. Missing roots have no files; files that cannot be asked
    have no size. All executors must see the folders.
    """
    spark.dataSource.register(Folders)
    flags = {"recursive": True, "hidden": True, "system": True} if config is None else {"recursive": config.recursive, "hidden": not config.skip_hidden, "system": False}
    options = {k: str(v).lower() for k, v in flags.items()} | {"levels": str(levels), "roots": "\n".join(r.rstrip("/") or "/" for r in dict.fromkeys(roots))}
    return spark.read.format("folders").options(**options).load()
