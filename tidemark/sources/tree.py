"""A directory tree as a Spark data source: one row a file, dotfiles included.

Spark's own binaryFile source leaves out names that begin with a dot or an underscore, so it can't show what must be excluded by rule.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidemark import vocabulary as V
from tidemark.errors import ScanError

SCHEMA = "path_raw binary, size long, kind string, content binary"
#: Files of a partition.
PARTITION_FILES = 500


def walk(root: str) -> list[bytes]:
    """The relative raw paths of all files below root, sorted; links aren't followed, excluded directories not entered."""
    from tidemark.operators.scan import excluded_folder

    found, todo, entries, size = [], [b""], 0, 0
    top = os.fsencode(root)
    while todo:
        folder = todo.pop()
        with os.scandir(os.path.join(top, folder) if folder else top) as listing:
            for entry in listing:
                path = folder + b"/" + entry.name if folder else entry.name
                entries, size = entries + 1, size + len(path) + 1
                if entries > V.MOST_CANDIDATES or size > V.MOST_PATH_BYTES:
                    raise ScanError("the tree has too many entries")
                if entry.is_dir(follow_symlinks=False):
                    if not excluded_folder(path.decode("utf-8", "surrogateescape")):
                        todo.append(path)
                else:
                    found.append(path)
    return sorted(found)


class _Files(InputPartition):
    def __init__(self, paths: list[bytes]):
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, paths: list[bytes] | None, most: int, with_content: bool):
        self.root, self.paths, self.most, self.with_content = root, paths, most, with_content

    def pushFilters(self, filters: list) -> Iterator:
        """Takes upper bounds of `size`, so that larger files are never opened."""
        for f in filters:
            if isinstance(f, LessThan) and f.attribute == ("size",):
                self.most = min(self.most, f.value - 1)
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("size",):
                self.most = min(self.most, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        paths = walk(self.root) if self.paths is None else self.paths
        return [_Files(paths[k : k + PARTITION_FILES]) for k in range(0, len(paths), PARTITION_FILES)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            yield (bytearray(path), *self._one(path))

    def _one(self, path: bytes) -> tuple[int, str, bytearray | None]:
        """(size, kind, content); kind is file, or the reason why the content isn't there."""
        at = os.fsencode(self.root)
        try:
            for part in path.split(b"/"):
                at = os.path.join(at, part)
                before = os.lstat(at)
                if stat.S_ISLNK(before.st_mode):
                    return before.st_size, "symlink_or_junction", None
            if not stat.S_ISREG(before.st_mode):
                return before.st_size, "not_regular_file", None
            if before.st_size > self.most or not self.with_content:
                return before.st_size, "file", None
            with open(at, "rb") as f:
                data = f.read(self.most + 1)
            after = os.lstat(at)
        except OSError:
            return 0, "io_error", None
        if (before.st_size, before.st_mtime_ns, before.st_ino) != (after.st_size, after.st_mtime_ns, after.st_ino) or len(data) != before.st_size:
            return before.st_size, "changed_during_read", None
        return before.st_size, "file", bytearray(data)


class TreeSource(DataSource):
    """spark.read.format("tidemark_tree").load(root); options: maxFileSize (larger ones have no content), content (false: sizes only)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        listed = self.options.get("listed")
        paths = [bytes.fromhex(x) for x in listed.split(",") if x] if listed is not None else None
        return _TreeReader(self.options["path"], paths, int(self.options.get("maxFileSize", V.MOST_FILE_BYTES)), self.options.get("content", "true") == "true")


def read_tree(spark: SparkSession, root: str, max_file_size: int = V.MOST_FILE_BYTES, paths: list[bytes] | None = None) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tidemark_tree").option("maxFileSize", max_file_size)
    if paths is not None:
        reader = reader.option("listed", ",".join(p.hex() for p in paths))
    return reader.load(os.path.abspath(root))
