"""Folder listings as a Spark data source: folders are dealt out to tasks and listed there."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, path string, depth int, is_dir boolean, size bigint, modified timestamp"
SPREAD = 64  # the driver looks for about so many folders to deal out; it keeps names of folders, never files


class Folder(InputPartition):
    def __init__(self, at: str, below: bool):
        self.at, self.below = at, below


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.recursive = options.get("recursive", "true") == "true"
        self.hidden = options.get("includehidden", "false") == "true"
        self.deepest = int(options["maxdepth"]) if "maxdepth" in options else None

    def _level(self, files, at: str) -> list:
        """What lies directly in a folder; a folder that has gone since holds nothing."""
        from pyarrow import fs

        found = files.get_file_info(fs.FileSelector(at, recursive=False, allow_not_found=True))
        return [f for f in found if self.hidden or not f.base_name.startswith(".")]

    def _goes_down(self, root: str, at: str) -> bool:
        depth = at[len(root) :].count("/")  # of what lies in `at`
        return self.recursive and (self.deepest is None or depth <= self.deepest)

    def partitions(self):
        """Folders near the root one by one, everything below the last of them as wholes."""
        from pyarrow import fs

        files, root = _opened(self.path)
        root = root.rstrip("/")
        if files.get_file_info(root or "/").type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder: {self.path}")
        single, whole = [], [root]
        while whole and len(whole) < SPREAD and self.recursive:
            inner = [f.path for at in whole for f in self._level(files, at) if not f.is_file and self._goes_down(root, f.path)]
            single += whole
            whole = inner
        return [*(Folder(at, False) for at in single), *(Folder(at, self.recursive) for at in whole)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        files, root = _opened(self.path)
        root, todo = root.rstrip("/"), [partition.at]
        while todo:
            for f in self._level(files, todo.pop()):
                relative = f.path[len(root) :].lstrip("/")
                moment = None if f.mtime_ns is None else dt.datetime.fromtimestamp(f.mtime_ns / 1e9, dt.timezone.utc)
                yield f.base_name, relative, relative.count("/"), not f.is_file, f.size if f.is_file else None, moment
                if partition.below and not f.is_file and self._goes_down(root, f.path):
                    todo.append(f.path)


class FolderSource(DataSource):
    """``spark.read.format("tidemark_folder").load(path)``; options recursive, includeHidden, maxDepth."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()})
