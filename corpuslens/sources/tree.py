"""A data source for trees of files: ``spark.read.format("file_tree").load(root)``.

The root's folders (collections) are the partitions; what is in them is listed by the tasks, hidden names too, on any file
system that pyarrow opens. Paths never come together in the driver, and a folder or file that can't be read is a row with
its ``error`` instead of the end of the scan.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "collection string, relative_path string, full_path string, error string"


def opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """A file system, the root's path in it, and what full paths begin with (nothing for mounted ones)."""
    clean = re.sub("^file:/+", "/", root)
    system, path = fs.FileSystem.from_uri(clean)
    return system, path.rstrip("/"), clean.rstrip("/").removesuffix(path.rstrip("/"))


def children(system: fs.FileSystem, folder: str) -> list[tuple[str, bool]]:
    """What a folder holds, in order: paths, and whether they are folders. Links to folders are not followed, and a link to
    nothing is listed like a file, so that it shows up when it is read."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            return sorted((x.path, x.is_dir(follow_symlinks=False)) for x in found)
    return sorted((x.path, x.type == fs.FileType.Directory) for x in system.get_file_info(fs.FileSelector(folder)))


class _Folder(InputPartition):
    def __init__(self, name: str, path: str) -> None:
        self.name, self.path = name, path


class _Reader(DataSourceReader):
    def __init__(self, root: str, suffix: str, folders: list[tuple[str, str]] | None) -> None:
        self.root, self.suffix, self.folders = root, suffix, folders

    def partitions(self) -> list[_Folder]:
        if self.folders is not None:
            return [_Folder(*x) for x in self.folders] or [_Folder("", "")]
        system, path, _ = opened(self.root)
        if system.get_file_info(path).type != fs.FileType.Directory:
            raise ValueError(f"no such folder: {self.root}")
        found = system.get_file_info(fs.FileSelector(path))
        return [_Folder(x.base_name, f"{self.root.rstrip('/')}/{x.base_name}") for x in found if x.type == fs.FileType.Directory] or [_Folder("", "")]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        if not partition.path:
            return
        system, base, lead = opened(partition.path)
        todo = [base]
        while todo:
            folder = todo.pop()
            try:
                found = children(system, folder)
            except OSError as e:
                yield partition.name, folder.removeprefix(base).lstrip("/"), lead + folder, str(e)
                continue
            for path, is_folder in found:
                if is_folder:
                    todo.append(path)
                elif path.endswith(self.suffix):
                    yield partition.name, path[len(base) + 1 :], lead + path, None


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        folders = self.options.get("folders")
        return _Reader(self.options["path"], self.options.get("suffix", ".md"), folders and json.loads(folders))


def listed(spark: SparkSession, root: str, suffix: str = ".md", folders: list[tuple[str, str]] | None = None) -> DataFrame:
    """``collection, relative_path, full_path, error`` of the files below the folders of a root, or below the folders named
    (collection, path), which lie on the root's file system. A folder that isn't there is a row with an error."""
    spark.dataSource.register(FileTree)
    rows = spark.read.format("file_tree").option("suffix", suffix)
    return (rows if folders is None else rows.option("folders", json.dumps(folders))).load(root)


def with_contents(names: DataFrame, root: str) -> DataFrame:
    """Listed files with ``content``; bytes that are no UTF-8 are replaced, and a file that can't be read gets its ``error``.
    Names are dealt out anew first, since collections differ in size. Memory: the files of a few names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _, lead = opened(root)
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                some = batch.slice(i, 16)
                contents, errors = [], some.column("error").to_pylist()
                for k, path in enumerate(some.column("full_path").to_pylist()):
                    content = None
                    if errors[k] is None:
                        try:
                            with system.open_input_stream(path.removeprefix(lead)) as f:
                                content = f.read().decode("utf-8", "replace")
                        except OSError as e:
                            errors[k] = str(e)
                    contents.append(content)
                columns = [some.column(c) for c in ("collection", "relative_path", "full_path")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(contents, pa.string()), pa.array(errors, pa.string())], ["collection", "relative_path", "full_path", "content", "error"])

    spread = names.repartition(4 * names.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(run, "collection string, relative_path string, full_path string, content string, error string")
