"""A tree's files, level by level: folders of a level are listed in parallel, ignored folders are not entered.

A local tree is listed in the tasks, a tree in another store by Hadoop's file system. Both give hidden names, and
neither follows links. What the driver holds is the listing, as Spark's own file sources do.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.paths import ignored
from tessera.sources import store

LISTING = "path string, mtime long, size long"
#: Folders of a level from which tasks list them, folders of a task, and threads that list a store.
SPREAD, FOLDERS, THREADS = 64, 32, 16

Child = tuple[str, bool, int, int]  # path below the root, is a folder, seconds of change, bytes


@dataclass
class Walk:
    """The files of a tree (path, mtime, size) and the folders that were entered."""

    files: list[tuple[str, int, int]] = field(default_factory=list)
    entered: list[str] = field(default_factory=list)


def is_local(root: str) -> bool:
    return "://" not in root or root.startswith("file:/")


def local_path(root: str) -> str:
    return root.removeprefix("file://") if root.startswith("file://") else root.removeprefix("file:")


def _joined(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def list_local(base: str, folder: str) -> list[Child]:
    """What is in a folder of a local tree, without links and special files."""
    out = []
    with os.scandir(os.path.join(base, folder)) as entries:
        for e in entries:
            info = e.stat(follow_symlinks=False)
            if stat.S_ISDIR(info.st_mode) or stat.S_ISREG(info.st_mode):
                out.append((_joined(folder, e.name), stat.S_ISDIR(info.st_mode), int(info.st_mtime), info.st_size))
    return out


def list_store(spark: SparkSession, base: str, folder: str) -> list[Child]:
    """What is in a folder of any store, by its Hadoop file system."""
    return [(_joined(folder, name), is_folder, changed, size) for name, is_folder, changed, size in store.children(spark, _joined(base, folder))]


def _level(spark: SparkSession, base: str, folders: Sequence[str], local: bool) -> list[Child]:
    if not local:
        with ThreadPoolExecutor(THREADS) as pool:
            return [c for found in pool.map(lambda f: list_store(spark, base, f), folders) for c in found]
    if len(folders) < SPREAD:
        return [c for f in folders for c in list_local(base, f)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [c for f in batch.column(0).to_pylist() for c in list_local(base, f)]
            yield pa.RecordBatch.from_pydict({"path": pa.array([c[0] for c in found], pa.string()), "folder": pa.array([c[1] for c in found], pa.bool_()), "mtime": pa.array([c[2] for c in found], pa.int64()), "size": pa.array([c[3] for c in found], pa.int64())})

    rows = spark.createDataFrame([(f,) for f in folders], "path string").repartition(len(folders) // FOLDERS + 1)
    return [tuple(r) for r in rows.mapInArrow(listed, "path string, folder boolean, mtime long, size long").collect()]


def _entered(spark: SparkSession, folders: list[str], ignore: Sequence[str]) -> list[str]:
    """The folders that no pattern ignores; those above them were entered already."""
    if not ignore or not folders:
        return folders
    return [r["path"] for r in spark.createDataFrame([(f,) for f in folders], "path string").filter(~ignored(F.col("path"), ignore)).collect()]


def levels(spark: SparkSession, root: str, ignore: Sequence[str] = (), hadoop: bool = False) -> Iterator[tuple[list[str], list[Child]]]:
    """(folders, what is in them) of each level of the tree; ignored folders are not entered."""
    local = is_local(root) and not hadoop
    base = (local_path(root) if local else root).rstrip("/") or "/"
    folders = [""]
    while folders:
        found = _level(spark, base, folders, local)
        yield folders, found
        folders = _entered(spark, sorted(c[0] for c in found if c[1]), ignore)


def walk(spark: SparkSession, root: str, ignore: Sequence[str] = (), hadoop: bool = False) -> Walk:
    """All files of a tree that are in no ignored folder, by path. Folders that can't be listed are an error."""
    out = Walk()
    for folders, found in levels(spark, root, ignore, hadoop):
        out.entered += folders
        out.files += [(path, changed, size) for path, is_folder, changed, size in found if not is_folder]
    out.files.sort(key=lambda f: f[0].encode("utf-8", "surrogateescape"))
    return out


def with_contents(listing: DataFrame, root: str, batch_bytes: int = 32_000_000) -> DataFrame:
    """The files of a listing (path, mtime, size first) with their content, read where the task runs."""
    local = is_local(root)
    base = (local_path(root) if local else root).rstrip("/")

    def reader():
        if local:
            return lambda path: open(os.path.join(base or "/", path), "rb")
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(base)
        return lambda path: system.open_input_stream(f"{folder}/{path}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = reader()
        for batch in batches:
            start, held, size = 0, [], 0
            for i, path in enumerate(batch.column(0).to_pylist()):
                with opened(path) as f:
                    held.append(f.read())
                size += len(held[-1])
                if size >= batch_bytes or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(held)).columns, pa.array(held, pa.binary())], ["path", "mtime", "size", "content"])
                    start, held, size = i + 1, [], 0

    return listing.select("path", "mtime", "size").mapInArrow(read, LISTING + ", content binary")
