"""Folders listed and files read in the tasks: no path of a tree reaches the driver.

A round lists all folders that the round before found, spread over the tasks, and skips what is left out before it goes
down. So a wide level is many tasks' work, and a tree takes as many rounds as it is deep. Paths are opened through
pyarrow's file systems (local, S3, GCS, ABFS, and HDFS where its library is there).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.plans.stage import drop, stage

#: Entries and bytes of contents that a batch holds, and bytes of files that a task reads on average.
ENTRIES, BATCH_BYTES, TASK_BYTES = 4096, 1 << 23, 1 << 27


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path on it) of a local path or a URI."""
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    fs, path = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), os.path.abspath(root))
    return fs, path.rstrip("/") or "/"


def _lister(root: str, skip: frozenset[str]):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(root)
        local = isinstance(fs, pafs.LocalFileSystem)
        paths, sizes = [], []

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size_bytes"])
            paths.clear()
            sizes.clear()
            return out

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                at = f"{top}/{folder}" if folder else top
                for x in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                    if x.base_name in skip or local and x.type == pafs.FileType.Directory and os.path.islink(x.path):
                        continue  # a link to a folder could lead round in a circle
                    if x.type in (pafs.FileType.Directory, pafs.FileType.File):
                        paths.append(f"{folder}/{x.base_name}" if folder else x.base_name)
                        sizes.append(x.size if x.type == pafs.FileType.File else None)
                    if len(paths) >= ENTRIES:
                        yield send()
        yield send()

    return entries


def listed(spark: SparkSession, root: str, skip: list[str] = ()) -> DataFrame:
    """(path, size_bytes) of every file below root, empty ones too, as paths relative to root; written in the shared folder.

    skip: names of files and folders that are left out wherever they stand. A folder that goes meanwhile is empty.
    """
    tasks = spark.sparkContext.defaultParallelism
    todo = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        level = stage(todo.repartition(tasks).mapInArrow(_lister(root, frozenset(skip)), "path string, size_bytes long"), "listing")
        files = level.filter("size_bytes IS NOT NULL")
        found = files if found is None else found.unionByName(files)
        todo = level.filter("size_bytes IS NULL").select("path")
        if not todo.head(1):
            return found


def contents(files: DataFrame, root: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """files (path relative to root, size_bytes) with `content` binary; tasks get about task_bytes each, and batches are bounded by bytes.

    A file that can't be read any more has null content. One file is held at a time, beside the batch that goes out.
    """
    total = files.agg(F.sum("size_bytes"), F.count("*")).first()
    parts = max(1, -(-(total[0] or 0) // task_bytes), -(-total[1] // 50_000))
    parts = max(parts, min(files.sparkSession.sparkContext.defaultParallelism, -(-total[1] // 16)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(root)
        rows: list[tuple] = []
        size = 0

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["path", "size_bytes", "content"])
            rows.clear()
            return out

        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = b""
                if n:
                    try:
                        with fs.open_input_stream(f"{top}/{path}") as f:
                            data = f.read()
                    except OSError:
                        data = None
                rows.append((path, n, data))
                size += len(data or b"")
                if size >= BATCH_BYTES or len(rows) >= ENTRIES:
                    yield send()
                    size = 0
        if rows:
            yield send()

    return files.select("path", "size_bytes").repartition(parts, F.xxhash64("path")).mapInArrow(read, "path string, size_bytes long, content binary")


def dropped(files: DataFrame) -> None:
    """Delete the written listing."""
    drop(files)
