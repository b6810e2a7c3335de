"""Listing folders of any number of files by the executors, one level of folders at a time.

The folders of a level are dealt over tasks, each of which asks the store for what lies directly in its folders; the folders that
they find are the next level. Names go from task to task through written tables, so the driver sees none of them and only
counts levels; a lost task asks again for its folders. The work is even however deep or lopsided the tree is. Only a folder's own entries are
held at once, by the task that lists it.

Stores are those that pyarrow knows by their URI: local or mounted paths, s3, gs, hdfs.

Defined results: a missing root, and a folder that goes while it is listed, are empty. Names are taken as they are, in any script, blanks and
percent signs included. Folders themselves are no rows. Links are followed. Times are in UTC.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.session import work_folder

ENTRIES = "id string, size bigint, last_modified timestamp, is_folder boolean"
_ARROW = pa.schema([("id", pa.string()), ("size", pa.int64()), ("last_modified", pa.timestamp("us", "UTC")), ("is_folder", pa.bool_())])
#: Entries handed on at once.
_BATCH = 1 << 14


def entries(root: str, folder: str) -> Iterator[pa.RecordBatch]:
    """What lies directly in a folder, which is named from the root."""
    store, base = fs.FileSystem.from_uri(root)
    base = base.rstrip("/")
    found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/") or "/", allow_not_found=True))
    for start in range(0, len(found), _BATCH):
        rows = [
            {"id": info.path[len(base) :].lstrip("/"), "size": info.size, "last_modified": info.mtime, "is_folder": info.type == fs.FileType.Directory}
            for info in found[start : start + _BATCH]
        ]
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def list_files(spark: SparkSession, root: str, prefix: str = "", tasks: int | None = None) -> DataFrame:
    """id (path from the root), size and last_modified of every file below a folder of the root, at any depth."""
    tasks = tasks or spark.sparkContext.defaultParallelism

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("id").to_pylist():
                yield from entries(root, folder)

    level, levels = spark.range(1).select(F.lit(prefix.strip("/")).alias("id")), []
    while not level.isEmpty():
        path = work_folder(spark, "listing")
        # A number of tasks is named, so that few folders aren't put together in one task.
        level.repartition(tasks, "id").mapInArrow(of, ENTRIES).write.parquet(path)
        found = spark.read.schema(ENTRIES).parquet(path)
        levels.append(found.where("not is_folder").drop("is_folder"))
        level = found.where("is_folder").select("id")
    return reduce(DataFrame.unionByName, levels)
