"""Parts of one file, written and read by tasks in a folder that all share; rows don't pass the driver."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import udf

#: Bytes of a part, and of what is copied at once.
PART, PIECE = 32 << 20, 4 << 20
#: Partitions of a job over ranges at most.
TASKS = 10_000


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path)) if re.match(r"^\w+:/", path) else (pafs.LocalFileSystem(), path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; where that is unset and all runs on one machine, in a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='geoframe-')}"
        atexit.register(shutil.rmtree, root[7:], ignore_errors=True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def delete(folder: str) -> None:
    fs, base = filesystem(folder)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)


def visible(spark: SparkSession, paths: list[str], copy: Callable[[str, str], None] = shutil.copyfile) -> list[str]:
    """Local paths as tasks can open them: as they are on one machine and in the shared folder, else copies in that folder."""
    root = re.sub("^file:/+", "/", spark.conf.get("spark.checkpoint.dir", None) or "")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) or (root and all(os.path.abspath(p).startswith(root.rstrip("/") + "/") for p in paths)):
        return [os.path.abspath(p) for p in paths]
    folder = re.sub("^file:/+", "/", scratch(spark, "copies"))
    if re.match(r"^\w+:/", folder):
        raise ValueError("tasks can't open a local file of the driver: spark.checkpoint.dir must be a mounted folder")
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = [f"{folder}/{os.path.basename(p)}" for p in paths]
    for p, to in zip(paths, out):
        copy(p, to)
    return out


@contextmanager
def written(df: DataFrame, facts: str, write: Callable[[Iterator[pa.RecordBatch], Callable[[], str]], Iterator[tuple]]) -> Iterator[list]:
    """What write tells of each part, in the order of the rows; the parts are deleted in the end.

    write gets a task's batches and a function for new paths, and yields a tuple (of the columns facts) for each part written.
    Attempts of a task have names of their own: only those of the one that counts are told.
    """
    udf.ship(df.sparkSession)
    folder = scratch(df.sparkSession, "parts")
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    names = [x.split()[0] for x in facts.split(", ")]
    schema = f"task int, nth int, {facts}"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for nth, x in enumerate(write(batches, lambda: f"{folder}/{uuid.uuid4().hex}")):
            yield pa.RecordBatch.from_pylist([{"task": task, "nth": nth, **dict(zip(names, x))}], schema=arrow)

    try:
        yield [r[2:] for r in sorted(df.mapInArrow(run, schema).collect(), key=lambda r: r[:2])]
    finally:
        delete(folder)


def pieces(path: str) -> Iterator[bytes]:
    fs, at = filesystem(path)
    with fs.open_input_stream(at) as f:
        while piece := f.read(PIECE):
            yield piece


def whole(path: str) -> bytes:
    return b"".join(pieces(path))


def put(path: str, data: bytes) -> None:
    fs, at = filesystem(path)
    with fs.open_output_stream(at) as f:
        f.write(data)


def over(spark: SparkSession, ranges: list, schema, read: Callable[[object], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The batches that read makes of each range, a task a range, in order."""
    udf.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from read(ranges[i])

    if not ranges:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(ranges), 1, min(len(ranges), TASKS)).mapInArrow(run, schema)
