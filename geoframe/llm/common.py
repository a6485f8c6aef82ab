"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; any store that Spark's readers open."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of texts that a Python worker is sent at once, at most (a longer text comes alone).
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where PYTHONPATH doesn't name it, and bound what they hold at once."""
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = env.get("PYTHONPATH") or _ROOT
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where that is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="geoframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df in the shared folder and read it back: cuts the lineage and survives lost executors.

    Unlike DataFrame.checkpoint() the plan runs once and the copy is columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


#: Where each cut that is still referred to lies, by the identity of its DataFrame.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def drop(*cuts: DataFrame | None) -> None:
    """Delete cuts that nothing reads any more: what was made of them has been cut, too."""
    for df in cuts:
        found = _PATHS.pop(id(df), None)
        if found and found[0]() is df:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(found[1])
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Cuts:
    """cut(), with a list of what to delete in the end."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        self.made.append(cut(df, label))
        return self.made[-1]


#: Identity of a row: its file and its place there.  Stable when tasks run again, distinct for repeated rows.
ROW = ["fid", "rix"]


def with_rows(df: DataFrame, **names: str) -> DataFrame:
    """The named columns (new name = old name) with ROW; what isn't a plain file scan is written first."""

    def take(x: DataFrame) -> DataFrame:
        at = x.metadataColumn("_metadata")
        return x.select(F.xxhash64(at["file_path"]).alias("fid"), at["row_index"].alias("rix"), *[F.col(f"`{c}`").alias(new) for new, c in names.items()])

    try:
        return take(df)
    except AnalysisException:
        return take(cut(df, "rows"))


def scanned(df: DataFrame) -> DataFrame:
    """df itself if its rows can be told by file and place, else a cut of it."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
        return df
    except AnalysisException:
        return cut(df, "rows")


def release() -> None:
    """Give freed memory back at the end of a task: Python workers live on beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps or gives back memory as it likes


def with_text_ids(df: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f(df), with doc_id as text meanwhile: pandas makes a long column with nulls one of doubles."""
    kind = df.schema["doc_id"].dataType
    return f(df.withColumn("doc_id", F.col("doc_id").cast("string"))).withColumn("doc_id", F.col("doc_id").cast(kind))


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{c}`").alias(new) for new, c in names.items()])
