"""Arrow streams to and from other programs."""

from __future__ import annotations

import atexit
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import _check_arrow_table_timestamps_localize, to_arrow_schema

from ..functions import native
from ..plans import metadata
from . import parts

#: Rows of a batch.
ROWS = 10_000
#: What ends a stream (a fixed value).
END = b"\xff\xff\xff\xff\0\0\0\0"


def write(df: DataFrame, stream, *, geometry: str | None, crs=None) -> int:
    """Batches of rows in the order of partitions, encoded by tasks; the geometry is marked as such for those who know."""
    plain = schema = to_arrow_schema(df.schema.toNullable())
    if geometry:
        meta = json.dumps({"crs": crs} if crs else {})
        i = schema.get_field_index(geometry)
        schema = schema.set(i, schema.field(i).with_metadata({"ARROW:extension:name": native.NAME, "ARROW:extension:metadata": meta}))
        schema = schema.with_metadata({"geo": json.dumps(metadata.build(geometry, crs=crs))})

    def encode(batches: Iterator[pa.RecordBatch], new: Callable[[], str]) -> Iterator[tuple]:
        held, n = [], 0
        for batch in batches:
            for x in pa.Table.from_batches([batch]).cast(plain).to_batches(max_chunksize=ROWS):
                held.append(memoryview(x.serialize()))
                n += x.num_rows
                if sum(map(len, held)) >= parts.PART:
                    parts.put(path := new(), b"".join(held))
                    yield path, n
                    held, n = [], 0
        if held:
            parts.put(path := new(), b"".join(held))
            yield path, n

    with parts.written(df, "path string, n long", encode) as found:
        stream.write(schema.serialize().to_pybytes())
        for path, _ in found:
            for piece in parts.pieces(path):
                stream.write(piece)
        stream.write(END)
        return sum(n for _, n in found)


def read(spark: SparkSession, stream) -> tuple[DataFrame, dict | str | None]:
    """(rows, reference system) of a stream. As a pipe can be read only once, the driver passes its batches on to files in the
    shared folder, a few at a time; they go when the session's program ends."""
    source = pa.ipc.open_stream(stream)
    geo = json.loads((source.schema.metadata or {}).get(b"geo", b"{}"))
    crs = geo.get("columns", {}).get(geo.get("primary_column"), {}).get("crs")
    types = [f.type.storage_type if isinstance(f.type, pa.BaseExtensionType) else f.type for f in source.schema]
    plain = pa.schema([pa.field(f.name, t.value_type if pa.types.is_dictionary(t) else t) for f, t in zip(source.schema, types)])
    kind = spark.createDataFrame(plain.empty_table()).schema
    target, zone = to_arrow_schema(kind := kind.toNullable()), spark.conf.get("spark.sql.session.timeZone")
    folder = parts.scratch(spark, "stream")
    fs, base = parts.filesystem(folder)
    fs.create_dir(base, recursive=True)
    atexit.register(parts.delete, folder)
    files: list[str] = []

    def flush(tables: list[pa.Table]) -> None:
        files.append(f"{folder}/{len(files)}")
        fs, at = parts.filesystem(files[-1])
        with fs.open_output_stream(at) as f, pa.ipc.new_stream(f, target) as out:
            for t in tables:
                out.write_table(t, max_chunksize=ROWS)

    held: list[pa.Table] = []
    for batch in source:
        columns = [c.storage if isinstance(c, pa.ExtensionArray) else c for c in batch.columns]
        table = pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, plain)], schema=plain)
        # times without a zone are those of the session's, and nanoseconds are cut, as where Spark takes a table itself
        table = _check_arrow_table_timestamps_localize(table, kind, True, zone)
        held.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(table.columns, target)], schema=target))
        if sum(t.nbytes for t in held) >= parts.PART:
            flush(held)
            held = []
    if held:
        flush(held)

    def batches(path: str) -> Iterator[pa.RecordBatch]:
        fs, at = parts.filesystem(path)
        with fs.open_input_stream(at) as f:
            yield from pa.ipc.open_stream(f)

    return parts.over(spark, files, kind, batches), crs
