"""Writers: Parquet with `geo` metadata, partitioned layouts, CSV, GeoJSON and GeoPackage."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import expr, native, udf, wkb
from ..operators.aggregate import analyze_partitions, partition_key
from ..operators.extract import bbox_column, geometry_column
from ..plans import metadata
from . import parts

#: Between the values of a nested key; no value of an admin level holds it.
BETWEEN = "\x1f"
#: Rows of one value that a task writes, about.
ROWS_PER_FILE = 1_000_000


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"^\w+://", path) else (pafs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _ParquetWriter(DataSourceArrowWriter):
    """Each task writes its own files under a temporary name, with the bounds and types of what they hold; the commit gives
    them their names.  All of it lies in a folder beside the target (see _beside), with which goes what lost attempts left."""

    def __init__(self, options: dict):
        self.o = options
        self.job = uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        o = self.o
        key, root = o.get("key"), o["path"].rstrip("/")
        fs, base = _fs(root)
        open_files: dict = {}
        done: list[tuple[str, str]] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for value in table.column(key).unique().to_pylist() if key else [None]:
                for other in [v for v in open_files if v != value]:  # rows come sorted by key
                    done.append((open_files.pop(other).close(), _file_name(o, other)))
                part = table.filter(pa.compute.equal(table.column(key), value)) if key else table
                if key and o["keep"] != "true":
                    part = part.drop([key])
                if value not in open_files:
                    name = f"{base}/_{self.job}-{uuid.uuid4().hex[:12]}.tmp"
                    open_files[value] = _OpenFile(fs, name, part.schema, o)
                open_files[value].add(part)
        return _Written(done + [(f.close(), _file_name(o, v)) for v, f in open_files.items()])

    def commit(self, messages) -> None:
        fs, base = _fs(self.o["path"].rstrip("/"))
        used: dict[str, int] = {}
        for m in messages:
            for tmp, name in m.files if m else []:
                n = used[name] = used.get(name, -1) + 1
                stem = name.removesuffix(".parquet")
                target = f"{base}/{stem if not n else f'{stem}-{n}'}.parquet"
                fs.create_dir(target.rpartition("/")[0], recursive=True)
                fs.move(tmp, target)

    def abort(self, messages) -> None:
        fs, _ = _fs(self.o["path"].rstrip("/"))
        for m in messages:
            for tmp, _name in m.files if m else []:
                fs.delete_file(tmp)


class _OpenFile:
    def __init__(self, fs, name: str, schema: pa.Schema, options: dict):
        self.fs, self.name, self.o = fs, name, options
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        codec, level = options["codec"], options.get("level")
        self.stream = fs.open_output_stream(name)
        self.kind = native.wkb_type(json.loads(options["crs"]) if options.get("crs") else None, options.get("edges")) if options["version"] == "2.0" else None
        if self.kind is not None:
            schema = schema.set(schema.get_field_index(options["geometry"]), pa.field(options["geometry"], self.kind))
        self.writer = pq.ParquetWriter(self.stream, schema, compression=codec, compression_level=int(level) if level else None)
        self.box, self.kinds = None, set()

    def add(self, table: pa.Table) -> None:
        geometry = self.o["geometry"]
        for value in table.column(geometry).to_pylist():
            if value is not None:
                try:
                    g = wkb.parse(value)
                except wkb.BadGeometry:
                    continue
                self.kinds.add(wkb.GEOJSON[g.kind] + (" Z" if g.dims > 2 and not g.m else ""))
                e = wkb.envelope(g)
                if e:
                    b = self.box
                    self.box = e if b is None else (min(b[0], e[0]), min(b[1], e[1]), max(b[2], e[2]), max(b[3], e[3]))
        if self.kind is not None:
            table = native.as_native(table, geometry, self.kind)
        self.writer.write_table(table, row_group_size=int(self.o["rows"]))

    def close(self) -> str:
        o = self.o
        meta = metadata.build(o["geometry"], version=o["version"], bbox=self.box, geometry_types=sorted(self.kinds), crs=json.loads(o["crs"]) if o.get("crs") else None, bbox_column=o.get("bbox"), original=json.loads(o["original"]) if o.get("original") else None)
        if o.get("geo_only") != "true":
            self.writer.add_key_value_metadata({"geo": json.dumps(meta)})
        self.writer.close()
        self.stream.close()
        return self.name


def _file_name(o: dict, value) -> str:
    if not o.get("key"):
        return "part.parquet"
    prefix = f"{o['prefix']}_" if o.get("prefix") else ""
    if o.get("labels"):  # nested folders, the last value names the file
        values = str(value).split(BETWEEN)
        folders = [f"{label}={v}" if o["hive"] == "true" else sanitize(v) for label, v in zip(o["labels"].split(BETWEEN), values)]
        return f"{'/'.join(folders)}/{prefix}{sanitize(values[-1])}.parquet"
    name = sanitize(str(value))
    return f"{o['label']}={value}/{prefix}{name}.parquet" if o["hive"] == "true" else f"{prefix}{name}.parquet"


class ParquetSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geoframe_parquet"

    def writer(self, schema, overwrite):
        return _ParquetWriter(dict(self.options))


def _write(df: DataFrame, path: str, geometry: str, version: str, codec: str, level, rows: int, crs, original, **more) -> None:
    spark = df.sparkSession
    udf.ship(spark)
    spark.dataSource.register(ParquetSink)
    c, lv = metadata.compression(codec, level)
    w = df.write.format("geoframe_parquet").mode("append").option("path", path).option("geometry", geometry).option("version", metadata.version_for(original, version)).option("codec", c).option("rows", str(rows))
    for k, v in {"level": lv, "bbox": bbox_column(df), "crs": json.dumps(crs) if crs else None, "original": json.dumps(original) if original else None, **more}.items():
        if v is not None:
            w = w.option(k, str(v))
    w.save()


@contextmanager
def _beside(path: str, overwrite: bool) -> Iterator[str]:
    """A folder beside path to write in, which then takes its place: until all is written the old data stay, and may be read.

    A failed write leaves path as it was.
    """
    fs, base = _fs(path.rstrip("/"))
    there = lambda x: fs.get_file_info(x).type
    if there(base) != pafs.FileType.NotFound and not overwrite:
        raise FileExistsError(f"{path} is there already; overwrite it explicitly")
    head, _, name = path.rstrip("/").rpartition("/")
    mark = uuid.uuid4().hex[:12]
    staged = f"{head}/.{name}-{mark}.new" if head else f".{name}-{mark}.new"
    new, old = _fs(staged)[1], f"{_fs(staged)[1][:-4]}.old"
    if "/" in base.strip("/"):
        fs.create_dir(base.rpartition("/")[0] or "/", recursive=True)
    remove = lambda x: fs.delete_dir(x) if there(x) == pafs.FileType.Directory else fs.delete_file(x) if there(x) == pafs.FileType.File else None
    try:
        yield staged
        if there(new) == pafs.FileType.NotFound:
            fs.create_dir(new, recursive=True)
        if there(new) == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(new)):
                if f.base_name.endswith(".tmp"):
                    fs.delete_file(f.path)
        if there(base) != pafs.FileType.NotFound:
            fs.move(base, old)
        fs.move(new, base)
    finally:
        remove(new)
    remove(old)


def write_parquet(df: DataFrame, path: str, *, version: str | None = None, overwrite: bool = False, codec: str = "ZSTD", level: int | None = None, row_group_rows: int = 100_000, crs=None, original: dict | None = None, geo_only: bool = False) -> None:
    """A folder of Parquet files, a file a task, each with `geo` metadata of its own bounds and geometry types.

    Version 2.0 has native geometry types, whose statistics stand in for an envelope column, which therefore goes; with geo_only
    it has nothing but those, no `geo` metadata.
    """
    geometry = geometry_column(df)
    if geometry is None:
        raise ValueError("no geometry")
    if geo_only:
        version = "2.0"
    if metadata.version_for(original, version) == "2.0" and (box := bbox_column(df)):
        df = df.drop(box)
    with _beside(path, overwrite) as staged:
        _write(df, staged, geometry, version, codec, level, row_group_rows, crs, original, geo_only=str(geo_only).lower())


def sanitize(value: str) -> str:
    """A file name: other than letters, digits, dot, dash and underscore become underscores, not doubled or outside."""
    return re.sub(r"_+", "_", re.sub(r"[^a-zA-Z0-9._-]", "_", value)).strip("_.")


def partition_by(df: DataFrame, path: str, column: str, *, prefix: int | None = None, hive: bool = False, keep_column: bool = True, overwrite: bool = False, force: bool = False, filename_prefix: str | None = None, version: str | None = None) -> int:
    """A folder or file for each value of a column (or of its first characters); the number of values is returned.

    Null values are left out; all null is an error, as are two values with one file name and, unless forced, a
    partitioning that the analysis is against.  Rows are dealt by value; those of a value with more than ROWS_PER_FILE rows to
    as many tasks, each with a file of its own, as that takes.
    """
    geometry = geometry_column(df)
    key = partition_key(column, prefix)
    rows = df.withColumn("_key", key.cast("string")).where("_key is not null")
    counts = rows.groupBy("_key").agg(F.count("*").alias("n"))
    n = counts.count()
    if not n:
        raise ValueError(f"{column} holds no values")
    if not hive:
        name = F.regexp_replace(F.regexp_replace(F.regexp_replace("_key", "[^a-zA-Z0-9._-]", "_"), "_+", "_"), "^[_.]+|[_.]+$", "")
        if shared := counts.groupBy(name.alias("name")).agg(F.min("_key").alias("a"), F.max("_key").alias("b")).where("a <> b").first():
            raise ValueError(f"{shared['a']!r} and {shared['b']!r} would share the file {shared['name']}")
    if not force and (report := analyze_partitions(df, column, prefix)).errors:
        raise ValueError("; ".join(report.errors))
    if not keep_column:
        rows = rows.drop(column)
    label = column if prefix is None else f"{column}_prefix"
    with _beside(path, overwrite) as staged:
        _write(_dealt(rows, counts), staged, geometry, version, "ZSTD", None, 100_000, None, None, key="_key", label=label, hive=str(hive).lower(), keep="false", prefix=filename_prefix)
    return n


def _dealt(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows by _key, sorted; those of keys (counts: _key, n) with more than ROWS_PER_FILE rows in several partitions."""
    # as many as fit into the table at most, so small beside it
    large = counts.where(F.col("n") > ROWS_PER_FILE).select(F.col("_key").alias("_large"), F.ceil(F.col("n") / ROWS_PER_FILE).cast("int").alias("_parts"))
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    salted = rows.join(large, F.col("_key") == F.col("_large"), "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.col("_parts")).cast("int"), F.lit(0)))
    return salted.repartition("_key", "_part").sortWithinPartitions("_key").select(*rows.columns)


def partition_by_levels(df: DataFrame, path: str, levels: dict[str, str], *, keep: list[str], hive: bool = True, overwrite: bool = False, filename_prefix: str | None = None, version: str | None = None) -> int:
    """Nested folders, one for each level (label: column), with the columns `keep`; the number of files is returned.

    Rows without a value of every level are left out; none with one is an error.
    """
    values = [F.col(f"`{c}`").cast("string") for c in levels.values()]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.when(F.size(F.array_compact(F.array(*values))) == len(values), F.concat_ws(BETWEEN, *values)).alias("_key")).where("_key is not null")
    counts = rows.groupBy("_key").agg(F.count("*").alias("n"))
    n = counts.count()
    if not n:
        raise ValueError("no row has all levels")
    with _beside(path, overwrite) as staged:
        _write(_dealt(rows, counts), staged, geometry_column(df), version, "ZSTD", None, 100_000, None, None, key="_key", labels=BETWEEN.join(levels), hive=str(hive).lower(), keep="false", prefix=filename_prefix)
    return n


def csv_frame(df: DataFrame, *, include_wkt: bool = True, include_bbox: bool = True) -> DataFrame:
    """Geometry as text in `wkt`, structs, lists and maps as JSON."""
    geom, box = geometry_column(df), bbox_column(df)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == geom:
            if include_wkt:
                out.append(udf.as_text(c).alias("wkt"))
        elif f.name == box and not include_bbox:
            continue
        else:
            out.append(F.to_json(c).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else c)
    return df.select(*out)


def write_csv(df: DataFrame, path: str, *, include_wkt: bool = True, include_bbox: bool = True, overwrite: bool = False) -> None:
    with _beside(path, overwrite) as staged:
        csv_frame(df, include_wkt=include_wkt, include_bbox=include_bbox).write.option("header", True).option("escape", '"').csv(staged)


def geojson_features(df: DataFrame, *, precision: int = 7, write_bbox: bool = False, id_field: str | None = None, crs: str = "OGC:CRS84", keep_crs: bool = False) -> DataFrame:
    """One column `value`: a feature a row as JSON text; rows without geometry are left out."""
    geom, box = geometry_column(df), bbox_column(df)
    g = F.col(f"`{geom}`")
    rows = df.where(g.isNotNull())
    if not keep_crs and metadata.is_geographic(crs) is False:
        rows = rows.withColumn(geom, udf.transform(g, crs, "OGC:CRS84"))
    properties = [c for c in df.columns if c not in (geom, id_field) and c.lower() != "bbox" and c != box]
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in properties]), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    parts = [F.lit('{"type":"Feature",')]
    if id_field:
        i = F.col(f"`{id_field}`")
        parts.append(F.concat(F.lit('"id":'), F.coalesce(F.regexp_extract(F.to_json(F.struct(i.alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":(.*)\}$', 1), F.lit("null")), F.lit(",")))
    if write_bbox:
        e = udf.envelope(g)
        parts.append(F.concat(F.lit('"bbox":['), F.concat_ws(",", *[F.round(e[n], precision).cast("string") for n in expr.BBOX_FIELDS]), F.lit("],")))
    parts += [F.lit('"geometry":'), udf.as_geojson(g, precision), F.lit(',"properties":'), body, F.lit("}")]
    return rows.select(F.concat(*parts).alias("value"))


def write_geojson(df: DataFrame, path: str, *, sequence: bool = False, overwrite: bool = False, **options) -> None:
    """A folder of newline-delimited features (sequence), or one local file with a feature collection, of parts that tasks write."""
    rows = geojson_features(df, **options)
    if sequence:
        with _beside(path, overwrite) as staged:
            rows.write.text(staged)
        return

    def encode(batches: Iterator[pa.RecordBatch], new: Callable[[], str]) -> Iterator[tuple]:
        held: list[bytes] = []
        for batch in batches:
            held += [b"\n" + v.encode() for v in batch.column(0).to_pylist()]
            if sum(map(len, held)) >= parts.PART:
                parts.put(at := new(), b",".join(held))
                yield (at,)
                held = []
        if held:
            parts.put(at := new(), b",".join(held))
            yield (at,)

    with _beside(path, overwrite) as staged, parts.written(rows, "path string", encode) as found, open(staged, "wb") as f:
        f.write(b'{"type":"FeatureCollection","features":[')
        for i, (part,) in enumerate(found):
            f.write(b"," if i else b"")
            f.writelines(parts.pieces(part))
        f.write(b"\n]}\n")


def write_geopackage(df: DataFrame, path: str, *, layer: str = "features", srs_id: int = 4326, overwrite: bool = False) -> None:
    """One local file, put together from databases that tasks fill; structs, lists and maps are left out."""
    with _beside(path, overwrite) as staged:
        _fill_geopackage(df, staged, layer, srs_id)


def _fill_geopackage(df: DataFrame, path: str, layer: str, srs_id: int) -> None:
    import os
    import sqlite3
    import struct as st
    import tempfile

    geom = geometry_column(df)
    plain = [f for f in df.schema.fields if f.name != geom and f.dataType.typeName() not in ("struct", "array", "map")]
    kinds = {"long": "INTEGER", "integer": "MEDIUMINT", "short": "SMALLINT", "byte": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "binary": "BLOB", "date": "DATE"}
    db = sqlite3.connect(path)
    q = lambda s: '"' + s.replace('"', '""') + '"'
    db.executescript(
        f"""PRAGMA application_id = 1196444487; PRAGMA user_version = 10300;
        CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
        INSERT INTO gpkg_spatial_ref_sys VALUES ('Undefined cartesian', -1, 'NONE', -1, 'undefined', NULL), ('Undefined geographic', 0, 'NONE', 0, 'undefined', NULL), ('EPSG:{srs_id}', {srs_id}, 'EPSG', {srs_id}, 'undefined', NULL);
        CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
        CREATE TABLE {q(layer)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, {q(geom)} GEOMETRY{''.join(f', {q(f.name)} {kinds.get(f.dataType.typeName(), "TEXT")}' for f in plain)});"""
    )
    db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srs_id))
    db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', ?, 2, 2)", (layer, geom, srs_id))
    head = b"GP\x00\x01" + st.pack("<i", srs_id)
    names = [geom, *[f.name for f in plain]]
    as_text = {f.name for f in plain if f.dataType.typeName() not in kinds and f.dataType.typeName() != "string" or f.dataType.typeName() == "date"}
    rows = df.select(*[F.col(f"`{n}`").cast("string").alias(n) if n in as_text else F.col(f"`{n}`") for n in names])
    columns = ", ".join(f"c{i}" for i in range(len(names)))

    def encode(batches: Iterator[pa.RecordBatch], new: Callable[[], str]) -> Iterator[tuple]:
        """Databases of a table t each, filled in the task's own folder and then passed on."""
        batches = iter(batches)
        while (batch := next(batches, None)) is not None:
            with tempfile.TemporaryDirectory() as own:
                part, size = sqlite3.connect(f"{own}/t"), 0
                part.execute(f"CREATE TABLE t ({columns})")
                while batch is not None:
                    values = [c.to_pylist() for c in batch.columns]
                    values[0] = [None if v is None else head + v for v in values[0]]
                    part.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(names))})", zip(*values))
                    size += batch.nbytes
                    batch = next(batches, None) if size < parts.PART else None
                part.commit()
                part.close()
                with open(f"{own}/t", "rb") as f:
                    parts.put(at := new(), f.read())
            yield (at,)

    with parts.written(rows, "path string", encode) as found, tempfile.TemporaryDirectory() as own:
        for at, in found:
            with open(f"{own}/t", "wb") as f:
                f.writelines(parts.pieces(at))
            db.commit()
            db.execute("ATTACH ? AS part", (f"{own}/t",))
            db.execute(f"INSERT INTO {q(layer)} ({', '.join(map(q, names))}) SELECT {columns} FROM part.t ORDER BY rowid")
            db.commit()
            db.execute("DETACH part")
            os.remove(f"{own}/t")
    db.commit()
    db.close()
