"""Readers: Parquet files and trees, CSV with geometries, GeoJSON, GeoPackage."""

from __future__ import annotations

import json
import os
import re
import sqlite3
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import native, udf
from ..plans.metadata import open_footer
from . import geojson, parts

#: Column names that hold geometries or coordinates (fixed values, in order of preference).
WKT_NAMES = ("wkt", "geometry", "geom", "the_geom", "shape")
#: Rows of a GeoPackage that a task reads.
GPKG_ROWS = 100_000
LAT_NAMES, LON_NAMES = ("lat", "latitude", "y"), ("lon", "lng", "long", "longitude", "x")


def is_tree(path: str) -> bool:
    return any(c in path for c in "*?[") or os.path.isdir(path) or bool(re.search(r"/[^/=]+=[^/]+(/|$)", path))


def read_parquet(spark: SparkSession, path: str, *, allow_schema_diff: bool = False, hive: bool | None = None) -> DataFrame:
    """One file, a folder, a glob or a Hive tree. With allow_schema_diff columns are united by name."""
    reader = spark.read.option("mergeSchema", str(allow_schema_diff).lower())
    if os.path.isdir(path) and not hive:
        has_keys = any("=" in d for d in os.listdir(path))
        if hive is False or not has_keys:
            reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    try:
        return reader.parquet(path)
    except Exception as e:
        if "PARQUET_TYPE_ILLEGAL" not in str(e) or "GEO" not in str(e):
            raise
    # native geometries: Spark reads them as bytes if it is told so
    with open_footer(first_file(spark, path)) as f:
        fields = [pa.field(x.name, x.type.storage_type if isinstance(x.type, pa.BaseExtensionType) else x.type) for x in f.schema_arrow]
    return reader.schema(from_arrow_schema(pa.schema(fields))).parquet(path)


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the Parquet files of a file, folder, glob or tree, in order, as Spark lists them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length").collect()
    return sorted((re.sub("^file:/+", "/", r["path"]), r["length"]) for r in found)


def first_file(spark: SparkSession, path: str) -> str:
    files = files_of(spark, path)
    if not files:
        raise FileNotFoundError(f"no Parquet file in {path}")
    return files[0][0]


def single_file(path: str, verb: str) -> str:
    """The path, if it is that of one file."""
    if is_tree(path):
        raise ValueError(f"{verb} works on one file, not on {path}; extract it into one first")
    return path


def crs_of(spark: SparkSession, path: str):
    """The reference system that a file of any of the formats names; None where it names none."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".shp":
        prj = path[:-4] + ".prj"
        if not os.path.exists(prj):
            return None
        with open(prj) as f:
            text = f.read()
        code = re.findall(r'AUTHORITY\["(\w+)", ?"?(\w+)"?\]', text) or re.findall(r'ID\["(\w+)", ?"?(\w+)"?\]', text)
        zone = re.search(r"UTM_Zone_(\d+)([NS])", text)
        if code:
            return ":".join(code[-1])
        if zone:
            return f"EPSG:32{'6' if zone[2] == 'N' else '7'}{int(zone[1]):02d}"
        return "EPSG:3857" if "Mercator_Auxiliary_Sphere" in text else "EPSG:4326" if text.startswith("GEOGCS") and "WGS" in text else None
    if kind == ".gpkg":
        db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            found = db.execute("SELECT organization, organization_coordsys_id FROM gpkg_geometry_columns JOIN gpkg_spatial_ref_sys USING (srs_id) ORDER BY table_name").fetchone()
        finally:
            db.close()
        return f"{found[0]}:{found[1]}".upper() if found and found[0] != "NONE" else None
    if kind in (".geojson", ".json"):
        with geojson._open(files_any(spark, path)) as f:
            m = re.search(rb'"crs"\s*:\s*\{[^{}]*\{[^{}]*"name"\s*:\s*"([^"]+)"', f.read(1 << 16))
        return m[1].decode() if m else None
    if kind not in (".parquet", ""):
        return None
    with open_footer(first_file(spark, path)) as f:
        geo = json.loads((f.metadata.metadata or {}).get(b"geo", b"{}"))
        column = geo.get("columns", {}).get(geo.get("primary_column"), {})
        return column.get("crs") or next((c["crs"] for c in native.columns(f).values() if c["crs"]), None)


def files_any(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").load(path).select("path").orderBy("path").first()["path"]


def sniff_delimiter(line: str) -> str:
    return max(",\t;|", key=lambda d: (line.count(d), -",\t;|".index(d)))


def read_csv(spark: SparkSession, path: str, *, delimiter: str | None = None, wkt_column: str | None = None, lat_column: str | None = None, lon_column: str | None = None, skip_invalid: bool = False) -> DataFrame:
    """Rows with a `geometry` from text or from coordinates; rows without one are left out.

    Coordinates out of range are an error, text that isn't a geometry as well unless skip_invalid.
    """
    if delimiter is None:
        first = spark.read.text(path).limit(1).collect()
        delimiter = sniff_delimiter(first[0][0] if first else "")
    df = spark.read.option("header", True).option("inferSchema", True).option("escape", '"').option("multiLine", True).csv(path, sep=delimiter)
    lower = {c.lower(): c for c in df.columns}
    text = wkt_column or (None if lat_column or lon_column else next((lower[n] for n in WKT_NAMES if n in lower and dict(df.dtypes)[lower[n]] == "string"), None))
    if text:
        if text not in df.columns:
            raise ValueError(f"no column {text}; there are {', '.join(df.columns)}")
        out = df.withColumn("_g", udf.from_text(F.col(f"`{text}`")))
        if not skip_invalid:
            bad = out.where(F.col("_g").isNull() & F.col(f"`{text}`").isNotNull()).limit(1).count()
            if bad:
                raise ValueError(f"{text} holds text that isn't a geometry; skip_invalid leaves it out")
        out = out.drop(text).withColumnRenamed("_g", "geometry").where("geometry is not null")
        e = udf.envelope(F.col("geometry"))
        far = out.limit(1000).select(e.alias("e")).agg(F.max(F.greatest(F.abs("e.xmin"), F.abs("e.xmax"))).alias("x"), F.max(F.greatest(F.abs("e.ymin"), F.abs("e.ymax"))).alias("y")).first()
        if (far["x"] or 0) > 180 or (far["y"] or 0) > 90:
            warnings.warn(f"coordinates reach {far['x']:.2f}, {far['y']:.2f}: the geometries may be in a projected system", stacklevel=2)
        return out
    lat = lat_column or next((lower[n] for n in LAT_NAMES if n in lower), None)
    lon = lon_column or next((lower[n] for n in LON_NAMES if n in lower), None)
    if not lat or not lon:
        raise ValueError(f"no geometry, and no latitude and longitude, among {', '.join(df.columns)}")
    y, x = F.col(f"`{lat}`").try_cast("double"), F.col(f"`{lon}`").try_cast("double")
    off = df.agg(F.count_if((y < -90) | (y > 90)).alias("lat"), F.count_if((x < -180) | (x > 180)).alias("lon")).first()
    if off["lat"] or off["lon"]:
        raise ValueError(f"{off['lat']} latitudes and {off['lon']} longitudes are out of range")
    return df.withColumn("geometry", udf.point(x, y)).where("geometry is not null")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a collection, or of one feature a line: properties as columns, id if any, geometry."""
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).collect()
    head = b""
    if files:
        with geojson._open(files[0]["path"]) as f:
            head = f.read(1 << 16)
    if geojson.is_lines(path, head):
        value = F.regexp_replace("value", "^\\x1e", "")
        features = spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json(value).alias("f"))
        parts = features.select(F.to_json(F.try_variant_get("f", "$.geometry", "variant")).alias("g"), F.to_json(F.try_variant_get("f", "$.properties", "variant")).alias("p"), F.try_variant_get("f", "$.id", "string").alias("id"))
    else:
        parts = geojson.read_features(spark, path)
    schema = spark.read.json(parts.where("p is not null and p <> 'null'").select("p").rdd.map(lambda r: r[0])).schema
    out = parts.withColumn("props", F.from_json("p", schema)).withColumn("geometry", udf.from_geojson(F.col("g")))
    names = [F.col(f"props.`{f.name}`") for f in schema.fields]
    return out.select(*([F.col("id")] if "id" not in schema.names else []), *names, "geometry")


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """One layer of a local GeoPackage, read by tasks in ranges of row ids; the driver sees their bounds and each column's first value."""
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        layers = db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns ORDER BY table_name").fetchall()
        table, geom = next((x for x in layers if layer in (None, x[0])), (None, None))
        if table is None:
            raise ValueError(f"no layer {layer}; there are {', '.join(x[0] for x in layers)}")
        own = [d[0] for d in db.execute(f"SELECT * FROM {quoted(table)} LIMIT 0").description]
        names = ["geometry" if c == geom else c for c in own]
        at = names.index("geometry")
        kinds = {int: "long", float: "double", bytes: "binary"}
        first = [db.execute(f"SELECT {quoted(c)} FROM {quoted(table)} WHERE {quoted(c)} IS NOT NULL LIMIT 1").fetchone() for c in own]
        types = ["binary" if i == at else kinds.get(type(v[0]), "string") if v else "string" for i, v in enumerate(first)]
        is_table = db.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ? COLLATE NOCASE", (table,)).fetchone()
        starts = [r[0] for r in db.execute(f"SELECT id FROM (SELECT rowid AS id, row_number() OVER (ORDER BY rowid) AS n FROM {quoted(table)}) WHERE n % {GPKG_ROWS} = 1 OR {GPKG_ROWS} = 1 ORDER BY id")] if is_table else []
    finally:
        db.close()
    # a view has no row ids: it is one range
    ranges = [(f" WHERE rowid >= {a}" + (f" AND rowid < {b}" if b is not None else "") + " ORDER BY rowid") for a, b in zip(starts, [*starts[1:], None])] if is_table else [""]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types))
    arrow = pa.schema([pa.field(n, {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in zip(names, types)])

    def whole(source: str, to: str) -> None:
        a, b = sqlite3.connect(f"file:{source}?mode=ro", uri=True), sqlite3.connect(to)
        a.backup(b)
        a.close()
        b.close()

    (seen,) = parts.visible(spark, [path], whole)

    def read(which: str):
        db = sqlite3.connect(f"file:{seen}?mode=ro", uri=True)
        cursor = db.execute(f"SELECT * FROM {quoted(table)}{which}")
        while rows := cursor.fetchmany(10_000):
            columns = [list(c) for c in zip(*rows)]
            columns[at] = [None if v is None else strip_gpkg_header(v) for v in columns[at]]
            columns = [[v if v is None or isinstance(v, str) else str(v) for v in c] if t == "string" else c for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        db.close()

    return parts.over(spark, ranges, schema, read)


def strip_gpkg_header(blob: bytes) -> bytes:
    """The WKB within a GeoPackage geometry."""
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    return bytes(blob[8 + envelope :])


def convert(spark: SparkSession, path: str, **options) -> DataFrame:
    """Any of the formats, by extension."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in (".csv", ".tsv", ".txt"):
        return read_csv(spark, path, **options)
    if kind in (".geojson", ".json", ".geojsonl", ".geojsons"):
        return read_geojson(spark, path)
    if kind == ".gpkg":
        return read_geopackage(spark, path, **options)
    if kind == ".shp":
        from .shapefile import read_shapefile

        return read_shapefile(spark, path, **options)
    if kind in (".parquet", ""):
        return read_parquet(spark, path, **options)
    raise ValueError(f"no reader for {kind}")
