"""Queries that write and read again, check, repair and stream, with the SQL that tells what must come back."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import GeoFrame
from ..functions import expr, udf
from ..operators import aggregate, columns, join
from ..sources import readers, sinks
from ..sources.parts import scratch
from ..streaming import adapter
from . import checks, fixes, inspect, metadata
from .queries import JOIN, L_SHAPE, POINTS, RECTANGLES, WHOLE, _kdtree_sql, _quadkey_sql, flat, nations, points, query, table


def local(path: str) -> str:
    """A path for formats of one local file."""
    return re.sub("^file:/+", "/", path)


def _xy(df: DataFrame, *keep: str) -> DataFrame:
    c = udf.centroid(F.col("geometry"))
    return df.select(*keep, c.alias("c")).select(*keep, F.col("c.x").alias("lon"), F.col("c.y").alias("lat"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf, geometry=True).select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "geometry", "bbox")


PLACES = f"WITH {POINTS} SELECT c_custkey, lon, lat FROM points"


@query(PLACES)
def parquet_round_trip(spark, sf):
    path = scratch(spark, "parquet")
    GeoFrame(features(spark, sf)).write(path)
    return _xy(readers.read_parquet(spark, path), "c_custkey")


@query(PLACES)
def native_types_round_trip(spark, sf):
    path = scratch(spark, "native")
    sinks.write_parquet(features(spark, sf), path, version="2.0")
    return _xy(readers.read_parquet(spark, path), "c_custkey")


@query(PLACES)
def csv_text_round_trip(spark, sf):
    path = scratch(spark, "csv")
    sinks.write_csv(features(spark, sf), path, include_bbox=False)
    return _xy(readers.read_csv(spark, path), "c_custkey")


@query(PLACES)
def csv_coordinates(spark, sf):
    path = scratch(spark, "csv")
    points(spark, sf, bbox=False).select("c_custkey", "lon", "lat").write.option("header", True).csv(path)
    return _xy(readers.read_csv(spark, path).drop("lon", "lat"), "c_custkey")


@query(f"WITH {POINTS} SELECT c_custkey, c_name, lon, lat FROM points")
def geojson_collection_round_trip(spark, sf):
    path = local(scratch(spark, "collection")) + ".geojson"
    sinks.write_geojson(features(spark, sf), path)
    return _xy(readers.read_geojson(spark, path), "c_custkey", "c_name")


@query(f"WITH {POINTS} SELECT c_custkey, c_name, lon, lat FROM points")
def geojson_lines_round_trip(spark, sf):
    path = scratch(spark, "lines") + ".geojsonl"
    sinks.write_geojson(features(spark, sf), path, sequence=True)
    return _xy(readers.read_geojson(spark, path), "c_custkey", "c_name")


@query(f"WITH {POINTS} SELECT c_custkey, c_name, lon, lat FROM points")
def geopackage_round_trip(spark, sf):
    path = local(scratch(spark, "package")) + ".gpkg"
    sinks.write_geopackage(features(spark, sf).drop("bbox"), path)
    return _xy(readers.read_geopackage(spark, path), "c_custkey", "c_name")


@query(f"WITH {POINTS} SELECT c_custkey, c_name, lon, lat FROM points")
def shapefile_round_trip(spark, sf):
    from ..sources import shapefile

    path = local(scratch(spark, "shapes")) + ".shp"
    shapefile.write_shapefile(features(spark, sf).select("c_custkey", "c_name", "geometry"), path)
    return _xy(readers.convert(spark, path), "c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def hive_round_trip(spark, sf):
    path = scratch(spark, "hive")
    GeoFrame(features(spark, sf)).partition_by_string(path, "c_mktsegment", force=True, keep_column=False)
    return readers.read_parquet(spark, path, hive=True).select("c_custkey", "c_mktsegment")


def _files(df: DataFrame) -> DataFrame:
    """Rows by the stem of the file that they lie in."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(-\d+)?\.parquet$", 1)
    return df.groupBy(name.alias("file")).agg(F.count("*").alias("n"))


@query("SELECT left(c_mktsegment, 1) AS file, count(*) AS n FROM customer GROUP BY 1")
def partition_by_prefix(spark, sf):
    path = scratch(spark, "prefix")
    GeoFrame(features(spark, sf)).partition_by_string(path, "c_mktsegment", chars=1, hive=False, force=True)
    return _files(readers.read_parquet(spark, path))


@query(f"SELECT left(quadkey, 2) AS file, count(*) AS n FROM ({_quadkey_sql(13)}) GROUP BY 1")
def partition_by_quadkey(spark, sf):
    path = scratch(spark, "quadkey")
    GeoFrame(features(spark, sf)).partition_by_quadkey(path, partition_resolution=2, hive=False, force=True)
    return _files(readers.read_parquet(spark, path))


@query(f"SELECT kdtree_cell AS file, count(*) AS n FROM ({_kdtree_sql(4)}) GROUP BY 1")
def partition_by_kdtree(spark, sf):
    path = scratch(spark, "kdtree")
    cells = columns.add_kdtree(features(spark, sf), iterations=4, sample_size=None)
    sinks.partition_by(cells, path, "kdtree_cell", hive=True, force=True)
    return _files(readers.read_parquet(spark, path))


@query(f"WITH {WHOLE}, {RECTANGLES} SELECT r_name, n_name, count(*) AS n FROM points JOIN rects ON lon BETWEEN xmin AND xmin + 72 AND lat BETWEEN ymin AND ymin + 34 JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def partition_by_admin_levels(spark, sf):
    path = scratch(spark, "admin")
    n = nations(spark, sf).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    met = join.spatial_left_join(points(spark, sf, whole=True, geometry=True), n, {"r": "r_name", "n": "n_name"})
    sinks.partition_by_levels(met, path, {"r_name": "r", "n_name": "n"}, keep=["c_custkey", "geometry", "bbox"])
    return readers.read_parquet(spark, path, hive=True).groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS} SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax, 'Point' AS kinds, count(*) AS n FROM points")
def metadata_of_written_files(spark, sf):
    """Bounds, types and rows of all files, from their footers alone."""
    path = scratch(spark, "meta")
    GeoFrame(features(spark, sf)).write(path)
    s = [inspect.summary(p) for p, _ in readers.files_of(spark, path)]
    s = [x for x in s if x["rows"]]
    boxes = list(zip(*(x["bounds"] for x in s)))
    kinds = ",".join(sorted({k for x in s for k in x["geometry_types"]}))
    return spark.createDataFrame([(min(boxes[0]), min(boxes[1]), max(boxes[2]), max(boxes[3]), kinds, sum(x["rows"] for x in s))], "xmin double, ymin double, xmax double, ymax double, kinds string, n long")


@query(f"WITH {POINTS} SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM points")
def row_group_bounds(spark, sf):
    """Bounds from the statistics of the envelope column's row groups."""
    path = scratch(spark, "groups")
    sinks.write_parquet(features(spark, sf), path, row_group_rows=200)
    g = [x for p, _ in readers.files_of(spark, path) for x in metadata.row_group_bounds(p)]
    return spark.createDataFrame([(min(x["xmin"] for x in g), min(x["ymin"] for x in g), max(x["xmax"] for x in g), max(x["ymax"] for x in g))], "xmin double, ymin double, xmax double, ymax double")


@query(f"WITH {POINTS} SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM points")
def native_row_group_bounds(spark, sf):
    """Bounds from the statistics of native geometry types."""
    from ..functions import native

    path = scratch(spark, "groups")
    sinks.write_parquet(features(spark, sf), path, geo_only=True, row_group_rows=200)
    g = [x for p, _ in readers.files_of(spark, path) for x in native.bounds(metadata.open_footer(p), "geometry")]
    return spark.createDataFrame([(min(x["xmin"] for x in g), min(x["ymin"] for x in g), max(x["xmax"] for x in g), max(x["ymax"] for x in g))], "xmin double, ymin double, xmax double, ymax double")


def _results(spark: SparkSession, found: list[checks.CheckResult]) -> DataFrame:
    return spark.createDataFrame([(c.name, c.passed) for c in found], "name string, passed boolean")


@query("SELECT * FROM (VALUES ('row groups', true), ('compression', false), ('envelope', false)) t(name, passed)")
def check_all(spark, sf):
    """Of files with the wrong codec and without an envelope column."""
    path = scratch(spark, "check")
    sinks.write_parquet(features(spark, sf).drop("bbox"), path, codec="SNAPPY")
    return _results(spark, checks.check_path(spark, path))


@query("SELECT * FROM (VALUES ('row groups', true), ('compression', true), ('envelope', true)) t(name, passed)")
def fix_in_place(spark, sf):
    path = scratch(spark, "fix")
    sinks.write_parquet(features(spark, sf).drop("bbox"), path, codec="SNAPPY")
    return _results(spark, fixes.fix_file(spark, path)[1])


@query(f"WITH {POINTS} SELECT c_custkey, lon AS xmin, lat AS ymin, lon AS xmax, lat AS ymax FROM points")
def fixed_rows(spark, sf):
    """The rows after a repair to another path, with the envelope column that they lacked."""
    path, to = scratch(spark, "fix"), scratch(spark, "fixed")
    sinks.write_parquet(features(spark, sf).drop("bbox"), path, codec="SNAPPY")
    fixes.fix_file(spark, path, to)
    return flat(readers.read_parquet(spark, to), "c_custkey")


@query("SELECT * FROM (VALUES ('well-formed', true), ('geometry types', true), ('bounds', false), ('coordinates are degrees', true)) t(name, passed)")
def validate_data(spark, sf):
    """Geometries against metadata that tell smaller bounds."""
    info = {"geo": metadata.build("geometry", bbox=(-10, -10, 10, 10), geometry_types=["Point"])}
    return spark.createDataFrame([(n, bool(kept)) for n, kept, _ in checks.validate_data(features(spark, sf), info)], "name string, passed boolean")


@query(f"WITH {POINTS} SELECT c_custkey FROM points WHERE lon BETWEEN -100 AND 80 AND lat BETWEEN -40 AND 60 AND (lon <= 0 OR lat <= 10)")
def geometry_filter_geojson(spark, sf):
    text = udf.as_geojson(udf.from_text(F.lit(L_SHAPE)))
    shape = spark.range(1).select(text.alias("t")).first()["t"]
    return GeoFrame(features(spark, sf)).extract(geometry=shape).df.select("c_custkey")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5")
def preview_rows(spark, sf):
    return inspect.preview(features(spark, sf).orderBy("c_custkey"), 5).select("c_custkey")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, count(DISTINCT {c}) AS n_unique FROM orders" for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")))
def stats_of_orders(spark, sf):
    return aggregate.stats(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), exact=True)


@query(f"WITH {POINTS} SELECT c_custkey, quadkey, lon AS xmin, lat AS ymin, lon AS xmax, lat AS ymax FROM points JOIN ({_quadkey_sql(9)}) USING (c_custkey)")
def stream_rows(spark, sf):
    """Row-local operators on a stream of files, to its end."""
    source, to = scratch(spark, "source"), scratch(spark, "stream")
    points(spark, sf, bbox=False).select("c_custkey", "lon", "lat").repartition(3).write.parquet(source)
    s = spark.readStream.schema("c_custkey long, lon double, lat double").parquet(source)
    out = adapter.row_local(s, columns.add_bbox, lambda d: columns.add_quadkey(d, resolution=9))
    out.writeStream.format("parquet").option("path", to).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return flat(spark.read.parquet(to), "c_custkey", "quadkey")


@query(f"WITH {POINTS} SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n, min(user_id % 360 - 180.0)::DOUBLE AS xmin, max(user_id % 360 - 180.0)::DOUBLE AS xmax FROM events GROUP BY 1")
def stream_windows(spark, sf):
    """Bounds of a stream by day, all windows closed or open."""
    name = f"windows_{uuid.uuid4().hex[:8]}"
    source = scratch(spark, "source")
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 360 - 180.0).alias("lon"), F.lit(0.0).alias("lat"))
    e.write.parquet(source)
    s = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = adapter.windowed_bounds(s, "ts", "1 day", "400 days")
    out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "xmin", "xmax")


@query("SELECT c_custkey, 'EPSG:3857' AS crs FROM customer")
def reference_system_of_written_files(spark, sf):
    """A system other than the usual one comes back from the file."""
    path = scratch(spark, "crs")
    GeoFrame(features(spark, sf)).reproject("EPSG:3857").write(path)
    again = GeoFrame.read(spark, path)
    return again.df.select("c_custkey", F.lit(metadata.crs_code(again.crs)).alias("crs"))


@query(f"WITH {POINTS} SELECT c_custkey, lon, lat FROM points")
def arrow_stream_round_trip(spark, sf):
    path = local(scratch(spark, "pipe"))
    with open(path, "wb") as pipe:
        GeoFrame(features(spark, sf)).write_ipc(pipe)
    with open(path, "rb") as pipe:
        return _xy(GeoFrame.read_ipc(spark, pipe).df, "c_custkey")


@query(f"WITH {POINTS}, c AS (SELECT c_custkey, lon, lat FROM points WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -60 AND 60) SELECT c_custkey, round(6378137.0 * radians(lon), 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y, quadkey FROM c JOIN (SELECT c_custkey, left(quadkey, 2) AS quadkey FROM ({_quadkey_sql(13)})) USING (c_custkey)")
def chain_filter_reproject_partition(spark, sf):
    path = scratch(spark, "chain")
    f = GeoFrame(features(spark, sf)).extract(bbox=(-90, -60, 90, 60)).add_quadkey().reproject("EPSG:3857")
    sinks.partition_by(f.df, path, "quadkey", prefix=2, hive=True, force=True)
    out = _xy(readers.read_parquet(spark, path, hive=True), "c_custkey", "quadkey_prefix")
    return out.select("c_custkey", F.round("lon", 4).alias("x"), F.round("lat", 4).alias("y"), F.lpad(F.col("quadkey_prefix").cast("string"), 2, "0").alias("quadkey"))


@query(f"SELECT * FROM ({JOIN}) UNION ALL SELECT * FROM ({JOIN})")
def spatial_join_of_repeated_rows(spark, sf):
    """Repeated rows are matched each; a table read twice is no obstacle."""
    p = points(spark, sf, whole=True)
    return join.spatial_left_join(p.union(p), nations(spark, sf), {"admin_name": "n_name"}).select("c_custkey", "admin_name")


@query("SELECT n_nationkey, (n_nationkey % 5 * 72 - 144.0)::DOUBLE AS x, (n_nationkey // 5 * 34 - 68.0)::DOUBLE AS y, 'POLYGON' AS kind FROM nation")
def centroid_of_rectangles(spark, sf):
    n = nations(spark, sf).select("n_nationkey", udf.box(*[F.col(f"bbox.{c}") for c in expr.BBOX_FIELDS]).alias("g"))
    return n.select("n_nationkey", udf.centroid(F.col("g")).alias("c"), udf.geometry_type(F.col("g")).alias("kind")).select("n_nationkey", F.col("c.x").alias("x"), F.col("c.y").alias("y"), "kind")
