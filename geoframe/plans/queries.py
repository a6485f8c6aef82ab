"""Queries over the given tables, with coordinates derived by arithmetic, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, udf
from ..operators import aggregate, columns, extract, join, sort

X, Y = "CAST(({k} * 7919) % 36000 AS DOUBLE) / 100 - 180", "CAST(({k} * 104729) % 17000 AS DOUBLE) / 100 - 85"
XI, YI = "CAST(({k} * 7919) % 360 AS DOUBLE) - 180", "CAST(({k} * 104729) % 170 AS DOUBLE) - 85"
L_SHAPE = "POLYGON ((-100 -40, 80 -40, 80 10, 0 10, 0 60, -100 60, -100 -40))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, *, geometry: bool = False, whole: bool = False, bbox: bool = True) -> DataFrame:
    """Customers at derived places: lon, lat, an envelope and, if asked for, a geometry."""
    x, y = ((XI, YI) if whole else (X, Y))
    df = table(spark, sf_dir, "customer").withColumn("lon", F.expr(x.format(k="c_custkey"))).withColumn("lat", F.expr(y.format(k="c_custkey")))
    if geometry:
        df = df.withColumn("geometry", udf.point(F.col("lon"), F.col("lat")))
    return columns.add_bbox(df) if bbox else df


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the rectangles of a 5 by 5 grid."""
    x0, y0 = F.col("n_nationkey") % 5 * 72 - 180.0, F.floor(F.col("n_nationkey") / 5) * 34 - 85.0
    return table(spark, sf_dir, "nation").withColumn("bbox", expr.bbox_struct(x0, y0, x0 + 72, y0 + 34))


def flat(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(f"bbox.{n}").alias(n) for n in expr.BBOX_FIELDS])


POINTS = f"""points AS (SELECT *, {X.format(k='c_custkey')} AS lon, {Y.format(k='c_custkey')} AS lat FROM customer)"""
WHOLE = f"""points AS (SELECT *, {XI.format(k='c_custkey')} AS lon, {YI.format(k='c_custkey')} AS lat FROM customer)"""
RECTANGLES = """rects AS (SELECT *, n_nationkey % 5 * 72 - 180.0::DOUBLE AS xmin, n_nationkey // 5 * 34 - 85.0::DOUBLE AS ymin FROM nation)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(f"WITH {POINTS} SELECT c_custkey, c_name, lon, lat FROM points WHERE lon BETWEEN -30 AND 60 AND lat BETWEEN -20 AND 45")
def extract_bbox(spark, sf):
    return extract.extract(points(spark, sf), columns=["c_custkey", "c_name", "lon", "lat"], exclude_columns=["bbox"], bbox=(-30, -20, 60, 45))


@query(f"WITH {POINTS} SELECT c_custkey, lon, lat FROM points WHERE lon BETWEEN -30 AND 60 AND lat BETWEEN -20 AND 45")
def extract_bbox_exact(spark, sf):
    return extract.extract(points(spark, sf, geometry=True, bbox=False), bbox="-30,-20,60,45").select("c_custkey", "lon", "lat")


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000 AND c_mktsegment LIKE 'B%'")
def extract_where(spark, sf):
    return extract.extract(table(spark, sf, "customer"), columns=["c_custkey", "c_acctbal", "c_mktsegment"], where="c_acctbal > 5000 AND c_mktsegment LIKE 'B%'")


@query(f"WITH {POINTS} SELECT c_custkey, lon, lat, lon AS xmin, lat AS ymin, lon AS xmax, lat AS ymax FROM points WHERE lon >= 0 AND lat >= 0 AND c_nationkey < 10")
def extract_combined(spark, sf):
    return flat(extract.extract(points(spark, sf), columns=["c_custkey", "lon", "lat"], bbox=(0, 0, 180, 90), where="c_custkey IS NOT NULL AND c_nationkey < 10"), "c_custkey", "lon", "lat")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25")
def extract_limit(spark, sf):
    return extract.extract(sort.sort_column(table(spark, sf, "customer"), "c_custkey"), columns=["c_custkey", "c_name"], limit=25)


@query("SELECT c_custkey, c_name FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 10)")
def tail_rows(spark, sf):
    return extract.tail(table(spark, sf, "customer").select("c_custkey", "c_name"), 10, order=["c_custkey"])


@query(f"WITH {POINTS} SELECT c_custkey FROM points WHERE lon BETWEEN -100 AND 80 AND lat BETWEEN -40 AND 60 AND (lon <= 0 OR lat <= 10)")
def geometry_filter_polygon(spark, sf):
    return extract.extract(points(spark, sf, geometry=True), geometry=L_SHAPE).select("c_custkey")


@query(f"WITH {POINTS} SELECT c_custkey, lon AS xmin, lat AS ymin, lon AS xmax, lat AS ymax FROM points")
def add_bbox_point(spark, sf):
    return flat(columns.add_bbox(points(spark, sf, geometry=True, bbox=False)), "c_custkey")


@query(f"WITH {RECTANGLES} SELECT n_nationkey, xmin, ymin, xmin + 72 AS xmax, ymin + 34 AS ymax FROM rects")
def add_bbox_rectangle(spark, sf):
    n = nations(spark, sf)
    boxes = n.select("n_nationkey", udf.box(*[F.col(f"bbox.{c}") for c in expr.BBOX_FIELDS]).alias("geometry"))
    return flat(columns.add_bbox(boxes), "n_nationkey")


@query(f"WITH {POINTS} SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM points")
def bounds(spark, sf):
    return aggregate.bounds(points(spark, sf))


@query("SELECT 'POINT' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'POLYGON', count(*) FROM nation")
def geometry_types(spark, sf):
    n = nations(spark, sf).select(udf.box(*[F.col(f"bbox.{c}") for c in expr.BBOX_FIELDS]).alias("geometry"))
    g = points(spark, sf, geometry=True).select("geometry").union(n)
    return g.groupBy(udf.geometry_type(F.col("geometry")).alias("kind")).agg(F.count("*").alias("n"))


STATS = ("c_custkey", "c_nationkey", "c_mktsegment")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, count(DISTINCT {c}) AS n_unique FROM customer" for c in STATS))
def stats(spark, sf):
    return aggregate.stats(table(spark, sf, "customer").select(*STATS), exact=True)


def _quadkey_sql(zoom: int) -> str:
    n = 1 << zoom
    return f"""WITH {POINTS}, f AS (
  SELECT c_custkey, lon / 360.0 + 0.5 AS fx, 0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi() AS fy FROM points
), t AS (
  SELECT c_custkey, CASE WHEN fx <= 0 THEN 0 WHEN fx >= 1 THEN {n - 1} ELSE floor((fx + 1e-14) * {n}) END::INT AS x,
         CASE WHEN fy <= 0 THEN 0 WHEN fy >= 1 THEN {n - 1} ELSE floor((fy + 1e-14) * {n}) END::INT AS y FROM f
)
SELECT c_custkey, (SELECT string_agg(((x >> (i - 1)) & 1) + 2 * ((y >> (i - 1)) & 1), '' ORDER BY i DESC) FROM range(1, {zoom + 1}) r(i)) AS quadkey FROM t"""


@query(_quadkey_sql(5))
def quadkey_z5(spark, sf):
    return columns.add_quadkey(points(spark, sf), resolution=5).select("c_custkey", "quadkey")


@query(_quadkey_sql(13))
def quadkey_z13(spark, sf):
    return columns.add_quadkey(points(spark, sf)).select("c_custkey", "quadkey")


@query(f"SELECT q AS value, count(*) AS n_rows FROM (SELECT left(quadkey, 3) AS q FROM ({_quadkey_sql(13)})) GROUP BY q")
def quadkey_prefix(spark, sf):
    return aggregate.partition_preview(columns.add_quadkey(points(spark, sf)), "quadkey", 3, limit=None)


def _hilbert_sql(bits: int = expr.HILBERT_BITS) -> str:
    top = (1 << bits) - 1
    sql = f"""WITH {POINTS}, b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM points),
r0 AS (SELECT c_custkey, floor((lon - x0) / (x1 - x0) * {top})::BIGINT AS x, floor((lat - y0) / (y1 - y0) * {top})::BIGINT AS y, 0::BIGINT AS d FROM points, b)"""
    for i in range(bits):
        s = 1 << (bits - 1 - i)
        # the usual quadrant rotation, on the remaining low bits
        sql += f""",
q{i} AS (SELECT c_custkey, x % {2 * s} AS x, y % {2 * s} AS y, d, (x % {2 * s} >= {s})::BIGINT AS rx, (y % {2 * s} >= {s})::BIGINT AS ry FROM r{i}),
r{i + 1} AS (SELECT c_custkey, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN {2 * s - 1} - y ELSE y END AS x,
  CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN {2 * s - 1} - x ELSE x END AS y, d + {s} * {s}::BIGINT * xor(3 * rx, ry) AS d FROM q{i})"""
    return sql + f" SELECT c_custkey, d AS hilbert FROM r{bits}"


@query(_hilbert_sql())
def hilbert_index(spark, sf):
    p = points(spark, sf)
    return sort.add_hilbert(p).select("c_custkey", "hilbert")


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY hilbert, c_custkey) AS place FROM ({_hilbert_sql()})")
def sort_hilbert(spark, sf):
    return sort.place(sort.add_hilbert(points(spark, sf)), ["hilbert", "c_custkey"]).select("c_custkey", "place")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority NULLS LAST, o_totalprice NULLS LAST, o_orderkey) AS place FROM orders")
def sort_column(spark, sf):
    return sort.place(table(spark, sf, "orders"), ["o_orderpriority", "o_totalprice", "o_orderkey"]).select("o_orderkey", "place")


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY quadkey, c_custkey) AS place FROM ({_quadkey_sql(13)})")
def sort_quadkey(spark, sf):
    return sort.place(columns.add_quadkey(points(spark, sf)), ["quadkey", "c_custkey"]).select("c_custkey", "place")


def _kdtree_sql(levels: int) -> str:
    sql = f"WITH {POINTS}, t0 AS (SELECT c_custkey, lon, lat, '0' AS cell FROM points)"
    for i in range(levels):
        c = "lat" if i % 2 else "lon"
        sql += f", t{i + 1} AS (SELECT c_custkey, lon, lat, cell || CASE WHEN {c} < m THEN '0' ELSE '1' END AS cell FROM t{i} JOIN (SELECT cell, quantile_disc({c}, 0.5) AS m FROM t{i} GROUP BY cell) USING (cell))"
    return sql + f" SELECT c_custkey, cell AS kdtree_cell FROM t{levels}"


@query(_kdtree_sql(3))
def kdtree_three_levels(spark, sf):
    return columns.add_kdtree(points(spark, sf), iterations=3, sample_size=None).select("c_custkey", "kdtree_cell")


@query("SELECT c_mktsegment AS value, count(*) AS n_rows FROM customer GROUP BY 1")
def partition_preview(spark, sf):
    return aggregate.partition_preview(table(spark, sf, "customer"), "c_mktsegment", limit=None)


@query("SELECT count(*) AS n_partitions, sum(n)::BIGINT AS total_rows, min(n) AS min_rows, max(n) AS max_rows, avg(n) AS avg_rows, median(n) AS median_rows FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def partition_analysis(spark, sf):
    return aggregate.partition_statistics(table(spark, sf, "orders"), "o_custkey")


@query("SELECT left(p_type, 4) AS value, count(*) AS n_rows FROM part GROUP BY 1")
def partition_prefix_preview(spark, sf):
    return aggregate.partition_preview(table(spark, sf, "part"), "p_type", 4, limit=None)


JOIN = f"WITH {WHOLE}, {RECTANGLES} SELECT c_custkey, n_name AS admin_name FROM points LEFT JOIN rects ON lon BETWEEN xmin AND xmin + 72 AND lat BETWEEN ymin AND ymin + 34"


@query(JOIN)
def spatial_left_join(spark, sf):
    return join.spatial_left_join(points(spark, sf, whole=True), nations(spark, sf), {"admin_name": "n_name"}).select("c_custkey", "admin_name")


@query(JOIN)
def spatial_left_join_exact(spark, sf):
    n = nations(spark, sf).withColumn("geometry", udf.box(*[F.col(f"bbox.{c}") for c in expr.BBOX_FIELDS]))
    return join.spatial_left_join(points(spark, sf, whole=True, geometry=True), n, {"admin_name": "n_name"}).select("c_custkey", "admin_name")


@query(JOIN)
def spatial_left_join_tiles(spark, sf):
    """With both sides shuffled, as boundaries too large to be broadcast are."""
    return join.spatial_left_join(points(spark, sf, whole=True), nations(spark, sf), {"admin_name": "n_name"}, broadcast_bytes=0).select("c_custkey", "admin_name")


@query(f"SELECT count(*) AS total, count(admin_name) AS matched, count(DISTINCT admin_name) AS n_0 FROM ({JOIN})")
def spatial_join_stats(spark, sf):
    return join.join_statistics(spatial_left_join(spark, sf), ["admin_name"])


@query(f"WITH {WHOLE}, {RECTANGLES} SELECT r_name, n_name, count(*) AS n FROM points JOIN rects ON lon BETWEEN xmin AND xmin + 72 AND lat BETWEEN ymin AND ymin + 34 JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def hierarchical_preview(spark, sf):
    n = nations(spark, sf).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = join.spatial_left_join(points(spark, sf, whole=True), n, {"r_name": "r_name", "n_name": "n_name"})
    return j.where("n_name is not null").groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN contains(code, '-') THEN split_part(code, '-', 2) ELSE code END AS region FROM (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'N-' || c_nationkey ELSE 'N' || c_nationkey END AS code FROM customer)")
def region_code(spark, sf):
    df = table(spark, sf, "customer").withColumn("code", F.expr("CASE WHEN c_nationkey % 2 = 0 THEN concat('N-', c_nationkey) ELSE concat('N', c_nationkey) END"))
    return df.select("c_custkey", join.region_code("code").alias("region"))


@query(f"WITH {POINTS} SELECT c_custkey, round(6378137.0 * radians(lon), 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 4) AS y FROM points")
def reproject_mercator(spark, sf):
    p = columns.reproject(points(spark, sf, geometry=True), "EPSG:3857")
    c = udf.centroid(F.col("geometry"))
    return p.select("c_custkey", c.alias("c")).select("c_custkey", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"))


@query(f"WITH {POINTS}, l AS (SELECT lon, lat, lag(lon) OVER (ORDER BY c_custkey) AS px, lag(lat) OVER (ORDER BY c_custkey) AS py FROM points) SELECT round(avg(sqrt((lon - px) * (lon - px) + (lat - py) * (lat - py))), 6) AS avg_distance FROM l")
def spatial_order_consecutive(spark, sf):
    from . import checks

    return checks.consecutive_distance(points(spark, sf, geometry=True), ["c_custkey"]).select(F.round("avg_distance", 6).alias("avg_distance"))


@query(f"WITH {POINTS} SELECT c_custkey, 'POINT (' || CASE WHEN lon = floor(lon) THEN lon::INT::VARCHAR ELSE lon::VARCHAR END || ' ' || CASE WHEN lat = floor(lat) THEN lat::INT::VARCHAR ELSE lat::VARCHAR END || ')' AS wkt FROM points")
def geometry_as_text(spark, sf):
    return points(spark, sf, geometry=True).select("c_custkey", udf.as_text(F.col("geometry")).alias("wkt"))


@query(f"WITH {POINTS} SELECT c_custkey, lon, lat FROM points")
def geojson_round_trip(spark, sf):
    g = points(spark, sf, geometry=True).select("c_custkey", udf.from_geojson(udf.as_geojson(F.col("geometry"))).alias("geometry"))
    c = udf.centroid(F.col("geometry"))
    return g.select("c_custkey", c.alias("c")).select("c_custkey", F.col("c.x").alias("lon"), F.col("c.y").alias("lat"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS value, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_partkey, p_name, p_retailprice, p_brand FROM part")
def union_by_name(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("value"))
    return a.unionByName(b, allowMissingColumns=True)


def chain(spark, sf):
    """Extract, envelope, quadkey, then the Hilbert order: the flagship."""
    p = extract.extract(points(spark, sf), bbox=(-170, -80, 170, 80), where="c_acctbal > 0")
    return flat(sort.sort_hilbert(columns.add_quadkey(p)), "c_custkey", "c_name", "lon", "lat", "quadkey")


QUERIES["chain_extract_quadkey_hilbert"] = chain
ORACLES["chain_extract_quadkey_hilbert"] = f"SELECT p.c_custkey, c_name, lon, lat, quadkey, lon AS xmin, lat AS ymin, lon AS xmax, lat AS ymax FROM (WITH {POINTS} SELECT * FROM points) p JOIN ({_quadkey_sql(13)}) q USING (c_custkey) WHERE lon BETWEEN -170 AND 170 AND lat BETWEEN -80 AND 80 AND c_acctbal > 0"
