"""Files: native types, checks and repairs in place, validation, reference systems, streams to and from programs."""

import io
import json
import os
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from geoframe import __main__ as cli
from geoframe.frame import GeoFrame
from geoframe.functions import native, udf
from geoframe.operators import aggregate
from geoframe.plans import checks, fixes, metadata
from geoframe.sources import ipc, parts, readers, shapefile, sinks
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def places(spark):
    rows = [(i, f"n{i}", (i * 37 % 360) - 180.0, (i * 53 % 170) - 85.0) for i in range(300)] + [(300, "none", None, None)]
    df = spark.createDataFrame(rows, "id long, name string, lon double, lat double")
    return df.withColumn("geometry", udf.point(F.col("lon"), F.col("lat"))).drop("lon", "lat").cache()


def test_native_types(places, spark, tmp_path):
    for only in (False, True):
        path = str(tmp_path / f"v2{only}")
        crs = {"type": "ProjectedCRS", "id": {"authority": "EPSG", "code": 3857}}
        sinks.write_parquet(GeoFrame(places).add_bbox().df, path, version="2.0", crs=crs, geo_only=only)
        assert readers.read_parquet(spark, path).columns == ["id", "name", "geometry"]
        infos = [metadata.file_info(p) for p, _ in readers.files_of(spark, path)]
        assert all(i["native"]["geometry"]["kind"] == "Geometry" and metadata.crs_code(i["native"]["geometry"]["crs"]) == "EPSG:3857" for i in infos)
        assert {metadata.file_kind(i) for i in infos} == {"native" if only else "v2"}
        assert all(kept for i in infos for _, kept, _ in (metadata.validate_native(i["path"]) if only else metadata.validate(i)))
        assert all(not metadata.mismatches(i) for i in infos)
        assert metadata.crs_code(GeoFrame.read(spark, path).crs) == "EPSG:3857"
        boxes = [b for i in infos for b in native.bounds(metadata.open_footer(i["path"]), "geometry") if b["xmin"] is not None]
        assert (min(b["xmin"] for b in boxes), max(b["ymax"] for b in boxes)) == (-180.0, 84.0)
        assert all(c.passed for c in checks.check_path(spark, path))
    told = {**infos[0], "geo": metadata.build("geometry", version="2.0", crs={"id": {"authority": "EPSG", "code": 4326}})}
    assert metadata.mismatches(told) and not all(kept for _, kept, _ in metadata.validate(told))


def test_fix_in_place(places, spark, tmp_path):
    path = str(tmp_path / "f")
    sinks.write_parquet(places, path, codec="SNAPPY", version="1.0")
    before = GeoFrame.read(spark, path)
    assert [c.name for c in before.check() if not c] == ["compression", "envelope"] and before.check_row_groups() and not before.check_bbox()
    done, after = before.fix()
    assert done == ["compression", "envelope"] and all(after) and os.listdir(tmp_path) == ["f"]
    again = GeoFrame.read(spark, path)
    assert again.df.count() == 301 and again.check_compression() and fixes.fix_file(spark, path)[0] == []
    assert again.validate(), again.validate().failures
    with pytest.raises(ValueError, match="read a Parquet file"):
        GeoFrame(places).check()
    assert cli.main(["check", path]) == 0 and cli.main(["fix", path]) == 0


def test_validation_reads_the_rows(places, spark):
    bad = places.withColumn("geometry", F.when(F.col("id") == 3, F.lit(b"\x01\x02")).otherwise(F.col("geometry")))
    turned = spark.createDataFrame([(1, "POLYGON ((0 0, 0 1, 1 1, 0 0))"), (2, "POLYGON ((0 0, 1 0, 1 1, 0 0))")], "id long, t string").select("id", udf.from_text(F.col("t")).alias("geometry"))
    rules = lambda df, **meta: {n: kept for n, kept, _ in checks.validate_data(df, {"geo": metadata.build("geometry", **meta)})}
    assert rules(bad, geometry_types=["Point"]) == {"well-formed": False, "geometry types": True, "coordinates are degrees": True}
    assert not rules(places, geometry_types=["LineString"])["geometry types"]
    assert rules(turned, edges="spherical")["orientation"] is False
    assert rules(turned.where("id = 2"), edges="spherical")["orientation"] is True
    assert rules(places, bbox=(-180, -85, 180, 85))["bounds"] and not rules(places, bbox=(-1, -85, 180, 85))["bounds"]
    assert rules(places, bbox=(170, -85, -170, 85))["bounds"]  # over the date line
    far = places.withColumn("geometry", udf.point(F.lit(5e5), F.lit(5e6)))
    assert not rules(far)["coordinates are degrees"]
    assert rules(places.where("false"), bbox=(0, 0, 1, 1)) == {"well-formed": True, "geometry types": True}


def test_reference_systems_of_inputs(places, spark, tmp_path):
    f = GeoFrame(places.where("id < 9")).reproject("EPSG:32633")
    f.write(str(tmp_path / "u.shp"))
    assert not (tmp_path / "u.prj").exists() and readers.crs_of(spark, str(tmp_path / "u.shp")) is None
    (tmp_path / "u.prj").write_text('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32633"]]')
    assert GeoFrame.read(spark, str(tmp_path / "u.shp")).crs == "EPSG:32633"
    GeoFrame(places).write(str(tmp_path / "w.shp"))
    assert GeoFrame.read(spark, str(tmp_path / "w.shp")).crs == "EPSG:4326"
    GeoFrame(places).write(str(tmp_path / "w.gpkg"))
    assert GeoFrame.read(spark, str(tmp_path / "w.gpkg")).crs == "EPSG:4326"
    (tmp_path / "c.geojson").write_text('{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:EPSG::3857"}},"features":[]}')
    assert metadata.crs_code(readers.crs_of(spark, str(tmp_path / "c.geojson"))) == "EPSG:3857"
    f.write(str(tmp_path / "p"))
    again = GeoFrame.read(spark, str(tmp_path / "p"))
    with pytest.raises(ValueError, match="reproject first"):
        again.add_quadkey()
    with pytest.warns(UserWarning, match="longitude and latitude"):
        again.extract(bbox=(0, 0, 1, 1))
    back = again.reproject("EPSG:4326").df.select(udf.as_text(F.col("geometry")).alias("t"), "id").where("id = 1").first()["t"]
    assert back.startswith("POINT (-142.99") or back.startswith("POINT (-143")


def test_projected_text_is_warned_of(spark, tmp_path):
    (tmp_path / "p.csv").write_text('id,wkt\n1,"POINT (500000 4000000)"\n')
    with pytest.warns(UserWarning, match="projected"):
        assert readers.read_csv(spark, str(tmp_path / "p.csv")).count() == 1


def test_arrow_streams(places, spark):
    pipe = io.BytesIO()
    assert GeoFrame(places, {"id": {"authority": "EPSG", "code": 3857}}).write_ipc(pipe) == 301
    pipe.seek(0)
    again = GeoFrame.read_ipc(spark, pipe)
    assert sorted(map(str, again.df.collect())) == sorted(map(str, places.collect())) and metadata.crs_code(again.crs) == "EPSG:3857"
    pipe = io.BytesIO()
    assert GeoFrame(places.where("false")).write_ipc(pipe) == 0
    pipe.seek(0)
    assert GeoFrame.read_ipc(spark, pipe).df.count() == 0


def test_sizes():
    assert [metadata.parse_size(x) for x in ("256MB", "1.5 GB", 3, "10B", "2k", " 1T ")] == [256 << 20, 3 << 29, 3 << 20, 10, 2048, 1 << 40]
    for bad in ("", "MB", "-1MB", "1XB", "0", "nan", "infMB"):
        with pytest.raises(ValueError):
            metadata.parse_size(bad)
    assert metadata.row_group_rows(1000, 10**9, target_mb=100) == 104 and metadata.row_group_rows(10, 100) == 10
    assert metadata.row_group_rows(0, 0) == 100_000 and metadata.row_group_rows(5, 9, target_rows=7) == 5


def test_advice():
    kinds = lambda *a: [x.split(":")[0].split(" ")[0] for x in aggregate.advice(*a)]
    assert kinds(3, 500, 10, 20, 1.0, False) == ["500"]
    assert kinds(2000, 10**7, 5000, 9000, 2.0, False) == ["leave"]
    assert kinds(20, 4 * 10**7, 2 * 10**6, 2 * 10**7, 9.0, True) == ["a", "partition", "sensible"]
    assert kinds(3, 2 * 10**6, 7 * 10**5, 10**6, 1.0, False) == ["a"]
    assert kinds(6000, 10**9, 166_666, 10**6, 2.0, False) == ["partition"]


def test_large_collection_is_read_whole(spark, tmp_path):
    """150 MB of features, far over what one value may hold."""
    path = tmp_path / "large.geojson"
    with open(path, "w") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i in range(150_000):
            f.write(("," if i else "") + json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [i % 180, i % 85]}, "properties": {"i": i, "t": "x" * 900}}))
        f.write("]}")
    df = readers.read_geojson(spark, str(path))
    assert df.agg(F.count("geometry"), F.count_distinct("i"), F.max("i")).first()[:] == (150_000, 150_000, 149_999)


def test_dry_run(places, spark, tmp_path, capsys):
    GeoFrame(places).write(str(tmp_path / "p"))
    assert cli.main(["extract", str(tmp_path / "p"), str(tmp_path / "q"), "--where", "id < 5", "--dry-run"]) == 0
    assert "Physical Plan" in capsys.readouterr().out and not (tmp_path / "q").exists()
    assert cli.main(["convert", str(tmp_path / "p"), str(tmp_path / "q"), "--hilbert", "--bbox"]) == 0
    assert all("bbox" in pq.read_schema(p).names for p, _ in readers.files_of(spark, str(tmp_path / "q")))


@pytest.fixture
def no_rows_to_the_driver(monkeypatch):
    """Rows neither come to the driver from tasks nor go out from it."""
    from pyspark.sql import DataFrame

    def refuse(*_):
        raise AssertionError("rows pass the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    monkeypatch.setattr(parts, "PART", 2_000)


def test_arrow_streams_are_encoded_by_tasks(spark, no_rows_to_the_driver):
    df = spark.range(0, 900, 1, 3).select("id", F.array(F.col("id"), F.lit(None)).alias("a"), F.when(F.col("id") % 3 > 0, F.struct(F.lit("é").alias("s"))).alias("b"), F.timestamp_seconds("id").alias("t"))
    for rows in (df, df.where("false")):
        pipe = io.BytesIO()
        n = ipc.write(rows, pipe, geometry=None)
        pipe.seek(0)
        table = pa.ipc.open_stream(io.BytesIO(pipe.getvalue())).read_all()
        again, _ = ipc.read(spark, pipe)
        assert n == rows.count() == table.num_rows and again.dtypes == df.dtypes and again.collect() == rows.collect()
        assert table.column("id").to_pylist() == [r[0] for r in rows.select("id").collect()]


def test_collections_are_written_by_tasks(spark, tmp_path, no_rows_to_the_driver):
    df = spark.range(0, 400, 1, 3).select("id", F.lit('é",\n{').alias("s"), udf.point(F.col("id") / 10, F.lit(1.0)).alias("geometry"))
    for n in (400, 0):
        path = str(tmp_path / f"{n}.geojson")
        sinks.write_geojson(df.where(F.col("id") < n), path)
        with open(path, encoding="utf-8") as f:
            text = f.read()
        found = json.loads(text)["features"]
        assert [x["properties"] for x in found] == [{"id": i, "s": 'é",\n{'} for i in range(n)] and text.count("\n") == n + 2


def test_geopackages_are_filled_and_read_by_tasks(spark, tmp_path, no_rows_to_the_driver, monkeypatch):
    monkeypatch.setattr(readers, "GPKG_ROWS", 150)
    df = spark.range(0, 400, 1, 3).select("id", F.lit("é").alias("s"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("d"), F.when(F.col("id") % 7 > 0, udf.point(F.col("id") / 10, F.lit(1.0))).alias("geometry"))
    for n in (400, 0):
        path = str(tmp_path / f"{n}.gpkg")
        sinks.write_geopackage(df.where(F.col("id") < n), path)
        again = readers.read_geopackage(spark, path)
        assert again.rdd.getNumPartitions() == 3 or not n
        got = [(r["fid"], r["id"] and int(r["id"]), r["s"], r["d"], r["geometry"]) for r in again.collect()]
        assert got == [(i + 1, *r) for i, r in enumerate(df.where(F.col("id") < n).collect())]


def test_shapefiles_are_coded_by_tasks(spark, tmp_path, no_rows_to_the_driver, monkeypatch):
    monkeypatch.setattr(shapefile, "ROWS", 150)
    df = spark.range(0, 400, 1, 3).select("id", F.lit("é").alias("s"), F.when(F.col("id") % 3 > 0, F.col("id") / 4).alias("d"), F.when(F.col("id") % 7 > 0, udf.point(F.col("id") / 10, F.lit(1.0))).alias("geometry"))
    for n in (400, 0):
        path = str(tmp_path / f"{n}.shp")
        shapefile.write_shapefile(df.where(F.col("id") < n), path)
        again = shapefile.read_shapefile(spark, path)
        assert again.rdd.getNumPartitions() == 3 or not n
        assert again.collect() == df.where(F.col("id") < n).collect()
        with open(path, "rb") as f, open(path[:-4] + ".shx", "rb") as g:
            shp, shx = f.read(), g.read()
        places = [struct.unpack_from(">ii", shx, a) for a in range(100, len(shx), 8)]
        assert [struct.unpack_from(">ii", shp, 2 * a) for a, _ in places] == [(i + 1, size) for i, (_, size) in enumerate(places)]
        assert len(places) == n and 2 * struct.unpack_from(">i", shp, 24)[0] == len(shp)
