"""GeoFrame: an immutable table with a geometry, its methods thin wrappers of the functions in operators/."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .operators import aggregate, columns, extract, join, sort
from .plans import checks, fixes, inspect, metadata
from .sources import ipc, readers, shapefile, sinks


@dataclass(frozen=True)
class GeoFrame:
    """df and what is known of its reference system; every method gives a new, lazy GeoFrame."""

    df: DataFrame
    crs: dict | str | None = None
    path: str | None = None

    @staticmethod
    def read(spark: SparkSession, path: str, *, crs: dict | str | None = None, **options) -> GeoFrame:
        """Any format; the reference system is that of the file unless it is given."""
        return GeoFrame(readers.convert(spark, path, **options), crs or readers.crs_of(spark, path), path)

    def _path(self) -> str:
        if self.path is None or not (self.path.endswith(".parquet") or os.path.isdir(self.path)):
            raise ValueError("files are checked as they are: read a Parquet file, or write one first")
        return self.path

    def check(self, files: int | None = None) -> list[checks.CheckResult]:
        """All checks of the files that were read (or of the first so many)."""
        return checks.check_path(self.df.sparkSession, self._path(), files=files)

    def _check(self, name: str) -> checks.CheckResult:
        return next(c for c in self.check() if c.name == name)

    def check_compression(self) -> checks.CheckResult:
        return self._check("compression")

    def check_bbox(self) -> checks.CheckResult:
        return self._check("envelope")

    def check_row_groups(self) -> checks.CheckResult:
        return self._check("row groups")

    def validate(self) -> checks.CheckResult:
        """The rules of the format on the first file's metadata and schema, and on all geometries."""
        first = readers.first_file(self.df.sparkSession, self._path())
        info = metadata.file_info(first)
        rules = metadata.validate_native(first) if metadata.file_kind(info) == "native" else metadata.validate(info)
        # a file's metadata describe that file alone
        rules += checks.validate_data(readers.read_parquet(self.df.sparkSession, first), info)
        bad = [f"{name}: {why}" for name, kept, why in rules if not kept]
        return checks.CheckResult("validation", not bad, bad, details={"rules": len(rules)})

    def fix(self, output: str | None = None, **options) -> tuple[list[str], list[checks.CheckResult]]:
        return fixes.fix_file(self.df.sparkSession, self._path(), output, **options)

    def upload(self, destination: str, **options) -> None:
        """Write to a store that Arrow's file systems know, by URI."""
        if "://" not in destination:
            raise ValueError("a destination is a URI such as s3://bucket/folder")
        self.write(destination, **options)

    def explain(self) -> str:
        """The plan that would run."""
        return self.df._jdf.queryExecution().toString()

    def _with(self, df: DataFrame) -> GeoFrame:
        return replace(self, df=df, path=None)

    def extract(self, **options) -> GeoFrame:
        if options.get("bbox") is not None and metadata.is_geographic(self.crs) is False:
            x0, y0, x1, y1 = extract.parse_bbox(options["bbox"])
            if -180 <= x0 <= x1 <= 180 and -90 <= y0 <= y1 <= 90:
                warnings.warn(f"the box looks like longitude and latitude, the data are in {metadata.crs_code(self.crs)} and reach {self.bounds()}", stacklevel=2)
        return self._with(extract.extract(self.df, **options))

    def head(self, n: int = 10, order: list[str] | None = None) -> GeoFrame:
        return self._with(extract.head(self.df, n, order))

    def tail(self, n: int = 10, *, order: list[str]) -> GeoFrame:
        return self._with(extract.tail(self.df, n, order=order))

    def add_bbox(self, name: str = "bbox", *, force: bool = False) -> GeoFrame:
        return self._with(columns.add_bbox(self.df, name, force=force))

    def add_quadkey(self, name: str = "quadkey", *, resolution: int = 13, use_centroid: bool = False) -> GeoFrame:
        if metadata.is_geographic(self.crs) is False:
            raise ValueError("quadkeys need longitude and latitude: reproject first")
        return self._with(columns.add_quadkey(self.df, name, resolution=resolution, use_centroid=use_centroid))

    def add_kdtree(self, name: str = "kdtree_cell", **options) -> GeoFrame:
        return self._with(columns.add_kdtree(self.df, name, **options))

    def add_admin_divisions(self, boundaries: DataFrame, **options) -> GeoFrame:
        return self._with(join.add_admin_divisions(self.add_bbox().df, boundaries, **options))

    def sort_hilbert(self) -> GeoFrame:
        return self._with(sort.sort_hilbert(self.df))

    def sort_column(self, names: str | list[str], descending: bool = False) -> GeoFrame:
        return self._with(sort.sort_column(self.df, names, descending))

    def sort_quadkey(self, name: str = "quadkey", **options) -> GeoFrame:
        return self._with(sort.sort_quadkey(self.df, name, **options))

    def reproject(self, target_crs: str = "EPSG:4326", source_crs: str | None = None) -> GeoFrame:
        source = source_crs or (metadata.crs_code(self.crs) if self.crs else "EPSG:4326")
        return GeoFrame(columns.reproject(self.df, target_crs, source), target_crs, None)

    def add_hilbert(self, name: str = "hilbert") -> GeoFrame:
        return self._with(sort.add_hilbert(self.df, name))

    def bounds(self) -> tuple | None:
        b = aggregate.bounds(self.df).first()
        return None if b["xmin"] is None else tuple(b)

    def stats(self) -> DataFrame:
        return aggregate.stats(self.df)

    def info(self) -> dict:
        """Columns, geometry, reference system, rows and bounds."""
        return {"columns": dict(self.df.dtypes), "geometry": extract.geometry_column(self.df), "bbox_column": extract.bbox_column(self.df), "crs": metadata.crs_code(self.crs), "rows": self.df.count(), "bounds": self.bounds()}

    def preview(self, n: int = 10) -> DataFrame:
        return inspect.preview(self.df, n)

    def check_spatial(self, order: list[str], **options) -> checks.CheckResult:
        return checks.check_spatial_order(self.df, order, **options)

    def partition_by_string(self, path: str, column: str, *, chars: int | None = None, hive: bool = True, **options) -> int:
        return sinks.partition_by(self.df, path, column, prefix=chars, hive=hive, **options)

    def partition_by_quadkey(self, path: str, *, resolution: int = 13, partition_resolution: int = 6, hive: bool = True, **options) -> int:
        if partition_resolution > resolution:
            raise ValueError("partition_resolution must not be above resolution")
        return sinks.partition_by(self.add_quadkey(resolution=resolution).df, path, "quadkey", prefix=partition_resolution, hive=hive, **options)

    def partition_by_kdtree(self, path: str, *, iterations: int = 9, hive: bool = True, **options) -> int:
        return sinks.partition_by(self.add_kdtree(iterations=iterations).df, path, "kdtree_cell", hive=hive, **options)

    def partition_by_admin(self, path: str, boundaries: DataFrame, *, dataset: str = "gaul", levels: list[str] | None = None, hive: bool = True, **options) -> int:
        """Nested folders by the boundaries that a feature touches; only its own columns are written."""
        levels = levels or list(join.ADMIN[dataset])
        joined = join.spatial_left_join(self.add_bbox().df, boundaries, {f"_level_{x}": join.ADMIN[dataset][x] for x in levels})
        return sinks.partition_by_levels(joined, path, {x: f"_level_{x}" for x in levels}, keep=self.df.columns, hive=hive, **options)

    def to_geojson(self, path: str | None = None, **options) -> DataFrame | None:
        """Features as text, or written to path."""
        if path is None:
            return sinks.geojson_features(self.df, **options)
        sinks.write_geojson(self.df, path, **options)
        return None

    def write(self, path: str, format: str | None = None, **options) -> None:
        """By format, else by extension; Parquet where neither tells."""
        kind = format or {".csv": "csv", ".geojson": "geojson", ".json": "geojson", ".gpkg": "geopackage", ".shp": "shapefile"}.get(path[path.rfind(".") :].lower() if "." in path else "", "parquet")
        if kind == "parquet" and self.crs is not None and "crs" not in options and not metadata.same_crs(self.crs, None):
            options["crs"] = self.crs if isinstance(self.crs, dict) else metadata.named_crs(self.crs)
        if kind == "shapefile" and self.crs is not None:
            options.setdefault("crs", metadata.crs_code(self.crs))
        {"csv": sinks.write_csv, "geojson": sinks.write_geojson, "geopackage": sinks.write_geopackage, "shapefile": shapefile.write_shapefile, "parquet": sinks.write_parquet}[kind](self.df, path, **options)

    def to_arrow(self):
        return self.df.toArrow()

    def write_ipc(self, stream) -> int:
        """Rows as an Arrow stream to an open binary file or pipe, a partition at a time; the number of rows is returned."""
        return ipc.write(self.df, stream, geometry=extract.geometry_column(self.df), crs=self.crs)

    @staticmethod
    def read_ipc(spark: SparkSession, stream) -> GeoFrame:
        return GeoFrame(*ipc.read(spark, stream))


def pipe(*operations: Callable) -> Callable:
    """Operations from left to right as one; none is the identity."""
    return lambda frame: reduce(lambda x, f: f(x), operations, frame)
