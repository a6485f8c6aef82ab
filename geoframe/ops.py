"""Table to table functions, one for each operator, for use with DataFrame.transform() and pipe()."""

from .operators.aggregate import analyze_partitions, bounds, partition_preview, partition_statistics, stats
from .operators.columns import add_bbox, add_kdtree, add_quadkey, reproject
from .operators.extract import extract, head, tail
from .operators.join import add_admin_divisions, join_statistics, spatial_left_join
from .operators.sort import add_hilbert, sort_column, sort_hilbert, sort_quadkey
from .sources.readers import convert, read_csv, read_geojson, read_geopackage, read_parquet
from .sources.services import read_bigquery, read_feature_service
from .sources.shapefile import read_shapefile, write_shapefile
from .sources.sinks import geojson_features, partition_by, partition_by_levels, write_csv, write_geojson, write_geopackage, write_parquet

__all__ = [
    "add_admin_divisions", "add_bbox", "add_hilbert", "add_kdtree", "add_quadkey", "analyze_partitions", "bounds", "convert", "extract", "geojson_features", "head", "join_statistics",
    "partition_by", "partition_by_levels", "partition_preview", "partition_statistics", "read_bigquery", "read_csv", "read_feature_service", "read_geojson", "read_geopackage", "read_parquet",
    "read_shapefile", "reproject", "sort_column", "sort_hilbert", "sort_quadkey", "spatial_left_join", "stats", "tail", "write_csv", "write_geojson", "write_geopackage", "write_parquet", "write_shapefile",
]
