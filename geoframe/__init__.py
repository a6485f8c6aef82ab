"""geoframe: geospatial Parquet analytics on PySpark."""
