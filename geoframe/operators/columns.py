"""Derived columns: envelope, quadkey, kd-tree cell, reprojected geometry."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from .extract import bbox_column, geometry_column

SAMPLE, LEVELS, MAX_LEVELS = 100_000, 9, 20


def center(df: DataFrame, use_centroid: bool = False) -> tuple[Column, Column]:
    """Middle of the envelope if there is one, else the centroid of the geometry, else lon and lat."""
    box, geom = bbox_column(df), geometry_column(df)
    if box and not use_centroid:
        return expr.middle(F.col(f"`{box}`"))
    if geom:
        from ..functions import udf

        c = udf.centroid(F.col(f"`{geom}`"))
        return c["x"], c["y"]
    if {"lon", "lat"} <= set(df.columns):
        return F.col("lon"), F.col("lat")
    raise ValueError("no envelope, geometry or lon and lat")


def add_bbox(df: DataFrame, name: str = "bbox", *, force: bool = False) -> DataFrame:
    """Envelope of each geometry; an existing envelope stays unless force."""
    if name in df.columns and not force:
        return df
    geom = geometry_column(df)
    if geom:
        from ..functions import udf

        return df.withColumn(name, udf.envelope(F.col(f"`{geom}`")))
    return df.withColumn(name, F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), expr.bbox_struct("lon", "lat", "lon", "lat")))


def add_quadkey(df: DataFrame, name: str = "quadkey", *, resolution: int = 13, use_centroid: bool = False) -> DataFrame:
    return df.withColumn(name, expr.quadkey(*center(df, use_centroid), resolution))


def levels_for(rows: int, target: int) -> int:
    """The number of levels whose cells come nearest to target rows."""
    best = 1
    for i in range(1, MAX_LEVELS + 1):
        if abs(rows / 2**i - target) < abs(rows / 2**best - target):
            best = i
    return best


def kdtree_splits(points: np.ndarray, levels: int) -> list[float | None]:
    """Lower medians of a sample in heap order: x at even levels, y at odd ones."""
    splits: list[float | None] = [None] * (2**levels)
    cells = {1: points}
    for level in range(levels):
        after = {}
        for i, p in cells.items():
            v = p[:, level % 2]
            if not len(v):
                after[2 * i] = after[2 * i + 1] = p
                continue
            m = float(np.sort(v)[(len(v) - 1) // 2])
            splits[i] = m
            after[2 * i], after[2 * i + 1] = p[v < m], p[v >= m]
        cells = after
    return splits


#: Parts into which a cell's range is cut in each pass towards its exact median.
PARTS = 1 << 14


def _cell(splits: list[float | None], levels: int) -> Column:
    """Heap number of the cell of _cell_x, _cell_y after so many levels; splits: medians in heap order from place 1."""
    # the coordinates become columns first: a geometry function can't stand within a lambda
    at = lambda level: F.when(level % 2 == 0, F.col("_cell_x")).otherwise(F.col("_cell_y"))
    if not levels:
        return F.lit(1)
    medians = F.array(*[F.lit(v).cast("double") for v in splits[1:]])
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), F.lit(1), lambda i, level: i * 2 + F.when(at(level) >= F.element_at(medians, i), 1).otherwise(0))


def exact_splits(points: DataFrame, levels: int) -> list[float | None]:
    """Lower medians of all points (_cell_x, _cell_y) in heap order, level by level.

    For each cell the range that holds its median is cut into PARTS parts, whose rows are counted with partial sums, until
    the part of the median holds a single value.  The driver sees one row a cell and pass.
    """
    spark = points.sparkSession
    splits: list[float | None] = [None] * (2**levels)
    for level in range(levels):
        axis = "_cell_y" if level % 2 else "_cell_x"
        rows = points.select(_cell(splits, level).alias("cell"), F.col(axis).alias("v"))
        # cell: least and largest value that may be the median, rows below, the median's place
        open_ = {r["cell"]: (r["lo"], r["hi"], 0, (r["n"] - 1) // 2) for r in rows.groupBy("cell").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()}
        while True:
            for cell in [c for c, (lo, hi, *_) in open_.items() if lo == hi]:
                splits[cell] = open_.pop(cell)[0]
            if not open_:
                break
            state = F.broadcast(spark.createDataFrame([(c, *x) for c, x in open_.items()], "cell int, lo double, hi double, below long, rank long"))
            met = rows.join(state, "cell").where("v between lo and hi")
            part = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * PARTS), F.lit(PARTS - 1))
            counts = met.groupBy("cell", "below", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            upto = F.sum("n").over(Window.partitionBy("cell").orderBy("part")) + F.col("below")
            held = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
            open_ = {r["cell"]: (r["lo"], r["hi"], r["upto"] - r["n"], r["rank"]) for r in held.collect()}
    return splits


def add_kdtree(df: DataFrame, name: str = "kdtree_cell", *, iterations: int | None = LEVELS, sample_size: int | None = SAMPLE, auto_target_rows: int | None = None, key: list[str] | None = None) -> DataFrame:
    """Cell id: '0', then for each level 0 below the cell's median and 1 from it on; null coordinates go below.

    Medians come from the sample_size rows of least hash, a bounded top-k (of the key, else of the row's place in its file, so
    that copies of a point are drawn one by one), or, with sample_size None, exactly from all rows; the cells are then one
    expression over an array of medians, in one pass, without a join.
    """
    if auto_target_rows:
        iterations = levels_for(df.count(), auto_target_rows)
    levels = LEVELS if iterations is None else iterations
    if not 1 <= levels <= MAX_LEVELS:
        raise ValueError(f"iterations must be between 1 and {MAX_LEVELS}")
    x, y = center(df)
    whole = "_cell_x is not null and _cell_y is not null"
    if sample_size is None:
        splits = exact_splits(df.select(x.cast("double").alias("_cell_x"), y.cast("double").alias("_cell_y")).where(whole), levels)
    else:
        at = [F.col(f"`{c}`") for c in key] if key else _place(df)
        points = df.select(x.alias("_cell_x"), y.alias("_cell_y"), F.xxhash64(*at).alias("_hash")).where(whole)
        sample = points.orderBy("_hash", "_cell_x", "_cell_y").limit(sample_size).select("_cell_x", "_cell_y").toPandas().to_numpy(np.float64)
        splits = kdtree_splits(sample, levels)
    return df.withColumns({"_cell_x": x, "_cell_y": y}).withColumn(name, F.concat(F.lit("0"), F.substring(F.bin(_cell(splits, levels).cast("long")), 2, levels))).drop("_cell_x", "_cell_y")


def _place(df: DataFrame) -> list[Column]:
    """What tells rows apart: file and place, or all columns where df is no scan."""
    try:
        at = df.metadataColumn("_metadata")
        df.select(at["row_index"])
        return [at["file_path"], at["row_index"]]
    except AnalysisException:
        return [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]


def reproject(df: DataFrame, target_crs: str = "EPSG:4326", source_crs: str = "EPSG:4326") -> DataFrame:
    """Geometry in another reference system; the envelope, stale by then, goes."""
    from ..functions import udf

    geom = geometry_column(df)
    if geom is None:
        raise ValueError("no geometry")
    box = bbox_column(df)
    out = df.withColumn(geom, udf.transform(F.col(f"`{geom}`"), source_crs, target_crs))
    return out.drop(box) if box else out
