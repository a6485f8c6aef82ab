"""Geometry functions over WKB columns, a batch of Arrow values at a time; plain points are vectorised."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import crs, wkb

ENVELOPE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")])
XY = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y")])
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package even where PYTHONPATH doesn't name it."""
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = env.get("PYTHONPATH") or _ROOT


def _each(values: pd.Series, f, default=None) -> list:
    """f of each geometry; null, and bytes that aren't a geometry, give the default."""
    out = []
    for v in values:
        try:
            out.append(default if v is None else f(wkb.parse(v)))
        except wkb.BadGeometry:
            out.append(default)
    return out


@pandas_udf(ENVELOPE)
def _envelope(values: pd.Series) -> pd.DataFrame:
    p = wkb.points_of(values.tolist())
    if p is not None and not np.isnan(p).any():
        return pd.DataFrame({"xmin": p[:, 0], "ymin": p[:, 1], "xmax": p[:, 0], "ymax": p[:, 1]})
    rows = _each(values, wkb.envelope)
    return pd.DataFrame([r or (None,) * 4 for r in rows], columns=["xmin", "ymin", "xmax", "ymax"], dtype="object")


@pandas_udf(XY)
def _centroid(values: pd.Series) -> pd.DataFrame:
    p = wkb.points_of(values.tolist())
    if p is not None and not np.isnan(p).any():
        return pd.DataFrame({"x": p[:, 0], "y": p[:, 1]})
    return pd.DataFrame([r or (None, None) for r in _each(values, wkb.centroid)], columns=["x", "y"], dtype="object")


@pandas_udf(T.StringType())
def _kind(values: pd.Series) -> pd.Series:
    return pd.Series(_each(values, lambda g: wkb.NAMES[g.kind]), dtype="object")


@pandas_udf(T.StringType())
def _text(values: pd.Series) -> pd.Series:
    return pd.Series(_each(values, wkb.to_wkt), dtype="object")


@pandas_udf(T.BinaryType())
def _from_text(values: pd.Series) -> pd.Series:
    out = []
    for v in values:
        try:
            out.append(None if v is None else wkb.encode(wkb.from_wkt(v)))
        except wkb.BadGeometry:
            out.append(None)
    return pd.Series(out, dtype="object")


@pandas_udf(T.BinaryType())
def _from_geojson(values: pd.Series) -> pd.Series:
    out = []
    for v in values:
        try:
            out.append(None if v is None else wkb.encode(wkb.from_geojson(v)))
        except wkb.BadGeometry:
            out.append(None)
    return pd.Series(out, dtype="object")


@pandas_udf(T.BinaryType())
def _point(x: pd.Series, y: pd.Series) -> pd.Series:
    c = np.column_stack([x.to_numpy(np.float64, na_value=np.nan), y.to_numpy(np.float64, na_value=np.nan)]).astype("<f8")
    none = np.isnan(c).any(1)
    return pd.Series([None if n else b"\x01\x01\x00\x00\x00" + r.tobytes() for r, n in zip(c, none)], dtype="object")


@pandas_udf(T.BinaryType())
def _box(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in r) else wkb.encode(wkb.box(*map(float, r))) for r in zip(x0, y0, x1, y1)], dtype="object")


@pandas_udf(T.BooleanType())
def _intersects(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[bytes, wkb.Geometry] = {}

    def one(v: bytes) -> wkb.Geometry:
        if v not in known:
            if len(known) > 256:
                known.clear()
            known[v] = wkb.parse(v)
        return known[v]

    out = []
    for x, y in zip(a, b):
        try:
            out.append(None if x is None or y is None else wkb.intersects(wkb.parse(x), one(y)))
        except wkb.BadGeometry:
            out.append(None)
    return pd.Series(out, dtype="object")


@pandas_udf(T.DoubleType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    p, q = wkb.points_of(a.tolist()), wkb.points_of(b.tolist())
    if p is not None and q is not None:
        return pd.Series(np.hypot(p[:, 0] - q[:, 0], p[:, 1] - q[:, 1]))
    return pd.Series([None if x is None or y is None else wkb.distance(wkb.parse(x), wkb.parse(y)) for x, y in zip(a, b)], dtype="object")


def _call(f, *columns: Column) -> Column:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship(spark)
    return f(*columns)


def envelope(g: Column) -> Column:
    """Struct of bounds; null for null, empty and malformed geometries."""
    e = _call(_envelope, g)
    return F.when(e["xmin"].isNotNull(), e)


def centroid(g: Column) -> Column:
    return _call(_centroid, g)


def geometry_type(g: Column) -> Column:
    return _call(_kind, g)


def as_text(g: Column) -> Column:
    return _call(_text, g)


def from_text(text: Column) -> Column:
    """Null for text that isn't a geometry."""
    return _call(_from_text, text)


def from_geojson(text: Column) -> Column:
    return _call(_from_geojson, text)


def point(x: Column, y: Column) -> Column:
    return _call(_point, x, y)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return _call(_box, x0, y0, x1, y1)


def intersects(a: Column, b: Column) -> Column:
    return _call(_intersects, a, b)


FACTS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("oriented", T.BooleanType()), T.StructField("envelope", ENVELOPE)])


@pandas_udf(FACTS)
def _facts(values: pd.Series) -> pd.DataFrame:
    out = []
    for v in values:
        try:
            g = None if v is None else wkb.parse(v)
        except wkb.BadGeometry:
            g = None
        if g is None:
            out.append((None, None, None))
            continue
        turns = [(wkb._ring_area(r)[0] > 0) == (i == 0) for p in g.leaves() if p.kind == 3 for i, r in enumerate(p.body)]
        e = wkb.envelope(g)
        out.append((wkb.GEOJSON[g.kind] + (" Z" if g.dims > 2 and not g.m else ""), all(turns), e and dict(zip(("xmin", "ymin", "xmax", "ymax"), map(float, e)))))
    return pd.DataFrame(out, columns=["kind", "oriented", "envelope"], dtype="object")


def facts(g: Column) -> Column:
    """Type as the metadata names it, whether outer rings turn counterclockwise and holes against, envelope; nulls if it can't be read."""
    return _call(_facts, g)


def intersects_some(g: Column, others: Column, shared=None) -> Column:
    """For each of others, whether g intersects it: an array of WKB or, with shared (a broadcast list of WKB), of places in that.

    Points are tested against a polygon all at once.
    """

    @pandas_udf(T.ArrayType(T.BooleanType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict = {}

        def parsed(x):
            if x not in known:
                if len(known) > 4096:
                    known.clear()
                try:
                    value = shared.value[x] if shared is not None else x
                    known[x] = None if value is None else wkb.parse(value)
                except wkb.BadGeometry:
                    known[x] = None
            return known[x]

        for values, lists in batches:
            lists = [[] if x is None else list(x) for x in lists]
            found = [[False] * len(x) for x in lists]
            by: dict = {}
            for row, x in enumerate(lists):
                for place, other in enumerate(x):
                    by.setdefault(other, []).append((row, place))
            geometries = values.tolist()
            points = wkb.points_of(geometries)
            for other, places in by.items():
                b = None if other is None else parsed(other)
                if b is None:
                    continue
                leaves = list(b.leaves())
                if points is not None and leaves and all(p.kind == 3 and p.body for p in leaves):
                    at = np.array([row for row, _ in places])
                    inside = np.logical_or.reduce([wkb.in_rings(points[at, 0], points[at, 1], p.body) for p in leaves])
                    for (row, place), good in zip(places, inside.tolist()):
                        found[row][place] = good
                    continue
                for row, place in places:
                    try:
                        found[row][place] = geometries[row] is not None and bool(wkb.intersects(wkb.parse(geometries[row]), b))
                    except wkb.BadGeometry:
                        pass
            yield pd.Series(found, dtype="object")

    return _call(run, g, others)


def distance(a: Column, b: Column) -> Column:
    return _call(_distance, a, b)


def as_geojson(g: Column, precision: int | None = 7) -> Column:
    @pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(_each(values, lambda x: wkb.to_geojson(x, precision)), dtype="object")

    return _call(run, g)


def intersects_literal(g: Column, other: bytes) -> Column:
    """With one geometry for all rows; points against a polygon are one vectorised test a batch."""

    @pandas_udf(T.BooleanType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b = wkb.parse(other)
        polygons = [p.body for p in b.leaves()] if all(p.kind == 3 and p.body for p in b.leaves()) else None
        for values in batches:
            p = wkb.points_of(values.tolist())
            if p is not None and polygons:
                yield pd.Series(np.logical_or.reduce([wkb.in_rings(p[:, 0], p[:, 1], rings) for rings in polygons]))
            else:
                yield pd.Series(_each(values, lambda x: wkb.intersects(x, b)), dtype="object")

    return _call(run, g)


def transform(g: Column, source: str, target: str) -> Column:
    crs.transform(source, target)  # refuse now, not in a task

    @pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = crs.transform(source, target)
        for values in batches:
            p = wkb.points_of(values.tolist())
            if p is not None and len(p):
                c = np.column_stack(f(p[:, 0], p[:, 1])).astype("<f8")
                yield pd.Series([b"\x01\x01\x00\x00\x00" + r.tobytes() for r in c], dtype="object")
            else:
                yield pd.Series(_each(values, lambda x: wkb.encode(wkb.map_coords(x, f))), dtype="object")

    return _call(run, g)


def envelope_wkb(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return wkb.encode(wkb.box(x0, y0, x1, y1))


def as_wkb(geometry: bytes | str, use_first: bool = False) -> bytes:
    """WKB of WKB, WKT, GeoJSON or the path of a file with either (@path); of several features only with use_first."""
    if isinstance(geometry, (bytes, bytearray)):
        return bytes(geometry)
    text = geometry.strip()
    if text.startswith("@") or (len(text) < 1024 and os.path.exists(text)):
        with open(text.removeprefix("@")) as f:
            text = f.read().strip()
    if not text.startswith("{"):
        return wkb.encode(wkb.from_wkt(text))
    obj = json.loads(text)
    if obj.get("type") == "FeatureCollection":
        features = obj.get("features") or []
        if len(features) != 1 and not (features and use_first):
            raise ValueError(f"{len(features)} features: choose one, or take the first with use_first")
        obj = features[0]
    return wkb.encode(wkb.from_geojson(obj))
