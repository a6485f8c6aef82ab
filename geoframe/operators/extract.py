"""Projection and filters: columns, envelopes, geometries and scalar conditions, then a limit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr

GEOMETRY_NAMES = ("geometry", "geom", "the_geom", "wkb_geometry")
#: Words that a condition must not hold, wherever they stand (fixed values).
FORBIDDEN = "DROP DELETE INSERT UPDATE CREATE ALTER TRUNCATE EXEC EXECUTE MERGE REPLACE GRANT REVOKE".split()


def geometry_column(df: DataFrame) -> str | None:
    return next((c for c in GEOMETRY_NAMES if c in df.columns), None)


def bbox_column(df: DataFrame) -> str | None:
    """A struct named bbox, bounds or extent (or ending so) with the four fields."""
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct" and set(expr.BBOX_FIELDS) <= set(f.dataType.names) and re.search("(bbox|bounds|extent)$", f.name.lower()):
            return f.name
    return None


def parse_bbox(text: str | tuple) -> tuple[float, float, float, float]:
    """xmin,ymin,xmax,ymax; a turned box is an error, an empty one isn't."""
    try:
        parts = tuple(float(v) for v in (text.split(",") if isinstance(text, str) else text))
    except (TypeError, ValueError):
        raise ValueError(f"not a box: {text!r}") from None
    if len(parts) != 4:
        raise ValueError("a box needs xmin,ymin,xmax,ymax")
    if parts[0] > parts[2] or parts[1] > parts[3]:
        raise ValueError("a box needs xmin <= xmax and ymin <= ymax")
    return parts


def check_condition(where: str) -> str:
    found = [w for w in FORBIDDEN if re.search(rf"\b{w}\b", where, re.IGNORECASE)]
    if found:
        raise ValueError(f"condition holds {', '.join(found)}")
    return where


def choose_columns(df: DataFrame, include: list[str] | None, exclude: list[str] | None) -> list[str]:
    """Columns in the table's order; geometry and bbox come along with an include list unless excluded."""
    keep_always = {c for c in (geometry_column(df), bbox_column(df)) if c}
    for name, given in (("columns", include), ("exclude_columns", exclude)):
        if unknown := [c for c in given or [] if c not in df.columns]:
            raise ValueError(f"{name}: no column {', '.join(unknown)}; there are {', '.join(df.columns)}")
    if both := (set(include or []) & set(exclude or [])) - keep_always:
        raise ValueError(f"both included and excluded: {', '.join(sorted(both))}")
    chosen = set(include) | keep_always if include else set(df.columns)
    return [c for c in df.columns if c in chosen - set(exclude or [])]


def extract(df: DataFrame, *, columns: list[str] | None = None, exclude_columns: list[str] | None = None, bbox=None, geometry: bytes | str | None = None, where: str | None = None, limit: int | None = None, refine: bool = False) -> DataFrame:
    """Rows whose envelope overlaps bbox (without a bbox column, or with refine: whose geometry does), whose geometry
    intersects `geometry` and for which `where` holds; the chosen columns; at most limit rows (0 is none)."""
    chosen = choose_columns(df, columns, exclude_columns)
    conditions: list[Column] = []
    geom, box = geometry_column(df), bbox_column(df)
    if bbox is not None:
        x0, y0, x1, y1 = parse_bbox(bbox)
        if box:
            conditions.append(expr.overlaps(F.col(f"`{box}`"), x0, y0, x1, y1))
        if geom and (refine or not box):
            from ..functions import udf

            conditions.append(udf.intersects_literal(F.col(f"`{geom}`"), udf.envelope_wkb(x0, y0, x1, y1)))
    if geometry is not None:
        from ..functions import udf

        conditions.append(udf.intersects_literal(F.col(f"`{geom}`"), udf.as_wkb(geometry)))
    if where:
        conditions.append(F.expr(f"({check_condition(where)})"))
    for c in conditions:
        df = df.where(c)
    df = df.select(*[F.col(f"`{c}`") for c in chosen])
    return df if limit is None else df.limit(limit)


def head(df: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """The first n rows in a stable order, if one is given."""
    return (df.orderBy(*order) if order else df).limit(n)


def tail(df: DataFrame, n: int = 10, *, order: list[str]) -> DataFrame:
    """The last n rows by order, in order; a top-n, without a sort of the whole table."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)
