"""What files hold: summaries of one file and of many, previews, reports as text or Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udf
from ..operators.extract import geometry_column
from . import metadata


def summary(path: str) -> dict:
    info = metadata.file_info(path)
    meta = info["geo"] or {}
    column = (meta.get("columns") or {}).get(meta.get("primary_column"), {})
    return {**{k: info[k] for k in ("path", "rows", "row_groups", "size", "columns", "codecs")}, "version": meta.get("version"), "geometry": meta.get("primary_column"), "crs": metadata.crs_code(column.get("crs")) if meta else None, "bounds": column.get("bbox"), "geometry_types": column.get("geometry_types")}


def merged(paths: list[str]) -> dict:
    """Totals, common bounds, and whether schemas, versions and systems agree."""
    all_of = [summary(p) for p in paths]
    if not all_of:
        raise ValueError("no files")
    boxes = [s["bounds"] for s in all_of if s["bounds"]]
    return {
        "files": len(all_of),
        "rows": sum(s["rows"] for s in all_of),
        "size": sum(s["size"] for s in all_of),
        "bounds": [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)] if boxes else None,
        "same_schema": len({tuple(s["columns"].items()) for s in all_of}) == 1,
        "versions": sorted({str(s["version"]) for s in all_of}),
        "crs": sorted({str(s["crs"]) for s in all_of}),
        "codecs": sorted({c for s in all_of for c in s["codecs"].values()}),
    }


def preview(df: DataFrame, n: int = 10, width: int = 45) -> DataFrame:
    """The first n rows with the geometry as text, cut to width."""
    g = geometry_column(df)
    out = df.limit(n)
    if g is None:
        return out
    text = udf.as_text(F.col(f"`{g}`"))
    return out.withColumn(g, text).withColumn(g, F.when(F.length(g) > width, F.concat(F.left(F.col(g), F.lit(width)), F.lit("..."))).otherwise(F.col(g)))


def markdown(s: dict) -> str:
    """A summary as a Markdown table."""
    rows = [f"| {k} | {v} |" for k, v in s.items() if k != "columns"]
    names = [f"| {k} | {v} |" for k, v in s.get("columns", {}).items()]
    return "\n".join(["| what | value |", "|-|-|", *rows, *(["", "| column | type |", "|-|-|", *names] if names else [])])
