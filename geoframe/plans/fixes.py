"""Repairs: what the checks ask for, as one lazy plan and one write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import columns, extract, sort
from ..sources import readers, sinks
from . import checks, metadata


def fixed(df: DataFrame, *, bbox: bool = True, order: bool = True, drop_bbox: bool = False) -> DataFrame:
    """An envelope column if there is none (or none at all, for version 2), and Hilbert order."""
    if drop_bbox and (box := extract.bbox_column(df)):
        df = df.drop(box)
    elif bbox and not extract.bbox_column(df):
        df = columns.add_bbox(df)
    return sort.sort_hilbert(df) if order else df


def apply_fixes(df: DataFrame, path: str, results: list[checks.CheckResult], *, original: dict | None = None, overwrite: bool = False) -> list[str]:
    """Write df with everything repaired that failed; the names of the checks that did."""
    failed = {r.name for r in results if not r.passed}
    v2 = original is not None and metadata.version_for(original) == "2.0"
    out = fixed(df, bbox="envelope" in failed and not v2, order="spatial order" in failed, drop_bbox="envelope" in failed and v2)
    crs = (original or {}).get("columns", {}).get((original or {}).get("primary_column"), {}).get("crs")
    sinks.write_parquet(out, path, version="2.0" if v2 else "1.1", overwrite=overwrite, original=original, crs=crs)
    return sorted(failed)


def fix_file(spark: SparkSession, path: str, output: str | None = None, *, only: list[str] | None = None) -> tuple[list[str], list[checks.CheckResult]]:
    """Check the files of path, repair what fails (or only the named checks) and check again; (what was repaired, the last results).

    Without output the path itself is replaced, once all is written.
    """
    given = checks.check_path(spark, path)
    failed = [r for r in given if not r.passed and (only is None or r.name in only)]
    if not failed:
        return [], given
    info = metadata.file_info(readers.first_file(spark, path))
    done = apply_fixes(readers.read_parquet(spark, path), output or path, failed, original=info["geo"], overwrite=output is None)
    return done, checks.check_path(spark, output or path)
