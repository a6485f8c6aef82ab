"""Quality checks: spatial order, row groups, compression, envelope column and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udf, wkb
from ..operators.extract import geometry_column
from . import metadata


@dataclass
class CheckResult:
    name: str
    passed: bool
    failures: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    recommendations: list[str] = field(default_factory=list)
    details: dict = field(default_factory=dict)

    def __bool__(self) -> bool:
        return self.passed


def consecutive_distance(df: DataFrame, order: list[str]) -> DataFrame:
    """One row: the mean distance of consecutive geometries, those without one left out.

    Dealt by ranges of the order: a task adds up its own distances and tells its first and last geometry, from which the
    distances from range to range are taken, one a task.
    """
    g = geometry_column(df)
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)], F.col(f"`{g}`").alias("g"))
    keys = [f"k{i}" for i in range(len(order))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        total, n = 0.0, 0
        for b in batches:
            found = [wkb.parse(x) for x in b["g"] if x is not None]
            for now in found:
                d = None if last is None else wkb.distance(last, now)
                if d is not None:
                    total, n = total + d, n + 1
                first, last = first or now, now
        if first is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "total": [total], "n": [n], "first": [wkb.encode(first)], "last": [wkb.encode(last)]})

    udf.ship(df.sparkSession)
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("g")
    parts = sorted(dealt.mapInPandas(run, "part int, total double, n long, first binary, last binary").collect(), key=lambda r: r["part"])
    steps = [wkb.distance(wkb.parse(bytes(a["last"])), wkb.parse(bytes(b["first"]))) for a, b in zip(parts, parts[1:])]
    steps = [d for d in steps if d is not None]
    n = sum(p["n"] for p in parts) + len(steps)
    mean = (sum(p["total"] for p in parts) + sum(steps)) / n if n else None
    return df.sparkSession.createDataFrame([(mean,)], "avg_distance double")


def random_distance(df: DataFrame, order: list[str], sample: int = 100) -> DataFrame:
    """One row: the mean distance between two samples of at most `sample` rows, equal geometries left out."""
    g = geometry_column(df)
    one, two = (df.orderBy(F.xxhash64(*order, F.lit(seed)), *order).limit(sample).select(F.col(f"`{g}`").alias(c)) for seed, c in ((1, "a"), (2, "b")))
    return one.join(two, F.col("a") != F.col("b")).agg(F.avg(udf.distance(F.col("a"), F.col("b"))).alias("avg_distance"))


def check_spatial_order(df: DataFrame, order: list[str], sample: int = 100, rows: int | None = None) -> CheckResult:
    """Consecutive rows (the first `rows` of them, or all) should be nearer than random ones: the ratio should be under one half."""
    part = df if rows is None else df.orderBy(*order).limit(rows)
    near, far = consecutive_distance(part, order).first()[0], random_distance(part, order, sample).first()[0]
    ratio = near / far if near and far else None
    good = ratio is not None and ratio < 0.5
    return CheckResult("spatial order", good, [] if good else ["rows aren't in spatial order"], recommendations=[] if good else ["sort along the Hilbert curve"], details={"ratio": ratio, "consecutive": near, "random": far})


def assess_row_group_size(avg_bytes: float, total_bytes: float) -> str:
    """optimal, suboptimal or poor; small files are always optimal."""
    mb = avg_bytes / 2**20
    if total_bytes < 64 * 2**20 or 64 <= mb <= 256:
        return "optimal"
    return "suboptimal" if 32 <= mb < 64 or 256 < mb <= 512 else "poor"


def assess_row_count(avg_rows: float) -> str:
    if avg_rows < 2000 or avg_rows > 1_000_000:
        return "poor"
    return "optimal" if 10_000 <= avg_rows <= 200_000 else "suboptimal"


def check_row_groups(info: dict) -> CheckResult:
    """info: of metadata.file_info()."""
    n = max(1, info["row_groups"])
    size = assess_row_group_size(info["size"] / n, info["size"])
    count = assess_row_count(info["rows"] / n) if info["size"] >= 64 * 2**20 else "optimal"
    bad = [f"row group {what}: {v}" for what, v in (("size", size), ("rows", count)) if v == "poor"]
    return CheckResult("row groups", not bad, bad, [f"row group {what}: {v}" for what, v in (("size", size), ("rows", count)) if v == "suboptimal"], ["write row groups of 64 to 256 MB"] if bad else [], {"size": size, "rows": count})


def check_compression(info: dict, geometry: str) -> CheckResult:
    codec = info["codecs"].get(geometry, "none")
    good = codec == "ZSTD"
    return CheckResult("compression", good, [] if good else [f"{geometry} is compressed with {codec}"], recommendations=[] if good else ["rewrite with ZSTD"], details={"codec": codec})


def check_bbox(info: dict) -> CheckResult:
    """Version 1.1 should have an envelope column and say so in its metadata."""
    meta, box = info.get("geo"), info.get("bbox_column")
    if not meta:
        return CheckResult("envelope", False, ["no geo metadata"], recommendations=["write with geo metadata"])
    primary = meta["columns"].get(meta.get("primary_column"), {})
    bad = []
    if meta["version"] < "1.1.0":
        bad.append(f"version {meta['version']}, older than 1.1.0")
    if meta["version"] < "2":
        if not box:
            bad.append("no envelope column")
        elif "bbox" not in primary.get("covering", {}):
            bad.append("the envelope column isn't in the metadata")
    elif box:
        bad.append("an envelope column isn't needed from version 2 on")
    return CheckResult("envelope", not bad, bad, details={"bbox_column": box})


def check_info(info: dict) -> list[CheckResult]:
    """All checks of one file that its footer can tell."""
    geometry = (info["geo"] or {}).get("primary_column") or next(iter(info["native"]), "geometry")
    found = [check_row_groups(info), check_compression(info, geometry)]
    if metadata.file_kind(info) == "native":
        box = info["bbox_column"]
        return [*found, CheckResult("envelope", not box, [f"{box} isn't needed beside native geometry types"] if box else [], details={"bbox_column": box})]
    return [*found, check_bbox(info)]


def check_path(spark: SparkSession, path: str, *, files: int | None = None) -> list[CheckResult]:
    """The checks over all files of path (or the first so many): passed if all pass, with each file's failures."""
    from ..sources import readers

    paths = [p for p, _ in readers.files_of(spark, path)][:files]
    if not paths:
        raise FileNotFoundError(f"no Parquet file in {path}")
    merged: dict[str, CheckResult] = {}
    for p in paths:
        for c in check_info(metadata.file_info(p)):
            m = merged.setdefault(c.name, CheckResult(c.name, True, details={"files": 0}))
            m.passed &= c.passed
            m.failures += [f"{p}: {x}" for x in c.failures]
            m.warnings += [f"{p}: {x}" for x in c.warnings]
            m.recommendations += [x for x in c.recommendations if x not in m.recommendations]
            m.details["files"] += 1
    return list(merged.values())


def validate_data(df: DataFrame, info: dict) -> list[tuple[str, bool, str]]:
    """(rule, kept, what is wrong) of the geometries themselves against the metadata, in one aggregate over all rows."""
    geo = info["geo"] or {}
    name = geo.get("primary_column") or geometry_column(df)
    told = geo.get("columns", {}).get(name, {})
    g = F.col(f"`{name}`")
    f = df.select(g.alias("g"), udf.facts(g).alias("f"))
    e = F.col("f.envelope")
    got = f.agg(
        F.count("g").alias("n"),
        F.count_if(F.col("g").isNotNull() & F.col("f.kind").isNull()).alias("bad"),
        F.collect_set("f.kind").alias("kinds"),
        F.count_if(~F.col("f.oriented")).alias("turned"),
        *[(F.min if k.endswith("min") else F.max)(e[k]).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")],
    ).first()
    out = [("well-formed", not got["bad"], f"{got['bad']} of {got['n']} geometries can't be read" if got["bad"] else "")]
    types = told.get("geometry_types")
    extra = sorted(set(got["kinds"]) - set(types or got["kinds"]))
    out.append(("geometry types", not extra, f"not declared: {', '.join(extra)}" if extra else ""))
    if told.get("orientation"):
        out.append(("orientation", not got["turned"], f"{got['turned']} polygons are turned" if got["turned"] else ""))
    box = told.get("bbox")
    if box and got["xmin"] is not None:
        x0, y0, x1, y1 = box if len(box) == 4 else (box[0], box[1], box[3], box[4])
        within = (x0 <= got["xmin"] or x0 > x1) and y0 <= got["ymin"] and (got["xmax"] <= x1 or x0 > x1) and got["ymax"] <= y1
        out.append(("bounds", within, "" if within else f"geometries reach {got['xmin']}, {got['ymin']}, {got['xmax']}, {got['ymax']}"))
    if got["xmin"] is not None and metadata.is_geographic(told.get("crs")):
        small = -360 <= got["xmin"] and got["xmax"] <= 360 and -90 <= got["ymin"] and got["ymax"] <= 90
        out.append(("coordinates are degrees", small, "" if small else "they lie beyond those of longitude and latitude"))
    return out
