"""Aggregates: bounds, column statistics, partition analysis, results of joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import bbox_column, geometry_column

#: Limits of a sensible partitioning (fixed values).
MAX_PARTITIONS, MIN_ROWS, MAX_IMBALANCE, WARN_IMBALANCE, WARN_PARTITIONS, WARN_ROWS = 10_000, 100, 1000.0, 100.0, 1000, 10_000


def _envelope(df: DataFrame) -> Column:
    box, geom = bbox_column(df), geometry_column(df)
    if box:
        return F.col(f"`{box}`")
    if geom:
        from ..functions import udf

        return udf.envelope(F.col(f"`{geom}`"))
    return F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))


def bounds(df: DataFrame) -> DataFrame:
    """One row: xmin, ymin, xmax, ymax of all envelopes; nulls if there are none."""
    e = df.select(_envelope(df).alias("e"))
    return e.agg(F.min("e.xmin").alias("xmin"), F.min("e.ymin").alias("ymin"), F.max("e.xmax").alias("xmax"), F.max("e.ymax").alias("ymax"))


def stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """A row for each column: nulls, least and largest value as text, distinct values (approximate unless exact).

    One pass over the table for all columns; geometries, structs and lists have nulls only.
    """
    simple = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("binary", "struct", "array", "map")]
    count = F.count_distinct if exact else F.approx_count_distinct
    parts = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count_if(col.isNull()).alias("nulls"), *([F.min(col).cast("string").alias("min"), F.max(col).cast("string").alias("max"), count(col).alias("n_unique")] if c in simple else [F.lit(None).cast("string").alias("min"), F.lit(None).cast("string").alias("max"), F.lit(None).cast("long").alias("n_unique")])))
    return df.agg(F.array(*parts).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def partition_key(column: str, prefix: int | None = None) -> Column:
    return F.col(f"`{column}`") if prefix is None else F.left(F.col(f"`{column}`"), F.lit(prefix))


def partition_preview(df: DataFrame, column: str, prefix: int | None = None, limit: int | None = 15) -> DataFrame:
    """The largest partitions: value and rows, nulls left out."""
    out = df.select(partition_key(column, prefix).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "value")
    return out if limit is None else out.limit(limit)


def partition_statistics(df: DataFrame, column: str, prefix: int | None = None) -> DataFrame:
    """One row: partitions, rows, least, largest, mean and median rows of a partition."""
    counts = df.select(partition_key(column, prefix).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_partitions"), F.sum("n").alias("total_rows"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.avg("n").alias("avg_rows"), F.median("n").alias("median_rows"))


@dataclass
class PartitionReport:
    statistics: dict
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    recommendations: list[str] = field(default_factory=list)


def analyze_partitions(df: DataFrame, column: str, prefix: int | None = None, bytes_per_row: float = 1000.0) -> PartitionReport:
    """What speaks against partitioning by this key."""
    s = partition_statistics(df, column, prefix).first().asDict()
    report = PartitionReport(s)
    n = s["n_partitions"]
    if not n:
        report.errors.append(f"{column} holds no values")
        return report
    imbalance = s["max_rows"] / s["median_rows"]
    if n > MAX_PARTITIONS:
        report.errors.append(f"{n} partitions, more than {MAX_PARTITIONS}")
    if s["avg_rows"] < MIN_ROWS:
        report.errors.append(f"{s['avg_rows']:.0f} rows a partition, fewer than {MIN_ROWS}")
    if s["avg_rows"] * bytes_per_row / 1e6 < 0.001:
        report.errors.append("under 0.001 MB a partition")
    if imbalance > MAX_IMBALANCE:
        report.errors.append(f"the largest partition has {imbalance:.0f} times the median rows")
    elif imbalance >= WARN_IMBALANCE:
        report.warnings.append(f"the largest partition has {imbalance:.0f} times the median rows")
    if WARN_PARTITIONS <= n <= MAX_PARTITIONS:
        report.warnings.append(f"{n} partitions")
    if MIN_ROWS <= s["avg_rows"] < WARN_ROWS:
        report.warnings.append(f"{s['avg_rows']:.0f} rows a partition")
    if n > 1 and s["max_rows"] > 0.5 * s["total_rows"]:
        report.warnings.append("one partition holds over half of the rows")
    report.recommendations += advice(n, s["total_rows"], s["avg_rows"], s["max_rows"], imbalance, prefix is not None)
    return report


#: Thresholds of the advice (fixed values): small tables, many and small partitions, large ones, sensible numbers.
FEW_ROWS, MANY, SMALL, LARGE, LARGEST, UNEVEN, MILLION, FEW, TOO_MANY = 1000, 1000, 10_000, 1_000_000, 10_000_000, 5, 1_000_000, 5, 5000
SENSIBLE, SENSIBLE_ROWS = (10, 500), (10_000, 5_000_000)


def advice(n: int, rows: int, mean: float, most: int, imbalance: float, by_prefix: bool) -> list[str]:
    """What to do about n partitions with so many rows in all, on average and at most."""
    if rows < FEW_ROWS:
        return [f"{rows} rows are too few to be partitioned: one file is better"]
    found = {
        "leave it in one file with an envelope column: these would be many small ones": n > MANY and mean < SMALL,
        "a longer prefix or more levels: these partitions are large": by_prefix and mean > LARGE,
        "partition by a coarser key first: the largest partition is large and far above the others": most > LARGEST and imbalance > UNEVEN,
        f"sensible: {n} partitions of about {mean:.0f} rows": SENSIBLE[0] <= n <= SENSIBLE[1] and SENSIBLE_ROWS[0] <= mean <= SENSIBLE_ROWS[1],
        f"a finer key: {n} partitions are few for {rows} rows": n < FEW and rows > MILLION,
        "partition by a coarser key first: these are too many at one level": n > TOO_MANY,
    }
    return [text for text, holds in found.items() if holds]
