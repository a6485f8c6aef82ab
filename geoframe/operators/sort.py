"""Orders: by columns, along the Hilbert curve, by quadkey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr
from .aggregate import bounds
from .columns import add_quadkey, center


def sort_column(df: DataFrame, columns: str | list[str], descending: bool = False) -> DataFrame:
    """Nulls last either way."""
    names = columns.split(",") if isinstance(columns, str) else columns
    if unknown := [c for c in names if c not in df.columns]:
        raise ValueError(f"no column {', '.join(unknown)}")
    return df.orderBy(*[F.desc_nulls_last(c) if descending else F.asc_nulls_last(c) for c in names])


def curve_index(df: DataFrame, x: str, y: str, name: str, bits: int = expr.HILBERT_BITS) -> DataFrame:
    """Index on the Hilbert curve of the cells in columns x and y, 2 * bits bits; null for null.

    A projection a level: Spark keeps them apart, since each uses the one before several times, and fuses them in
    one generated function, while one expression for all levels would take seconds to plan.
    """
    out = df.withColumn(name, F.lit(0).cast("long"))
    for bit in range(bits - 1, -1, -1):
        out = out.withColumn(name, expr.hilbert_step(name, x, y, bit))
    return out.withColumn(name, F.shiftright(name, 2))


def add_hilbert(df: DataFrame, name: str = "hilbert") -> DataFrame:
    """Curve index of each row within the bounds of the table; a table without coordinates is an error."""
    b = bounds(df).first()
    if b is None or b["xmin"] is None:
        raise ValueError("no coordinates: the table is empty or all are null")
    x, y = center(df)
    cells = df.withColumns({"_cell_x": expr.grid(x, b["xmin"], b["xmax"]), "_cell_y": expr.grid(y, b["ymin"], b["ymax"])})
    return curve_index(cells, "_cell_x", "_cell_y", name).drop("_cell_x", "_cell_y")


def sort_hilbert(df: DataFrame) -> DataFrame:
    """Rows along the curve: a range partitioning by index, sorted within; no row goes to a single task."""
    return add_hilbert(df, "_curve").orderBy(F.asc_nulls_last("_curve")).drop("_curve")


def sort_quadkey(df: DataFrame, name: str = "quadkey", *, resolution: int = 13, use_centroid: bool = False, remove_column: bool = False) -> DataFrame:
    if name not in df.columns:
        df = add_quadkey(df, name, resolution=resolution, use_centroid=use_centroid)
    out = df.orderBy(F.asc_nulls_last(name))
    return out.drop(name) if remove_column else out


#: Ranges that place() numbers side by side, and rows, about, from which each range's bounds are told.
RANGES, DRAWN = 256, 40
#: Types of which bounds of ranges are made.
PLAIN = ("string", "binary", "boolean", "byte", "short", "integer", "long", "float", "double", "decimal", "date", "timestamp", "timestamp_ntz")


def _cuts(df: DataFrame, key: dict[str, Column], ranges: int) -> Column | None:
    """Sorted keys that cut the table into ranges of about as many rows, as a constant array; None if one range is enough.

    From the rows whose hash is a multiple of a number: the same in every run; equal keys count once.
    """
    # no filter: it would be pushed below the columns that the keys are made of, and these be repeated in it
    whole, hashed = F.struct(*[c.alias(n) for n, c in key.items()]), F.xxhash64(*key.values())
    drawn = df.select(whole.alias("_key"), hashed.alias("_hash"))
    some = F.collect_set(F.when(F.pmod("_hash", F.lit(max(1, df.count() // (DRAWN * ranges)))) == 0, F.col("_key")))
    pick = f"transform(sequence(1, least({ranges} - 1, size(s))), i -> element_at(s, cast(ceil(i * size(s) / least({ranges}, size(s) + 1)) as int)))"
    found = drawn.agg(F.sort_array(some).alias("s")).select(F.when(F.size("s") > 1, F.expr(pick)).alias("c")).first()["c"] if ranges > 1 else None
    if found is None:
        return None
    kind = drawn.schema["_key"].dataType
    # of the very type of the keys, nulls included, or each comparison would cast
    return F.sort_array(F.array(*[F.struct(*[F.lit(c[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]) for c in found]).cast(T.ArrayType(kind, False)))


def place(df: DataFrame, order: list[str], name: str = "place", ranges: int = RANGES) -> DataFrame:
    """Each row's place, from 1, in the order of the columns, nulls last; ties in any order.

    The order is cut into ranges of about as many rows, by keys of all columns (from the first that isn't a number, text, date or
    time, without it and those after it), which are fixed before rows are numbered within each range. Only rows with equal keys must
    share a range, so no task sees all rows, and tasks that run again give the same numbers. A row finds its range by halving.
    """
    key: dict[str, Column] = {}
    for i, c in enumerate(order):
        if df.schema[c].dataType.typeName() not in PLAIN:
            break
        key |= {f"n{i}": F.col(f"`{c}`").isNull(), f"v{i}": F.col(f"`{c}`")}
    if not key:
        raise ValueError(f"{order[0]} is no number, text, date or time")
    cuts, part = _cuts(df, key, ranges), F.lit(0)
    if cuts is not None:
        # the key is built once, as the value that the fold begins with: in its steps it would be built again each time
        start = F.struct(F.struct(*[c.alias(n) for n, c in key.items()]).alias("key"), F.lit(0).alias("at"))
        halves = F.array(*[F.lit(1 << b) for b in range(ranges.bit_length() - 1, -1, -1)])
        behind = lambda a, h: (a["at"] + h <= F.size(cuts)) & (F.element_at(cuts, F.least(a["at"] + h, F.size(cuts))) <= a["key"])
        part = F.aggregate(halves, start, lambda a, h: F.struct(a["key"].alias("key"), F.when(behind(a, h), a["at"] + h).otherwise(a["at"]).alias("at")), lambda a: a["at"])
    dealt = df.withColumn("_part", part)
    before, total = {}, 0
    for r in sorted(dealt.groupBy("_part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_part"]):
        before[r["_part"]], total = total, total + r["n"]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv]), F.col("_part")).cast("long")
    w = Window.partitionBy("_part").orderBy(*[F.asc_nulls_last(f"`{c}`") for c in order])
    return dealt.withColumn(name, base + F.row_number().over(w)).drop("_part")
