"""Spatial left join of features with boundaries, and what is made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr
from .extract import bbox_column, geometry_column

#: Boundaries, their bytes and the cells they cover that may be broadcast; beyond any of these both sides are shuffled by cell.
BROADCAST_ROWS, BROADCAST_BYTES, BROADCAST_CELLS = 20_000, 64 << 20, 2_000_000
#: Cells of a grid are BASE times as wide as those of the grid before; the finest is BASE ** FINEST wide.
BASE, FINEST = 8.0, -9
#: Parts that the rows of one cell are dealt to where both sides are shuffled.
SALTS = 8


def _grade(box: Column) -> Column:
    """The least grade whose cells are at least as wide as the box; null if it isn't finite."""
    width = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    finite = F.greatest(*[F.abs(box[n]) for n in expr.BBOX_FIELDS]) < 1e15  # false for NaN, too
    return F.when(finite, F.greatest(F.ceil(F.log(width) / F.log(F.lit(BASE))), F.lit(FINEST)).cast("int"))


def _cell_size(left_grade: Column, side_grade: int) -> Column:
    return F.pow(F.lit(BASE), F.greatest(left_grade, F.lit(side_grade - 1)))


def _cells(side: DataFrame, grade: int, left_grades: list[int], payload: Column, salts: int) -> DataFrame:
    """g, i, j, s, m: the boundaries of one grade that a box of grade g whose lower corner lies in cell (i, j) may touch.

    A boundary counts for the cells it covers and, since a box reaches up from its corner, those as far below as
    such a box is wide: a hundred at most.
    """
    r = side.where(F.col("_grade") == grade).withColumn("g", F.explode(F.array(*[F.lit(g) for g in left_grades])))
    size, reach = _cell_size(F.col("g"), grade), F.pow(F.lit(BASE), F.col("g")) * 1.000001
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - reach) / size), F.floor(F.col(hi) / size)))
    r = r.withColumn("i", span("_rb.xmin", "_rb.xmax")).withColumn("j", span("_rb.ymin", "_rb.ymax"))
    r = r.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0))
    return r.groupBy("g", "i", "j", "s").agg(F.collect_list(payload).alias("m"))


def spatial_left_join(left: DataFrame, right: DataFrame, columns: dict[str, str], *, exact: bool = True, prefilter: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of left with the named columns (new name: column) of each boundary it touches; nulls without one.

    Both need an envelope column; with exact and geometries on both sides, candidates are tested exactly.  Boundaries
    outside the extent of left go first.  Each row looks up the cell of its lower corner, in a grid for each order of
    boundary size, in lists of boundaries by cell: equi-joins that keep rows as they are, so left is scanned once, needs no
    row identity and is shuffled only if the boundaries are too large, by their own size, to be broadcast.
    """
    lb, rb = bbox_column(left), bbox_column(right)
    lg, rg = geometry_column(left), geometry_column(right)
    if not lb or not rb:
        raise ValueError("both sides need an envelope column")
    refine = exact and lg and rg
    box = F.col(f"`{lb}`")
    side = right.select(F.col(f"`{rb}`").alias("_rb"), *([F.col(f"`{rg}`").alias("_rg")] if refine else []), *[F.col(f"`{c}`").alias(n) for n, c in columns.items()])
    side = side.withColumn("_grade", _grade(F.col("_rb"))).where("_grade is not null")
    extent = left.agg(F.min(box["xmin"]).alias("xmin"), F.min(box["ymin"]).alias("ymin"), F.max(box["xmax"]).alias("xmax"), F.max(box["ymax"]).alias("ymax"), F.collect_set(_grade(box)).alias("grades")).first()
    if prefilter and extent["xmin"] is not None:
        side = side.where(expr.overlaps(F.col("_rb"), extent["xmin"], extent["ymin"], extent["xmax"], extent["ymax"]))
    kinds = {f.name: f.dataType for f in side.schema.fields}
    known = side.agg(F.count("*").alias("n"), F.sum(F.lit(200) + (F.length("_rg") if refine else F.lit(0))).alias("size"), F.collect_set("_grade").alias("grades")).first()
    if not known["n"] or not extent["grades"]:
        return left.select(*left.columns, *[F.lit(None).cast(kinds[n]).alias(n) for n in columns])
    few = known["n"] <= BROADCAST_ROWS and known["size"] <= broadcast_bytes
    if few:
        spark = left.sparkSession
        rows = side.collect()
        side = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("_b", T.IntegerType()), *side.schema.fields]))
    payload = F.struct("_b", "_rb") if few else F.struct(*[F.col(f"`{c}`") for c in side.columns if c != "_grade"])
    salts = 1 if few else SALTS
    lists = {g: _cells(side, g, sorted(extent["grades"]), payload, salts) for g in sorted(known["grades"])}
    if few and sum(x.agg(F.sum(F.size("m"))).first()[0] or 0 for x in lists.values()) <= BROADCAST_CELLS:
        lists = {g: F.broadcast(x) for g, x in lists.items()}
    plain = [c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    out = left.withColumns({"_g": _grade(box), "_s": F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)})
    for k, (grade, cells) in enumerate(lists.items()):
        size = _cell_size(F.col("_g"), grade)
        out = out.withColumns({"_i": F.floor(box["xmin"] / size), "_j": F.floor(box["ymin"] / size)})
        cells = cells.select(*[F.col(c).alias(f"_{c}{k}") for c in ("g", "i", "j", "s", "m")])
        out = out.join(cells, (F.col("_g") == F.col(f"_g{k}")) & (F.col("_i") == F.col(f"_i{k}")) & (F.col("_j") == F.col(f"_j{k}")) & (F.col("_s") == F.col(f"_s{k}")), "left").drop(*[f"_{c}{k}" for c in "gijs"])
    near = F.flatten(F.array_compact(F.array(*[F.col(f"_m{k}") for k in range(len(lists))])))
    out = out.withColumn("_near", F.filter(near, lambda x: expr.both_overlap(box, x["_rb"])))
    if refine:
        from ..functions import udf

        if few:
            shared = spark.sparkContext.broadcast([r["_rg"] for r in rows])
            met = udf.intersects_some(F.col(f"`{lg}`"), F.transform("_near", lambda x: x["_b"]), shared)
        else:
            met = udf.intersects_some(F.col(f"`{lg}`"), F.transform("_near", lambda x: x["_rg"]))
        out = out.withColumn("_met", met).withColumn("_near", F.filter("_near", lambda x, i: F.col("_met")[i]))
    own = [F.col(f"`{c}`") for c in left.columns]
    out = out.select(*own, F.explode_outer("_near").alias("_x"))
    if not few:
        return out.select(*own, *[F.col(f"_x.`{n}`").alias(n) for n in columns])
    return out.join(F.broadcast(side.select("_b", *columns)), F.col("_x._b") == F.col("_b"), "left").select(*own, *columns)


def region_code(column: str) -> Column:
    """US-CA gives CA; a code without a dash stays."""
    c = F.col(column)
    return F.when(c.contains("-"), F.split_part(c, F.lit("-"), F.lit(2))).otherwise(c)


#: Levels of the known boundary sets and their source columns (fixed values).
ADMIN = {
    "current": {"country": "country"},
    "gaul": {"continent": "continent", "country": "gaul0_name", "department": "gaul2_name"},
    "overture": {"country": "country", "region": "region"},
}
OVERTURE_NAMES = {"country": "admin:country_code", "region": "admin:subdivision_code"}


def add_admin_divisions(df: DataFrame, boundaries: DataFrame, *, dataset: str = "gaul", levels: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Admin columns of the boundaries that a feature touches; one that touches k of them comes k times."""
    known = ADMIN[dataset]
    levels = levels or list(known)
    if unknown := [x for x in levels if x not in known]:
        raise ValueError(f"{dataset} has no level {', '.join(unknown)}; it has {', '.join(known)}")
    if dataset == "overture":
        boundaries = boundaries.where(F.col("subtype").isin(levels)) if "subtype" in boundaries.columns else boundaries
        if "region" in levels:
            boundaries = boundaries.withColumn("region", region_code("region"))
    names = OVERTURE_NAMES if dataset == "overture" else {x: f"admin:{x}" for x in known}
    return spatial_left_join(df, boundaries, {names[x]: known[x] for x in levels}, exact=exact)


def join_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, rows with a match, and distinct values of each column."""
    return df.agg(F.count("*").alias("total"), F.count(F.col(f"`{columns[0]}`")).alias("matched"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(columns)])
