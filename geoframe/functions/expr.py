"""Column expressions: envelopes, tile keys and curve indexes.  No Python at run time; all of it is code-generated."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BBOX_FIELDS = ("xmin", "ymin", "xmax", "ymax")
#: Latitude at which the square of the web map ends, and the nudge with which tiles are cut (fixed values).
MAX_LATITUDE, TILE_EPSILON = 85.0511287798066, 1e-14
HILBERT_BITS = 16


def bbox_struct(xmin, ymin, xmax, ymax) -> Column:
    """Envelope as a struct of doubles."""
    return F.struct(*[F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for n, c in zip(BBOX_FIELDS, (xmin, ymin, xmax, ymax))])


def overlaps(bbox: Column, xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    """Closed overlap of an envelope with a box; each comparison reaches the Parquet scan."""
    return (bbox["xmax"] >= xmin) & (bbox["xmin"] <= xmax) & (bbox["ymax"] >= ymin) & (bbox["ymin"] <= ymax)


def both_overlap(a: Column, b: Column) -> Column:
    return (a["xmax"] >= b["xmin"]) & (a["xmin"] <= b["xmax"]) & (a["ymax"] >= b["ymin"]) & (a["ymin"] <= b["ymax"])


def middle(bbox: Column) -> tuple[Column, Column]:
    return (bbox["xmin"] + bbox["xmax"]) / 2, (bbox["ymin"] + bbox["ymax"]) / 2


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the web-map tile of a point; points beyond the map belong to its edge tiles."""
    n = 1 << zoom
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))))
    fx = lon / 360.0 + 0.5
    fy = 0.5 - 0.25 * F.log((1.0 + s) / (1.0 - s)) / math.pi
    cut = lambda f: F.when(f <= 0, 0).when(f >= 1, n - 1).otherwise(F.least(F.floor((f + TILE_EPSILON) * n), F.lit(n - 1))).cast("int")
    return F.when(lon.isNotNull(), cut(fx)), F.when(lat.isNotNull(), cut(fy))


def quadkey(lon: Column, lat: Column, zoom: int) -> Column:
    """Base-4 path of the tile of a point, one digit a level; null for null coordinates; '' at level 0."""
    if not 0 <= zoom <= 23:
        raise ValueError("resolution must be between 0 and 23")
    x, y = tile(lon, lat, zoom)
    # the binary digits of x and twice those of y, read as decimal numbers, add up without a carry
    kind = "long" if zoom <= 18 else "decimal(25,0)"
    digits = (F.bin(x).cast(kind) + F.bin(y).cast(kind) * F.lit(2).cast(kind)).cast("string")
    return F.lpad(digits, zoom, "0") if zoom else F.when(x.isNotNull() & y.isNotNull(), F.lit(""))


def _hilbert_tables() -> tuple[int, int]:
    """Digits and next states, two bits each, by 4 * state + 2 * xbit + ybit. A state is (swapped, mirrored)."""
    digits = after = place = 0
    for swap in (0, 1):
        for mirror in (0, 1):
            for bx in (0, 1):
                for by in (0, 1):
                    x, y = bx ^ mirror, by ^ mirror
                    x, y = (y, x) if swap else (x, y)
                    digits |= ((3 * x) ^ y) << place
                    after |= (2 * (swap ^ (y == 0)) + (mirror ^ (y == 0 and x == 1))) << place
                    place += 2
    return digits, after


def grid(v: Column, lo: float, hi: float, bits: int = HILBERT_BITS) -> Column:
    """Cell of v among 2**bits between lo and hi; beyond them the outermost ones; null for null."""
    top = (1 << bits) - 1
    if not hi > lo:
        return F.when(v.isNotNull(), F.lit(0).cast("long"))
    return F.least(F.greatest(F.floor((v - lo) / (hi - lo) * top), F.lit(0)), F.lit(top)).cast("long")


def hilbert_step(carry: str, x: str, y: str, bit: int) -> Column:
    """One level down the Hilbert curve. carry holds the index so far and, in its lowest two bits, the state.

    A level is a shift of a packed table by the state and a bit of each coordinate: arithmetic only. The arguments
    are names of columns. As SQL text, since a level by calls takes several times as long to build.
    """
    digits, after = _hilbert_tables()
    at = f"cast((`{carry}` & 3) * 8 + (shiftright(`{x}`, {bit}) & 1) * 4 + (shiftright(`{y}`, {bit}) & 1) * 2 as int)"
    return F.expr(f"shiftleft(`{carry}` - (`{carry}` & 3) + (shiftright({digits}L, {at}) & 3), 2) + (shiftright({after}L, {at}) & 3)")
