"""Shapefiles, one set of local files: records are coded and decoded by tasks, the driver joins their parts."""

from __future__ import annotations

import datetime
import mmap
import os
import struct
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udf, wkb
from ..operators.extract import geometry_column
from ..plans.metadata import is_geographic
from . import parts

POINT, LINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
#: Records that a task reads at once.
ROWS = 20_000
#: Shape type by geometry kind, and the system that is written (fixed values).
SHAPE = {1: POINT, 2: LINE, 5: LINE, 3: POLYGON, 6: POLYGON, 4: MULTIPOINT}
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


def _clockwise(ring: np.ndarray) -> bool:
    return wkb._ring_area(ring)[0] < 0


def _parts(g: wkb.Geometry) -> list[np.ndarray]:
    """Lines or rings; outer rings clockwise, holes against."""
    out = []
    for p in g.leaves():
        if p.kind == 3:
            out += [r[:, :2] if _clockwise(r) == (i == 0) else r[::-1, :2] for i, r in enumerate(p.body)]
        else:
            out.append(p.body[:, :2])
    return out


def encode(g: wkb.Geometry | None) -> bytes:
    """Content of one record; no geometry is the null shape."""
    if g is None or not len(g.coords()):
        return struct.pack("<i", 0)
    kind, box = SHAPE[g.kind], wkb.envelope(g)
    if kind == POINT:
        return struct.pack("<idd", POINT, *g.body[0, :2])
    c = g.coords()
    if kind == MULTIPOINT:
        return struct.pack("<i4di", kind, *box, len(c)) + c.astype("<f8").tobytes()
    parts = _parts(g)
    starts = np.cumsum([0, *map(len, parts)])[:-1].astype("<i4")
    points = np.concatenate(parts)
    return struct.pack("<i4dii", kind, *box, len(parts), len(points)) + starts.tobytes() + points.astype("<f8").tobytes()


def decode(content: bytes) -> wkb.Geometry | None:
    (kind,) = struct.unpack_from("<i", content)
    kind %= 10  # Z and M variants hold x and y in the same places
    if kind == 0:
        return None
    if kind == POINT:
        return wkb.point(*struct.unpack_from("<dd", content, 4))
    if kind == MULTIPOINT:
        (n,) = struct.unpack_from("<i", content, 36)
        return wkb.Geometry(4, [wkb.point(*p) for p in np.frombuffer(content, "<f8", 2 * n, 40).reshape(-1, 2)])
    m, n = struct.unpack_from("<ii", content, 36)
    starts = [*np.frombuffer(content, "<i4", m, 44).tolist(), n]
    points = np.frombuffer(content, "<f8", 2 * n, 44 + 4 * m).reshape(-1, 2)
    rings = [points[a:b].copy() for a, b in zip(starts, starts[1:])]
    if kind == LINE:
        lines = [wkb.Geometry(2, r) for r in rings]
        return lines[0] if len(lines) == 1 else wkb.Geometry(5, lines)
    outer = [[r] for r in rings if _clockwise(r)] or [[rings[0]]]
    for r in rings:
        if not _clockwise(r) and r is not outer[0][0]:
            home = next((o for o in outer if wkb.in_rings(r[:1, 0], r[:1, 1], [o[0]])[0]), outer[-1])
            home.append(r)
    polygons = [wkb.Geometry(3, o) for o in outer]
    return polygons[0] if len(polygons) == 1 else wkb.Geometry(6, polygons)


def _dbf_field(name: str, kind: str) -> tuple[bytes, str, int, int]:
    base = name.encode("utf-8")[:10]
    return (base, "N", 20, 0) if kind in ("long", "integer", "short", "byte") else (base, "F", 24, 10) if kind in ("double", "float") else (base, "L", 1, 0) if kind == "boolean" else (base, "D", 8, 0) if kind == "date" else (base, "C", 254, 0)


def _dbf_value(v, kind: str, width: int, decimals: int) -> bytes:
    if v is None:
        return b" " * width if kind != "L" else b"?"
    if kind == "N":
        return str(v).rjust(width).encode()[:width]
    if kind == "F":
        text = f"{v:.{decimals}f}"
        return (text if len(text) <= width else f"{v:.15e}").rjust(width).encode()[:width]
    if kind == "L":
        return b"T" if v else b"F"
    if kind == "D":
        return v.strftime("%Y%m%d").encode()
    raw = str(v).encode("utf-8")[:width]
    return raw.decode("utf-8", "ignore").encode().ljust(width)


def write_shapefile(df: DataFrame, path: str, *, overwrite: bool = False, zipped: bool = False, crs: str | None = None) -> None:
    """path.shp, .shx, .dbf, .cpg and, for longitude and latitude (also where crs is None), .prj. One kind of geometry; structs, lists and maps are left out; texts are cut at
    254 bytes and names at 10, which must still differ."""
    stem = path.removesuffix(".shp")
    if os.path.exists(f"{stem}.shp") and not overwrite:
        raise FileExistsError(f"{stem}.shp is there already")
    geom = geometry_column(df)
    kinds = {SHAPE.get(wkb.KINDS[r[0]]) for r in df.select(udf.geometry_type(F.col(f"`{geom}`")).alias("k")).where("k is not null").distinct().collect()}
    if len(kinds) > 1 or None in kinds:
        raise ValueError("a shapefile holds points, lines, polygons or multipoints, not a mixture")
    plain = [f for f in df.schema.fields if f.name != geom and f.dataType.typeName() not in ("struct", "array", "map", "binary")]
    fields = [_dbf_field(f.name, f.dataType.typeName()) for f in plain]
    if len({f[0] for f in fields}) < len(fields):
        raise ValueError("names must differ within 10 bytes")
    chosen = df.select(*[F.col(f"`{c}`") for c in (geom, *[f.name for f in plain])])

    def code(batches: Iterator[pa.RecordBatch], new: Callable[[], str]) -> Iterator[tuple]:
        """Records numbered from 1 and their index from 0 within a part, attributes; path, rows, bytes of records, envelope."""
        shp, shx, dbf, box, at, size = [], [], [], None, 0, 0

        def close() -> tuple:
            path = new()
            for suffix, held in (("shp", shp), ("shx", shx), ("dbf", dbf)):
                parts.put(f"{path}.{suffix}", b"".join(held))
            return path, len(shp), 2 * at, *(map(float, box) if box else (None,) * 4)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                g = wkb.parse(row[0]) if row[0] is not None else None
                content = encode(g)
                shp.append(struct.pack(">ii", len(shp) + 1, len(content) // 2) + content)
                shx.append(struct.pack(">ii", at, len(content) // 2))
                at += 4 + len(content) // 2
                e = wkb.envelope(g) if g else None
                if e:
                    box = e if box is None else (min(box[0], e[0]), min(box[1], e[1]), max(box[2], e[2]), max(box[3], e[3]))
                dbf.append(b" " + b"".join(_dbf_value(v, f[1], f[2], f[3]) for v, f in zip(row[1:], fields)))
                size += len(shp[-1]) + len(dbf[-1])
                if size >= parts.PART:
                    yield close()
                    shp, shx, dbf, box, at, size = [], [], [], None, 0, 0
        if shp:
            yield close()

    box, n, at = None, 0, 50
    told = "path string, n long, size long, xmin double, ymin double, xmax double, ymax double"
    with parts.written(chosen, told, code) as found, open(f"{stem}.shp", "wb") as shp, open(f"{stem}.shx", "wb") as shx, open(f"{stem}.dbf", "wb") as dbf:
        shp.write(b"\0" * 100)
        shx.write(b"\0" * 100)
        head = 33 + 32 * len(fields)
        dbf.write(b"\0" * 32)
        for name, kind, width, decimals in fields:
            dbf.write(name.ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, decimals]) + b"\0" * 14)
        dbf.write(b"\r")
        for path_, rows, size, *e in found:
            # a part's records and places become those of the file
            records, index = np.frombuffer(parts.whole(f"{path_}.shp"), np.uint8).copy(), np.frombuffer(parts.whole(f"{path_}.shx"), ">i4").reshape(-1, 2).astype(np.int64)
            records[(2 * index[:, :1] + np.arange(4))] = np.arange(n + 1, n + rows + 1).astype(">i4").view(np.uint8).reshape(-1, 4)
            shp.write(records.tobytes())
            if at + size // 2 >= 1 << 31:
                raise ValueError("a shapefile holds at most 4 GB of records")
            shx.write((index + [at, 0]).astype(">i4").tobytes())
            dbf.writelines(parts.pieces(f"{path_}.dbf"))
            n, at = n + rows, at + size // 2
            if e[0] is not None:
                box = tuple(e) if box is None else (min(box[0], e[0]), min(box[1], e[1]), max(box[2], e[2]), max(box[3], e[3]))
        dbf.write(b"\x1a")
        for f, words in ((shp, at), (shx, 50 + 4 * n)):
            f.seek(0)
            f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, next(iter(kinds), 0), *(box or (0, 0, 0, 0)), 0, 0, 0, 0))
        today = datetime.date.today()
        dbf.seek(0)
        dbf.write(struct.pack("<4BIHH", 3, today.year - 1900, today.month, today.day, n, head, 1 + sum(f[2] for f in fields)))
    about = [*([("prj", WGS84)] if crs is None or is_geographic(crs) else []), ("cpg", "UTF-8")]
    for suffix, text in about:
        with open(f"{stem}.{suffix}", "w") as f:
            f.write(text)
    if zipped:
        with zipfile.ZipFile(f"{stem}.shp.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for suffix in ("shp", "shx", "dbf", *(x for x, _ in about)):
                z.write(f"{stem}.{suffix}", f"{os.path.basename(stem)}.{suffix}")


def read_shapefile(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Attributes and geometry of a shapefile, read by tasks in ranges of records; numbers without decimals are whole.

    The driver walks the heads of the records, for where each range begins.
    """
    stem = path.removesuffix(".shp")
    with open(f"{stem}.dbf", "rb") as f:
        n, head, width = struct.unpack_from("<IHH", f.read(32), 4)
        table = f.read(head - 32)
    fields, at = [], 0
    while table[at] != 0x0D:
        fields.append((table[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), chr(table[at + 11]), table[at + 16], table[at + 17]))
        at += 32
    ranges, i, at = [], 0, 100
    with open(f"{stem}.shp", "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        while i < n and at + 8 <= len(data):
            if i % ROWS == 0:
                ranges.append([i, at])
            at += 8 + 2 * struct.unpack_from(">i", data, at + 4)[0]
            i += 1
    if i < n:
        raise ValueError(f"{path}: {n} rows of attributes, {i} shapes")
    ranges = [(first, start, *after) for (first, start), after in zip(ranges, [*ranges[1:], (n, at)])]

    def value(raw: bytes, kind: str, decimals: int):
        text = raw.decode(encoding, "replace").strip()
        if kind == "L":
            return None if text in ("", "?") else text in "TtYy"
        if not text:
            return None if kind != "C" else ""
        if kind == "D":
            return datetime.datetime.strptime(text, "%Y%m%d").date()
        return int(text) if kind == "N" and not decimals else float(text) if kind in "NF" else text

    types = {"L": "boolean", "D": "date", "C": "string", "F": "double"}
    kinds = [types.get(kind) or ("double" if decimals else "long") for _, kind, _, decimals in fields]
    schema = ", ".join([*(f"`{name}` {t}" for (name, *_), t in zip(fields, kinds)), "geometry binary"])
    arrow = {"boolean": pa.bool_(), "date": pa.date32(), "string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    kept = pa.schema([*(pa.field(name, arrow[t]) for (name, *_), t in zip(fields, kinds)), pa.field("geometry", pa.binary())])
    shp, dbf = parts.visible(spark, [f"{stem}.shp", f"{stem}.dbf"])

    def read(which: tuple[int, int, int, int]) -> Iterator[pa.RecordBatch]:
        first, start, last, stop = which
        with open(shp, "rb") as f:
            f.seek(start)
            data = f.read(stop - start)
        with open(dbf, "rb") as f:
            f.seek(head + first * width)
            table = f.read((last - first) * width)
        shapes, at = [], 0
        for _ in range(last - first):
            size = 2 * struct.unpack_from(">i", data, at + 4)[0]
            g = decode(data[at + 8 : at + 8 + size])
            shapes.append(wkb.encode(g) if g else None)
            at += 8 + size
        columns, place = [], 1
        for _, kind, size, decimals in fields:
            columns.append([value(table[x : x + size], kind, decimals) for x in range(place, place + (last - first) * width, width)])
            place += size
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, shapes], kept)], schema=kept)

    return parts.over(spark, ranges, schema, read)
