"""The `geo` metadata of Parquet files: build, read, compare and report. Driver only, footers only."""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq

from ..functions import expr, native

#: Format versions and what their files carry (fixed values).
VERSIONS = {"1.0": "1.0.0", "1.1": "1.1.0", "2.0": "2.0.0"}
DEFAULT_VERSION = "1.1"
COMPRESSION = {"ZSTD": (1, 22, 15), "GZIP": (1, 9, 6), "BROTLI": (1, 11, 6), "LZ4": None, "SNAPPY": None, "NONE": None}


def open_footer(path: str) -> pq.ParquetFile:
    """A local path or any URI that Arrow's file systems know."""
    if re.match(r"^\w+://", path):
        fs, inner = pafs.FileSystem.from_uri(path)
        return pq.ParquetFile(fs.open_input_file(inner))
    return pq.ParquetFile(path)


def geo_metadata(path: str) -> dict | None:
    raw = (open_footer(path).metadata.metadata or {}).get(b"geo")
    return json.loads(raw) if raw else None


def file_info(path: str) -> dict:
    """Rows, row groups, size, codec of each column, envelope column, geo metadata."""
    f = open_footer(path)
    m = f.metadata
    codecs = {}
    for g in range(m.num_row_groups):
        for c in range(m.num_columns):
            col = m.row_group(g).column(c)
            codecs.setdefault(col.path_in_schema.split(".")[0], col.compression)
    boxes = [x.name for x in f.schema_arrow if re.search("(bbox|bounds|extent)$", x.name.lower()) and x.type.num_fields == 4 and {x.type.field(i).name for i in range(4)} == set(expr.BBOX_FIELDS)]
    raw = (m.metadata or {}).get(b"geo")
    size = sum(m.row_group(g).total_byte_size for g in range(m.num_row_groups))
    return {"native": native.columns(f), "path": path, "rows": m.num_rows, "row_groups": m.num_row_groups, "size": os.path.getsize(path) if os.path.exists(path) else size, "codecs": codecs, "bbox_column": boxes[0] if boxes else None, "geo": json.loads(raw) if raw else None, "created_by": m.created_by, "columns": {x.name: "binary" if isinstance(x.type, pa.BaseExtensionType) else str(x.type) for x in f.schema_arrow}}


def row_group_bounds(path: str, bbox_column: str = "bbox") -> list[dict]:
    """Envelope of each row group, from the footer's statistics alone."""
    m = open_footer(path).metadata
    out = []
    for g in range(m.num_row_groups):
        found = {"row_group": g}
        for c in range(m.num_columns):
            col = m.row_group(g).column(c)
            column, _, part = col.path_in_schema.partition(".")
            if column == bbox_column and part in expr.BBOX_FIELDS and col.statistics is not None and col.statistics.has_min_max:
                found[part] = col.statistics.min if part.endswith("min") else col.statistics.max
        out.append(found)
    return out


def column_chunk_stats(path: str, column: str) -> list[dict]:
    m = open_footer(path).metadata
    out = []
    for g in range(m.num_row_groups):
        for c in range(m.num_columns):
            col = m.row_group(g).column(c)
            if col.path_in_schema == column:
                s = col.statistics
                out.append({"row_group": g, "min": s.min if s is not None and s.has_min_max else None, "max": s.max if s is not None and s.has_min_max else None, "nulls": s.null_count if s is not None else None, "bytes": col.total_compressed_size})
    return out


def version_for(original: dict | None, wanted: str | None = None) -> str:
    """The version to write: the wanted one, else 1.x files become 1.1 and 2.x files 2.0."""
    if wanted:
        if wanted not in VERSIONS:
            raise ValueError(f"no version {wanted}; there are {', '.join(VERSIONS)}")
        return wanted
    return "2.0" if original and str(original.get("version", "1")).startswith("2") else DEFAULT_VERSION


def build(geometry: str, *, version: str = DEFAULT_VERSION, bbox: tuple | None = None, geometry_types: list[str] | None = None, crs=None, bbox_column: str | None = None, edges: str | None = None, original: dict | None = None, coverings: dict | None = None) -> dict:
    """The `geo` value. Bounds and types are those given, never the parent's; its other columns and keys stay."""
    meta = json.loads(json.dumps(original)) if original else {}
    meta["version"] = VERSIONS[version]
    meta["primary_column"] = geometry
    column = dict(meta.get("columns", {}).get(geometry, {}))
    column["encoding"] = "WKB"
    column["geometry_types"] = sorted(geometry_types or [])
    column.pop("bbox", None)
    if bbox and None not in bbox:
        column["bbox"] = list(bbox)
    if crs is not None:
        column["crs"] = crs
    if edges:
        column["edges"] = edges
        if edges == "spherical":
            column["orientation"] = "counterclockwise"
    covering = {k: v for k, v in column.pop("covering", {}).items() if k != "bbox"} | (coverings or {})
    if bbox_column and version != "1.0":
        covering["bbox"] = {n: [bbox_column, n] for n in expr.BBOX_FIELDS}
    if covering and version != "1.0":
        column["covering"] = covering
    meta["columns"] = {**meta.get("columns", {}), geometry: column}
    return meta


def crs_code(crs) -> str:
    """AUTHORITY:CODE of a CRS value of the metadata; none is OGC:CRS84."""
    if crs is None:
        return "OGC:CRS84"
    if isinstance(crs, dict):
        i = crs.get("id") or {}
        return f"{i['authority']}:{i['code']}".upper() if i else crs.get("name", "unknown")
    m = re.match(r"urn:ogc:def:crs:(\w+):[\w.]*:(\w+)$", str(crs), re.IGNORECASE)
    return f"{m[1]}:{m[2]}".upper() if m else str(crs).upper()


def named_crs(code: str) -> dict:
    """The least that the metadata needs to name a system."""
    authority, _, number = crs_code(code).partition(":")
    kind = is_geographic(code)
    return {"type": "GeographicCRS" if kind else "ProjectedCRS", "name": crs_code(code), "id": {"authority": authority, "code": int(number) if number.isdigit() else number}}


def is_geographic(crs) -> bool | None:
    """True or False where known, None where not."""
    if isinstance(crs, dict) and "type" in crs:
        return crs["type"].startswith("Geographic")
    code = crs_code(crs)
    if code in ("OGC:CRS84", "EPSG:4326", "EPSG:4269", "EPSG:4258", "OGC:CRS83"):
        return True
    return False if re.fullmatch(r"EPSG:(3857|5070|6933|3794|32[67]\d\d)", code) else None


def same_crs(a, b) -> bool:
    return crs_code(a).replace("EPSG:4326", "OGC:CRS84") == crs_code(b).replace("EPSG:4326", "OGC:CRS84")


def file_kind(info: dict) -> str:
    """v1, v2, native (geometry types without metadata) or unknown."""
    if not info["geo"] and info.get("native"):
        return "native"
    version = str((info["geo"] or {}).get("version", ""))
    return "v1" if version.startswith("1.") else "v2" if version.startswith("2.") else "unknown"


def mismatches(info: dict) -> list[str]:
    """Where a native geometry type and the `geo` metadata of one column tell different things."""
    out = []
    described = (info["geo"] or {}).get("columns", {})
    for name, own in info.get("native", {}).items():
        told = described.get(name)
        if told is None:
            continue
        if own["crs"] and not told.get("crs"):
            out.append(f"{name}: the type names {crs_code(own['crs'])}, the metadata no reference system")
        elif own["crs"] and not same_crs(own["crs"], told["crs"]):
            out.append(f"{name}: the type names {crs_code(own['crs'])}, the metadata {crs_code(told['crs'])}")
        if own["edges"] and told.get("edges") and own["edges"].lower() != told["edges"].lower():
            out.append(f"{name}: edges are {own['edges']} by type and {told['edges']} by metadata")
    return out


#: Bytes by suffix of a size; none is megabytes.
SUFFIXES = {suffix: 1024**power for power, unit in enumerate(["", "K", "M", "G", "T"]) for suffix in ((unit, f"{unit}B") if unit else ("B",))} | {"": 1024**2}


def parse_size(text: str | int | float) -> int:
    """256MB and the like, in bytes; a bare number is MB."""
    given = str(text).strip().upper()
    number = given.rstrip("BKMGT").rstrip()
    suffix = given[len(number) :].strip()
    try:
        size = float(number) * SUFFIXES[suffix]
    except (ValueError, KeyError):
        raise ValueError(f"not a size: {text!r}") from None
    if not 0 < size < float("inf"):
        raise ValueError(f"not a size: {text!r}")
    return int(size)


def row_group_rows(rows: int, size: int, *, target_mb: float | None = None, target_rows: int | None = None) -> int:
    """Rows of a row group: as told, or as many as fill the target at this table's bytes a row."""
    if target_rows:
        return max(1, min(target_rows, rows) if rows else target_rows)
    if not rows or not size:
        return 100_000
    a_row = size / rows
    return min(rows, max(1, int((target_mb or 130) * SUFFIXES["M"] / a_row)))


def compression(codec: str = "ZSTD", level: int | None = None) -> tuple[str, int | None]:
    codec = codec.upper().replace("UNCOMPRESSED", "NONE")
    if codec not in COMPRESSION:
        raise ValueError(f"no compression {codec}; there are {', '.join(COMPRESSION)}")
    levels = COMPRESSION[codec]
    if levels is None:
        return codec, None
    level = levels[2] if level is None else level
    if not levels[0] <= level <= levels[1]:
        raise ValueError(f"{codec} has levels {levels[0]} to {levels[1]}")
    return codec, level


def validate(info: dict) -> list[tuple[str, bool, str]]:
    """(rule, kept, what is wrong) of the format's rules on metadata and schema."""
    out: list[tuple[str, bool, str]] = []

    def rule(name: str, kept: bool, why: str = "") -> bool:
        out.append((name, bool(kept), "" if kept else why))
        return bool(kept)

    meta = info["geo"]
    if not rule("geo metadata", isinstance(meta, dict), "there is no geo key"):
        return out
    rule("version", isinstance(meta.get("version"), str) and re.match(r"\d+\.\d+", meta["version"]), "version must be text like 1.1.0")
    primary, columns = meta.get("primary_column"), meta.get("columns")
    rule("primary column", isinstance(primary, str) and primary, "primary_column must be a name")
    if not rule("columns", isinstance(columns, dict) and columns, "columns must be a non-empty object"):
        return out
    rule("primary column is described", primary in columns, f"columns lacks {primary}")
    known = set(GEOMETRY_TYPES) | {f"{t} Z" for t in GEOMETRY_TYPES}
    for name, c in columns.items():
        if not rule(f"{name}: in the file", name in info["columns"], "no such column"):
            continue
        rule(f"{name}: at the root, binary", info["columns"][name] in ("binary", "large_binary") or not str(meta.get("version")).startswith("1."), f"it is {info['columns'][name]}")
        rule(f"{name}: encoding", c.get("encoding") in ("WKB", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon"), f"encoding {c.get('encoding')}")
        types = c.get("geometry_types")
        rule(f"{name}: geometry types", isinstance(types, list) and set(types) <= known and len(set(types)) == len(types), f"geometry_types {types}")
        rule(f"{name}: crs", c.get("crs") is None or isinstance(c["crs"], dict), "crs must be PROJJSON or null")
        rule(f"{name}: edges", c.get("edges", "planar") in ("planar", "spherical", "vincenty", "thomas", "andoyer", "karney"), f"edges {c.get('edges')}")
        rule(f"{name}: orientation", c.get("orientation", "counterclockwise") == "counterclockwise", f"orientation {c.get('orientation')}")
        rule(f"{name}: epoch", c.get("epoch") is None or isinstance(c["epoch"], (int, float)), "epoch must be a number")
        box = c.get("bbox")
        rule(f"{name}: bbox", box is None or isinstance(box, list) and len(box) in (4, 6) and all(isinstance(v, (int, float)) for v in box), "bbox must be 4 or 6 numbers")
        cover = (c.get("covering") or {}).get("bbox")
        if cover is not None:
            first = {tuple(v)[0] for v in cover.values() if isinstance(v, list) and len(v) == 2}
            rule(f"{name}: covering", set(expr.BBOX_FIELDS) <= set(cover) and len(first) == 1, "covering.bbox must name the four fields of one column")
            rule(f"{name}: covering column", first and next(iter(first)) in info["columns"], "the covering column isn't in the file")
            kind = info["columns"].get(next(iter(first), None), "") if first else ""
            fields = dict(re.findall(r"(\w+): (\w+)", kind))
            rule(f"{name}: covering fields", kind.startswith("struct") and all(fields.get(n) in ("double", "float") for n in expr.BBOX_FIELDS) and len(set(fields.values())) == 1, f"the covering column is {kind}")
            rule(f"{name}: covering from 1.1 on", not str(meta.get("version")).startswith("1.0"), "version 1.0 has no covering")
    if str(meta.get("version")).startswith("2."):
        for name in columns:
            rule(f"{name}: native type", name in info.get("native", {}), "version 2 needs a native geometry type")
        for why in mismatches(info):
            rule("type and metadata agree", False, why)
    return out


def validate_native(path: str) -> list[tuple[str, bool, str]]:
    """(rule, kept, what is wrong) of a file's native geometry types: there are some, with bounds in each row group."""
    with open_footer(path) as f:
        found = native.columns(f)
        out = [("native geometry type", bool(found), "" if found else "no column has one")]
        for name, c in found.items():
            groups = native.bounds(f, name)
            whole = len(groups) == f.metadata.num_row_groups
            out.append((f"{name}: bounds of row groups", whole, "" if whole else f"{len(groups)} of {f.metadata.num_row_groups} row groups have them"))
            known = c["crs"] is None or isinstance(c["crs"], dict) or ":" in str(c["crs"])
            out.append((f"{name}: reference system", known, "" if known else f"crs {c['crs']}"))
    return out


GEOMETRY_TYPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
