"""Native geometry types of Parquet: written through Arrow's extension type, read from the logical types of footers."""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pyarrow.parquet as pq

#: Name of the extension type that Arrow writes as a native geometry (fixed value).
NAME = "geoarrow.wkb"


class WkbType(pa.ExtensionType):
    """WKB with a reference system and edges, as JSON."""

    def __init__(self, meta: str = "{}"):
        self.meta = meta
        super().__init__(pa.binary(), NAME)

    def __arrow_ext_serialize__(self) -> bytes:
        return self.meta.encode()

    @classmethod
    def __arrow_ext_deserialize__(cls, storage, raw: bytes) -> WkbType:
        return cls(raw.decode() or "{}")


def wkb_type(crs=None, edges: str | None = None) -> WkbType:
    """The type for a column; registered with Arrow once a process, without which it is written as plain bytes."""
    try:
        pa.register_extension_type(WkbType())
    except pa.ArrowKeyError:
        pass  # by an earlier call, or by another library
    meta = {k: v for k, v in (("crs", crs), ("edges", edges)) if v and (k, v) != ("edges", "planar")}
    return WkbType(json.dumps(meta))


def as_native(table: pa.Table, column: str, kind: WkbType) -> pa.Table:
    i = table.schema.get_field_index(column)
    chunks = [pa.ExtensionArray.from_storage(kind, c.cast(pa.binary())) for c in table.column(i).chunks]
    return table.set_column(i, pa.field(column, kind), pa.chunked_array(chunks, kind))


def columns(f: pq.ParquetFile) -> dict[str, dict]:
    """kind (Geometry or Geography), crs and edges of each native column of a file."""
    out = {}
    for i in range(len(f.schema)):
        c = f.schema.column(i)
        m = re.match(r"(Geometry|Geography)\((.*)\)$", str(c.logical_type), re.DOTALL)
        if m:
            crs = re.search(r"crs=(\{.*\}|[^,]*?)(?:, (?:edge_interpolation|algorithm|edges)=|$)", m[2], re.DOTALL)
            edges = re.search(r"(?:edge_interpolation|algorithm|edges)=(\w+)", m[2])
            text = crs[1].strip() if crs else ""
            out[c.path] = {"kind": m[1], "crs": json.loads(text) if text.startswith("{") else text or None, "edges": edges[1] if edges else None}
    return out


def bounds(f: pq.ParquetFile, column: str) -> list[dict]:
    """Envelope and type codes of a native column in each row group, from the footer."""
    out = []
    m = f.metadata
    for g in range(m.num_row_groups):
        for c in range(m.num_columns):
            chunk = m.row_group(g).column(c)
            s = chunk.geo_statistics if chunk.path_in_schema == column else None
            if s is not None:
                out.append({"row_group": g, "xmin": s.xmin, "ymin": s.ymin, "xmax": s.xmax, "ymax": s.ymax, "types": list(s.geospatial_types or [])})
    return out
