"""Remote tables: feature services read page by page, and the query of a warehouse table."""

from __future__ import annotations

import email.utils
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import udf, wkb

#: Features of a page at most; seconds after which a request is given up, and the longest wait between two.
PAGE, PATIENCE, LONGEST = 2000, 120.0, 30.0
#: Rows from which a filter is left to the warehouse.
BBOX_ROWS = 500_000


def pause(error: Exception, asked: int) -> float | None:
    """Seconds until a request that failed so often may be sent again; None if that is of no use.

    A server that is overloaded or down for a while (429 and 5xx) may name the time; else waits double, as they do for
    connections that fail.
    """
    if isinstance(error, urllib.error.HTTPError):
        if error.code != 429 and error.code // 100 != 5:
            return None
        named = (error.headers or {}).get("Retry-After")
        if named and named.isdigit():
            return float(named)
        if named:
            return max(0.0, email.utils.parsedate_to_datetime(named).timestamp() - time.time())
    return min(LONGEST, 0.5 * 2**asked)


def fetch(url: str, params: dict, get: Callable[[str], str] | None = None, *, patience: float = PATIENCE, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A JSON reply. Requests are repeated as pause() says, as long as the waits together stay within patience."""
    full, left, asked = f"{url}?{urllib.parse.urlencode(params)}", patience, 0
    text = None
    while text is None:
        try:
            text = get(full) if get else urllib.request.urlopen(full, timeout=60).read().decode()
        except urllib.error.URLError as error:  # HTTPError is one, too
            wait = pause(error, asked)
            if wait is None or wait > left:
                raise
            left, asked = left - wait, asked + 1
            sleep(wait)
    out = json.loads(text)
    if "error" in out:  # these services answer errors with status 200
        raise ValueError(out["error"].get("message", "the service reports an error"))
    return out


def token_for(url: str, user: str, password: str, *, portal: str | None = None, post: Callable[[str, dict], str] | None = None) -> str:
    """A token for a user, from the portal or, on a server of one's own, from the token service beside its rest folder."""
    root = url.lower().find("/rest/")
    if portal is None and root < 0:
        raise ValueError("no portal is given, and the address has no rest folder beside which a token service could be")
    service = portal or f"{url[:root]}/tokens/generateToken"
    form = {"username": user, "password": password, "client": "requestip", "expiration": 60, "f": "json"}
    text = post(service, form) if post else urllib.request.urlopen(service, urllib.parse.urlencode(form).encode(), timeout=60).read().decode()
    out = json.loads(text)
    if "token" not in out:
        raise ValueError(out.get("error", {}).get("message", "no token"))
    return out["token"]


def page_params(offset: int, limit: int, *, where: str = "1=1", bbox: tuple | None = None, fields: str = "*", token: str | None = None) -> dict:
    p = {"where": where, "outFields": fields, "returnGeometry": "true", "f": "geojson", "outSR": 4326, "resultOffset": offset, "resultRecordCount": limit}
    if bbox:
        p |= {"geometry": ",".join(map(str, bbox)), "geometryType": "esriGeometryEnvelope", "inSR": 4326, "spatialRel": "esriSpatialRelIntersects"}
    return p | ({"token": token} if token else {})


def pages(total: int, page: int, limit: int | None = None) -> list[tuple[int, int]]:
    """(offset, features) of each request."""
    total = total if limit is None else min(total, limit)
    return [(i, min(page, total - i)) for i in range(0, total, page)]


@dataclass
class _Page(InputPartition):
    offset: int
    limit: int


class FeatureServiceReader(DataSourceReader):
    """A partition for each page; a page that comes short is asked for again from where it ended."""

    def __init__(self, options: dict, get: Callable[[str], str] | None = None):
        self.o, self.get = dict(options), get

    def _ask(self) -> dict:
        o = self.o
        return {"where": o.get("where", "1=1"), "bbox": tuple(map(float, o["bbox"].split(","))) if o.get("bbox") else None, "fields": o.get("fields", "*"), "token": o.get("token")}

    def partitions(self) -> list[_Page]:
        url, ask = self.o["url"].rstrip("/"), self._ask()
        info = fetch(url, {"f": "json"} | ({"token": ask["token"]} if ask["token"] else {}), self.get)
        count = page_params(0, 0, **ask) | {"returnCountOnly": "true", "f": "json"}
        total = fetch(f"{url}/query", count, self.get)["count"]
        page = min(PAGE, int(info.get("maxRecordCount", PAGE)), int(self.o.get("page", PAGE)))
        return [_Page(*p) for p in pages(total, page, int(self.o["limit"]) if self.o.get("limit") else None)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        at, left = partition.offset, partition.limit
        while left > 0:
            found = fetch(f"{self.o['url'].rstrip('/')}/query", page_params(at, left, **self._ask()), self.get).get("features", [])
            if not found:
                return
            for f in found:
                g = f.get("geometry")
                yield (wkb.encode(wkb.from_geojson(g)) if g else None, json.dumps(f.get("properties") or {}))
            at, left = at + len(found), left - len(found)


class FeatureServiceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geoframe_service"

    def schema(self) -> str:
        return "geometry binary, properties string"

    def reader(self, schema):
        return FeatureServiceReader(dict(self.options))


FIELD_TYPES = {"esriFieldTypeOID": "long", "esriFieldTypeInteger": "int", "esriFieldTypeSmallInteger": "int", "esriFieldTypeDouble": "double", "esriFieldTypeSingle": "float"}


def read_feature_service(spark: SparkSession, url: str, *, where: str = "1=1", bbox: tuple | None = None, columns: list[str] | None = None, limit: int | None = None, token: str | None = None) -> DataFrame:
    """Fields of a layer as columns, and its geometries; pages are read side by side."""
    udf.ship(spark)
    spark.dataSource.register(FeatureServiceSource)
    info = fetch(url.rstrip("/"), {"f": "json"} | ({"token": token} if token else {}))
    fields = [f for f in info.get("fields", []) if not columns or f["name"] in columns]
    reader = spark.read.format("geoframe_service").option("url", url).option("where", where).option("fields", ",".join(f["name"] for f in fields) or "*")
    for k, v in (("bbox", ",".join(map(str, bbox)) if bbox else None), ("limit", limit), ("token", token)):
        if v is not None:
            reader = reader.option(k, str(v))
    schema = ", ".join(f"`{f['name']}` {FIELD_TYPES.get(f['type'], 'string')}" for f in fields)
    p = F.from_json("properties", schema)
    return reader.load().select(*[p[f["name"]].alias(f["name"]) for f in fields], "geometry")


# Warehouse tables


def table_id(name: str, project: str | None = None) -> str:
    """project.dataset.table, each part of letters, digits, dash and underscore."""
    parts = name.strip("`").split(".")
    if len(parts) == 2 and project:
        parts = [project, *parts]
    if len(parts) != 3 or not all(re.fullmatch(r"[A-Za-z0-9_-]+", p) for p in parts):
        raise ValueError(f"not project.dataset.table: {name!r}")
    return ".".join(parts)


def bbox_on_server(mode: str, rows: int | None, threshold: int = BBOX_ROWS) -> bool:
    """Where a box is filtered: auto leaves large tables to the server; tables of unknown size are filtered here."""
    large = (rows or 0) >= threshold
    try:
        return {"server": True, "local": False, "auto": large}[mode]
    except KeyError:
        raise ValueError(f"no mode {mode}") from None


def rows_query(name: str) -> str:
    """What asks for a table's number of rows, from its dataset's metadata, without a scan."""
    project, dataset, table = name.split(".")
    return f"SELECT row_count FROM `{project}.{dataset}.__TABLES__` WHERE table_id = '{table}'"


def warehouse_rows(spark: SparkSession, name: str) -> int | None:
    """Rows of a table as its metadata tell; None where they can't be read."""
    try:
        found = spark.read.format("bigquery").option("viewsEnabled", "true").option("query", rows_query(name)).load().first()
    except Exception as e:  # of the connector, whose errors have no common class
        warnings.warn(f"the number of rows of {name} can't be read: {e}", stacklevel=2)
        return None
    return found[0] if found else None


def warehouse_filter(*, where: str | None = None, bbox: tuple | None = None, geography: str = "geography", on_server: bool = True) -> str | None:
    """The condition that the connector pushes down."""
    from ..operators.extract import check_condition, parse_bbox

    parts = [f"({check_condition(where)})"] if where else []
    if bbox and on_server:
        x0, y0, x1, y1 = parse_bbox(bbox)
        ring = f"{x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}"
        parts.append(f"ST_INTERSECTS({geography}, ST_GEOGFROMTEXT('POLYGON(({ring}))'))")
    return " AND ".join(parts) or None


def read_bigquery(spark: SparkSession, name: str, *, project: str | None = None, where: str | None = None, bbox: tuple | None = None, bbox_mode: str = "auto", rows: int | None = None, columns: list[str] | None = None, exclude_columns: list[str] | None = None, limit: int | None = None, geography: str = "geography") -> DataFrame:
    """Through the public Spark connector, which must be on the class path."""
    if bbox and bbox_mode == "auto" and rows is None:
        rows = warehouse_rows(spark, table_id(name, project))
    on_server = bbox_on_server(bbox_mode, rows)
    reader = spark.read.format("bigquery").option("table", table_id(name, project))
    condition = warehouse_filter(where=where, bbox=bbox, geography=geography, on_server=on_server)
    df = (reader.option("filter", condition) if condition else reader).load().withColumnRenamed(geography, "geometry")
    df = df.withColumn("geometry", udf.from_text(F.col("geometry")))
    from ..operators.extract import extract

    return extract(df, columns=columns, exclude_columns=exclude_columns, bbox=None if on_server else bbox, limit=limit)
