"""Catalogue entries: items and collections as JSON, from bounds and a path."""

from __future__ import annotations

from datetime import datetime, timezone

VERSION = "1.0.0"


def item(item_id: str, bounds: tuple[float, float, float, float], href: str, *, moment: datetime | None = None, properties: dict | None = None) -> dict:
    """An item whose geometry is the rectangle of its bounds and whose asset is the file."""
    x0, y0, x1, y1 = bounds
    moment = moment or datetime.now(timezone.utc)
    return {
        "type": "Feature",
        "stac_version": VERSION,
        "id": item_id,
        "geometry": {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]},
        "bbox": [x0, y0, x1, y1],
        "properties": {"datetime": moment.strftime("%Y-%m-%dT%H:%M:%SZ"), **(properties or {})},
        "links": [{"rel": "self", "href": f"./{item_id}.json", "type": "application/json"}],
        "assets": {"data": {"href": href, "type": "application/vnd.apache.parquet", "roles": ["data"]}},
    }


def collection(collection_id: str, items: list[dict], *, description: str = "", licence: str = "proprietary") -> dict:
    """A collection over items, its extent theirs together."""
    if not items:
        raise ValueError("a collection needs an item")
    boxes = [i["bbox"] for i in items]
    moments = sorted(i["properties"]["datetime"] for i in items)
    box = [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]
    return {
        "type": "Collection",
        "stac_version": VERSION,
        "id": collection_id,
        "description": description or collection_id,
        "license": licence,
        "extent": {"spatial": {"bbox": [box]}, "temporal": {"interval": [[moments[0], moments[-1]]]}},
        "links": [{"rel": "self", "href": "./collection.json", "type": "application/json"}, *[{"rel": "item", "href": f"./{i['id']}.json", "type": "application/json"} for i in items]],
    }


def validate(entry: dict) -> list[str]:
    """What is missing or wrong."""
    kind = entry.get("type")
    needed = {"Feature": ("stac_version", "id", "geometry", "bbox", "properties", "links", "assets"), "Collection": ("stac_version", "id", "description", "license", "extent", "links")}.get(kind)
    if needed is None:
        return [f"type is {kind!r}, neither Feature nor Collection"]
    wrong = [f"{k} is missing" for k in needed if k not in entry]
    if kind == "Feature":
        box = entry.get("bbox")
        if box is not None and not (len(box) in (4, 6) and box[0] <= box[len(box) // 2] and box[1] <= box[len(box) // 2 + 1]):
            wrong.append("bbox isn't in order")
        if "datetime" not in entry.get("properties", {}):
            wrong.append("properties.datetime is missing")
        wrong += [f"asset {n} has no href" for n, a in entry.get("assets", {}).items() if not a.get("href")]
    wrong += ["a link needs rel and href" for x in entry.get("links", []) if not x.get("rel") or not x.get("href")]
    return wrong
