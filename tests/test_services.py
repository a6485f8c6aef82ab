import json
import urllib.error

import pytest
from geoframe.plans import regression
from geoframe.sources import services


def server(features, most=2, busy=0):
    """A layer that gives at most `most` features a page and is busy at first."""
    state = {"busy": busy, "asked": []}

    def get(url):
        state["asked"].append(url)
        if state["busy"]:
            state["busy"] -= 1
            raise urllib.error.HTTPError(url, 503, "busy", {}, None)
        q = dict(p.split("=", 1) for p in url.partition("?")[2].split("&"))
        if "/query" not in url:
            return json.dumps({"maxRecordCount": 1000, "fields": []})
        if q.get("returnCountOnly"):
            return json.dumps({"count": len(features)})
        at = int(q["resultOffset"])
        return json.dumps({"features": features[at : at + min(most, int(q["resultRecordCount"]))]})

    return get, state


FEATURES = [{"geometry": {"type": "Point", "coordinates": [i, 1]} if i else None, "properties": {"OBJECTID": i}} for i in range(7)]


def test_short_pages_are_completed():
    get, state = server(FEATURES)
    reader = services.FeatureServiceReader({"url": "http://x/0", "page": "5"}, get)
    parts = reader.partitions()
    assert [(p.offset, p.limit) for p in parts] == [(0, 5), (5, 2)]
    rows = [r for p in parts for r in reader.read(p)]
    assert [json.loads(r[1])["OBJECTID"] for r in rows] == list(range(7)) and rows[0][0] is None and rows[1][0]


def test_busy_servers_are_asked_again():
    waits = []
    get, state = server(FEATURES, busy=3)
    assert services.fetch("http://x/0/query", services.page_params(0, 1), get, sleep=waits.append)["features"]
    assert waits == [0.5, 1.0, 2.0]
    get, state = server(FEATURES, busy=9)
    with pytest.raises(urllib.error.HTTPError):
        services.fetch("http://x/0/query", services.page_params(0, 1), get, patience=10, sleep=waits.append)
    with pytest.raises(ValueError, match="no token"):
        services.fetch("http://x", {}, lambda _: '{"error": {"message": "no token"}}')
    error = lambda code, **headers: urllib.error.HTTPError("http://x", code, "", {k.replace("_", "-"): v for k, v in headers.items()}, None)
    assert services.pause(error(404), 0) is None and services.pause(error(429, Retry_After="7"), 0) == 7 and services.pause(error(503), 9) == services.LONGEST
    assert services.pause(error(503, Retry_After="Thu, 01 Jan 1970 00:00:00 GMT"), 0) == 0 and services.pause(urllib.error.URLError("down"), 1) == 1.0


def test_tokens():
    asked = []

    def post(url, form):
        asked.append((url, form["username"]))
        return '{"token": "t"}' if form["password"] == "right" else '{"error": {"message": "wrong password"}}'

    assert services.token_for("https://h/arcgis/rest/services/a/FeatureServer/0", "u", "right", post=post) == "t"
    assert services.token_for("https://h/x", "u", "right", portal="https://p/generateToken", post=post) == "t"
    assert asked == [("https://h/arcgis/tokens/generateToken", "u"), ("https://p/generateToken", "u")]
    with pytest.raises(ValueError, match="wrong password"):
        services.token_for("https://h/arcgis/rest/x", "u", "no", post=post)
    with pytest.raises(ValueError, match="no portal"):
        services.token_for("https://h/x", "u", "no", post=post)


def test_requests():
    p = services.page_params(10, 5, bbox=(0, 1, 2, 3), token="t")
    assert p["geometry"] == "0,1,2,3" and p["resultOffset"] == 10 and p["token"] == "t" and p["inSR"] == 4326
    assert services.pages(5, 2) == [(0, 2), (2, 2), (4, 1)] and services.pages(5, 2, 3) == [(0, 2), (2, 1)] and services.pages(0, 2) == []


def test_warehouse():
    assert services.table_id("d.t", "p") == "p.d.t" == services.table_id("`p.d.t`")
    for bad in ("t", "a.b", "a.b.c.d", "a.b.c;drop"):
        with pytest.raises(ValueError):
            services.table_id(bad)
    assert services.bbox_on_server("auto", 500_000) and not services.bbox_on_server("auto", None) and not services.bbox_on_server("local", 10**9)
    assert services.rows_query("p.d.t") == "SELECT row_count FROM `p.d.__TABLES__` WHERE table_id = 't'"
    with pytest.raises(ValueError, match="no mode"):
        services.bbox_on_server("x", 1)
    f = services.warehouse_filter(where="a > 1", bbox=(0, 0, 1, 1), geography="g")
    assert f == "(a > 1) AND ST_INTERSECTS(g, ST_GEOGFROMTEXT('POLYGON((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 1.0, 0.0 0.0))'))"
    assert services.warehouse_filter(bbox=(0, 0, 1, 1), on_server=False) is None


def test_regressions():
    found = regression.compare({"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0, "e": 1.0}, {"a": 1.05, "b": 1.2, "c": 1.3, "d": 0.5})
    assert {k: v[0] for k, v in found.items()} == {"a": "ok", "b": "warning", "c": "failure", "d": "improved"} and "c" in regression.report(found)
