"""GeoJSON collections of any size, read side by side.

A collection is one JSON text, so where a byte range begins tells nothing of what it is within.  But how a range changes
that, its number of quotes and of brackets opened and closed, depends only on whether it begins inside a string; so each
range reports both cases, the driver chains these few numbers, and then each range, knowing its depth, takes the
features that begin in it, reading on beyond its end for the last one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..functions import udf

#: Bytes of a range, and of what is looked at at once.
RANGE, PIECE = 32 << 20, 4 << 20
#: Extensions of files with a feature a line (fixed values).
LINES = (".geojsonl", ".geojsons", ".geojsonseq", ".ndjson", ".jsonl")
QUOTE, ESCAPE = 0x22, 0x5C
FEATURE = "g string, p string, id string"


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path)) if re.match(r"^\w+:/", path) else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(at)


def _escaped(f, at: int) -> bool:
    """Whether the byte at a place is escaped: an odd number of backslashes stands before it."""
    n, step = 0, 4096
    while at - n > 0:
        lo = max(0, at - n - step)
        before = f.read_at(at - n - lo, lo)
        run = len(before) - len(before.rstrip(b"\\"))
        n += run
        if run < len(before):
            break
    return n % 2 == 1


def _marks(raw: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, whether each stands behind an odd number of quotes, quotes themselves included in the count after them)."""
    b = np.frombuffer(raw, np.uint8)
    quote = b == QUOTE
    if escaped:
        quote[:1] = False
    after = np.flatnonzero(quote[1:] & (b[:-1] == ESCAPE)) + 1
    for i in after.tolist():
        run = i - len(raw[:i].rstrip(b"\\")) if i < 64 else i - len(raw[i - 64 : i].rstrip(b"\\")) - (i - 64)
        if run == 64:
            run = i - len(raw[:i].rstrip(b"\\"))
        if run == i and escaped:  # the run began before; its first byte is itself escaped
            run += 1
        quote[i] = run % 2 == 0
    odd = np.bitwise_xor.accumulate(quote.view(np.uint8))
    return b, quote, odd


def _steps(b: np.ndarray) -> np.ndarray:
    """1 for a bracket that opens, -1 for one that closes."""
    low = b & 0xDF  # [ and {, ] and } differ in one bit
    return (low == 0x5B).astype(np.int8) - (low == 0x5D).astype(np.int8)


def _pieces(f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    while start < stop:
        raw = f.read_at(min(PIECE, stop - start), start)
        if not raw:
            return
        yield start, raw
        start += len(raw)


def _summary(path: str, start: int, stop: int) -> tuple[int, int, int]:
    """(quotes modulo 2, change of depth if the range begins outside of a string, and if inside)."""
    odd, change = 0, [0, 0]
    with _open(path) as f:
        for at, raw in _pieces(f, start, stop):
            b, _, behind = _marks(raw, _escaped(f, at))
            step, behind = _steps(b), behind ^ odd
            change[0] += int(step[behind == 0].sum(dtype=np.int64))
            change[1] += int(step[behind == 1].sum(dtype=np.int64))
            odd = int(behind[-1])
    return odd, change[0], change[1]


def _features(path: str, start: int, stop: int, size: int, inside: int, depth: int) -> Iterator[dict]:
    """The objects at depth 2 that begin in a range."""
    waiting, held = b"", -1  # bytes of a feature that has begun, and where
    with _open(path) as f:
        for at, raw in _pieces(f, start, size):
            if at >= stop and held < 0:
                return
            b, _, behind = _marks(raw, _escaped(f, at))
            behind = behind ^ inside
            step = np.where(behind == 0, _steps(b), 0)
            level = depth + np.cumsum(step, dtype=np.int32)
            begins = np.flatnonzero((step == 1) & (level == 3) & (b == 0x7B)) + at
            ends = np.flatnonzero((step == -1) & (level == 2) & (b == 0x7D)) + at
            inside, depth = int(behind[-1]), int(level[-1])
            begins = begins[begins < stop]
            if held >= 0:
                if not len(ends):
                    waiting += raw
                    continue
                yield json.loads(waiting + raw[: ends[0] + 1 - at])
                waiting, held = b"", -1
            for x in begins.tolist():
                i = np.searchsorted(ends, x)
                if i == len(ends):
                    waiting, held = raw[x - at :], x
                    break
                yield json.loads(raw[x - at : int(ends[i]) + 1 - at])
    if held >= 0:
        raise ValueError(f"{path}: the feature at byte {held} doesn't end")


def _row(feature: dict) -> tuple[str, str | None, str | None]:
    i, p = feature.get("id"), feature.get("properties")
    return json.dumps(feature.get("geometry")), None if p is None else json.dumps(p), i if i is None or isinstance(i, str) else json.dumps(i)


def is_lines(path: str, head: bytes) -> bool:
    """A feature a line, by extension, else by how the first file begins: a line that is a whole feature."""
    if path.lower().endswith(LINES) or head.startswith(b"\x1e"):
        return True
    first, end, _ = head.partition(b"\n")
    if not re.match(rb'\s*\{\s*"type"\s*:\s*"Feature"\s*,', first):
        return False
    try:
        return not end or isinstance(json.loads(first), dict)
    except ValueError:
        return False


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """g, p, id: geometry and properties as JSON text and the id of every feature of collections, single features included."""
    udf.ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").collect()
    ranges = [(i, r["path"], a, min(a + RANGE, r["length"]), r["length"]) for i, r in enumerate(sorted(files)) for a in range(0, r["length"], RANGE)]
    if not ranges:
        return spark.createDataFrame([], FEATURE)
    dealt = lambda rows, schema: spark.createDataFrame(rows, schema).repartitionByRange(min(len(rows), 10_000), "file", "start")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.file, r.start, *_summary(r.path, r.start, r.stop)) for r in b.itertuples()], columns=["file", "start", "odd", "out", "in_"])

    kind = "file int, path string, start long, stop long, size long"
    seen = {(r["file"], r["start"]): r for r in dealt(ranges, kind).mapInPandas(summed, "file int, start long, odd int, out long, in_ long").collect()}
    known, inside, depth = [], 0, 0
    for r in ranges:
        if not r[2]:
            inside = depth = 0
        known.append((*r, inside, depth))
        s = seen[r[0], r[2]]
        depth += s["in_"] if inside else s["out"]
        inside ^= s["odd"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                out, n = [], 0
                for x in _features(r.path, r.start, r.stop, r.size, r.inside, r.depth):
                    if isinstance(x, dict) and x.get("type") == "Feature":
                        out.append(_row(x))
                    if len(out) >= 10_000:
                        n += len(out)
                        yield pd.DataFrame(out, columns=["g", "p", "id"])
                        out = []
                if not out and not n and not r.start and r.stop == r.size:
                    with _open(r.path) as f:  # no collection: a single feature
                        x = json.loads(f.read())
                    out = [_row(x)] if isinstance(x, dict) and x.get("type") == "Feature" else []
                yield pd.DataFrame(out, columns=["g", "p", "id"])

    return dealt(known, f"{kind}, inside int, depth int").mapInPandas(read, FEATURE)
